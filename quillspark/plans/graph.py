"""Registered queries over concept graphs, with their SQL: concepts are parts, in groups by type, related to the next sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import graph as G
from quillspark.plans.queries import query, table
from quillspark.sources.scratch import scratch_folder

_MARKED = """c as (select p_type, p_partkey, p_name||' '||p_size as name, case when p_size%3=0 then [] else [p_name||' '||(p_size+1), p_name||' '||(p_size+40), p_name||' '||(p_size+1)] end as related, [p_brand, p_name||' '||(p_size-1)] as prerequisites,
 p_size%4 as n_chunks, case when p_size%7=0 then 1 else 0 end as n_formulas, case when p_size%5=0 then p_name end as definition from part),
f as (select *, case when regexp_matches(name,'^(red|small) .* [0-9]$') then 'invalid' when len(related)=0 and n_chunks<2 and n_formulas=0 and definition is null then 'no_evidence' end as why from c),
m as (select *, case when why is not null then why when row_number() over (partition by p_type, lower(name), why is null order by p_partkey)>1 then 'repeat' end as removed from f)"""
_EDGES = f"""{_MARKED}, k as (select * from m where removed is null), g as (select p_type, name as source, unnest(related) as target from k),
e as (select g.*, 'related' as relationship from g where (p_type, target) in (select (p_type, name) from k) union all select p_type, unnest(prerequisites), name, 'prerequisite' from k)"""


def _marked(spark, sf_dir):
    named = lambda by: F.concat("p_name", F.lit(" "), F.col("p_size") + by)
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_type", "p_partkey", named(0).alias("name"), F.when(size % 3 != 0, F.array(named(1), named(40), named(1))).alias("related"), F.array("p_brand", named(-1)).alias("prerequisites"), (size % 4).alias("n_chunks"), (size % 7 == 0).cast("int").alias("n_formulas"), F.when(size % 5 == 0, F.col("p_name")).alias("definition"))
    return G.cleaned(rows, ["p_type"], "p_partkey", ~F.col("name").rlike("^(red|small) .* [0-9]$"))


@query(f"with {_EDGES} select * from e")
def concept_graph_edges(spark, sf_dir):
    """Related and prerequisite edges of the concepts that stay."""
    return G.concept_edges(_marked(spark, sf_dir), ["p_type"])


@query(f"with {_MARKED} select p_type, count(*) as input_nodes, count(*) filter (removed is null) as output_nodes, count(removed) as removed_nodes, {', '.join(f'''count(*) filter (removed='{r}') as "{r}"''' for r in G.REMOVED)} from m group by 1")
def concept_graph_clean_up(spark, sf_dir):
    """How many concepts were removed, by reason."""
    return G.clean_up(_marked(spark, sf_dir), ["p_type"])


@query(f"""with {_EDGES}, o as (select source, target, relationship, count(*) as held from e group by all), n as (select source, target, relationship, count(*) as weight from e where p_type not like 'S%' group by all),
b as (select * from o full join n using (source, target, relationship))
select relationship as relation, count(held) as before, count(weight) as after, count(*) filter (held is null) as added, count(*) filter (weight is null) as dropped, count(*) filter (weight<>held) as changed, 0 as invalid from b group by 1""")
def graph_merge_counts(spark, sf_dir):
    """What changes when a graph of all types is rebuilt without those that begin with S."""
    folder = scratch_folder(spark, "graph")
    edges = G.concept_edges(_marked(spark, sf_dir), ["p_type"])
    of = lambda df: {r: df.where(F.col("relationship") == r) for r in ("related", "prerequisite")}
    G.merge_graph(spark, folder, of(edges))
    return G.merge_graph(spark, folder, of(edges.where("p_type not like 'S%'")))
