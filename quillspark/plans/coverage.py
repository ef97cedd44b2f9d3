"""Registered queries over what is found of a source, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import concepts as K
from quillspark.operators import coverage as V
from quillspark.plans.concepts import CANDIDATES, _flat
from quillspark.plans.queries import query, table
from quillspark.sources.scratch import checkpointed


@query(f"""{CANDIDATES}, n as (select source, name from c where reason is null), s as (select distinct source, md5(said) as text_id, said as text from d),
m as (select source, text_id, name, contains(lower(text),lower(name)) as contained, list_distinct(regexp_extract_all(lower(name),'[a-z0-9]{{4,}}')) as a, list_distinct(regexp_extract_all(lower(text),'[a-z0-9]{{4,}}')) as b from s join n using (source))
select source, text_id, name, contained from m where contained or (len(a)>0 and len(list_intersect(a,b))>=0.65*len(a))""")
def related_concepts(spark, sf_dir):
    """Valid concepts of a source that its defining sentences are about. Characters beyond ASCII are underscores in both, as SQL sees the sentences."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    said = F.regexp_replace("said", r"[^\x00-\x7F]", "_")
    texts = K.defined_terms(docs, ["source"]).select("source", F.md5(said).alias("text_id"), said.alias("text"))
    return V.related_names(texts, K.valid_names(docs, ["source"]).select("source", "name"), ["source"])


_WORDS = "list_distinct(string_split({},' '))"
_SHARE = " ".join(f"when '{k}' then len(w)=0 or shared/greatest(1,least(len(w),{most}))>={share}" for k, (_, most, share) in V.OVERLAPS.items())
_LEAST = " ".join(f"when '{k}' then {least}" for k, (least, _, _) in V.OVERLAPS.items())


@query(rf"""{CANDIDATES}, i0 as (select source, 'concept' as kind, name as text from c where reason is null union select source, 'definition', definition from c where reason is null and definition is not null
 union select source, 'formula', f from (select source, {_flat('f')} as f from (select source, unnest(regexp_extract_all(text,'{K.FORMULA}',1)) as f from r)) where length(f) between 3 and 120),
i as (select *, {_flat('lower(text)')} as norm from i0), o as (select {_flat('lower(text)')} as text from conversations),
v as (select list(distinct word) as words from (select unnest(string_split(text,' ')) as word from o) where word<>''),
j as (select i.*, list_filter({_WORDS.format('norm')}, lambda x: length(x)>=case kind {_LEAST} else 0 end) as w from i),
k as (select *, len(list_intersect(w, (select words from v))) as shared, kind in ('concept','formula') and exists(select 1 from o where contains(o.text, norm)) as inside from j),
q as (select *, norm='' or inside or coalesce(case kind {_SHARE} end, false) as kept from k),
u as (select source, kind, count(*) as n, count(*) filter (kept) as retained, coalesce(array_to_string((list(text order by text) filter (not kept))[1:40],'|'),'') as missing from q group by all),
ss as (select source, unnest({list(V.KINDS)}) as kind from (select distinct source from i))
select ss.source, ss.kind, coalesce(n,0) as n, coalesce(retained,0) as retained, case when n is null then 100 else round(100.0*retained/n,2) end as percent, coalesce(missing,'') as missing from ss left join u on u.source=ss.source and u.kind=ss.kind""")
def concept_coverage(spark, sf_dir):
    """How many of a source's concepts, definitions and formulas conversations take up."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    valid = checkpointed(K.valid_names(docs, ["source"]).select("source", "name", F.regexp_replace("definition", r"[^\x00-\x7F]", "_").alias("definition")))
    items = valid.select("source", F.lit("concept").alias("kind"), F.col("name").alias("text")).unionByName(valid.where("definition is not null").select("source", F.lit("definition").alias("kind"), F.col("definition").alias("text")))
    items = items.unionByName(K.formulas(docs, ["source"]).select("source", F.lit("formula").alias("kind"), F.col("formula").alias("text")))
    return V.coverage(items, table(spark, sf_dir, "conversations").select("text"), ["source"]).withColumn("missing", F.array_join("missing", "|"))
