"""Registered queries that look things up by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import lookup as L
from quillspark.plans.queries import query, table


def _clean(x: str) -> str:
    trim = r"regexp_replace({},'^\s+|\s+$','','g')"
    return trim.format(rf"regexp_replace(translate({trim.format(f'lower({x})')},'_-','  '),'\s+',' ','g')")


_TOKENS = r"'|'||regexp_replace({},'([^\p{{L}}\p{{N}}\p{{M}}_])','|\1|','g')||'|'"


@query(rf"""with w as (select doc_id, source, text, regexp_extract_all(lower(text),'[a-z]+') as w from documents),
a as (select w[1]||' '||w[2] as alias, coalesce(source,'none') as canonical, doc_id as priority from w where len(w)>1),
k as (select alias, arg_min({_clean('canonical')}, (priority, canonical)) as canonical, min(priority) as priority from a group by 1),
t as (select doc_id, {_clean('text')} as t from documents), u as (select distinct t, {_TOKENS.format('t')} as b from t where t<>''),
h as (select u.t, min(priority) as priority from u join k on contains(u.t, k.alias) and contains(u.b, replace('|'||k.alias||'|',' ','| |')) group by 1)
select t.doc_id, coalesce(e.canonical, i.canonical, md5(t.t)) as topic, coalesce(e.alias, i.alias) as alias from t left join k e on e.alias=t.t left join h on h.t=t.t left join k i on i.priority=h.priority""")
def topic_aliases(spark, sf_dir):
    """The first alias in each document; the aliases are the first two words of every document, for its source. Texts without an alias are shown as MD5."""
    docs = table(spark, sf_dir, "documents")
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    aliases = docs.select(w.alias("w"), F.coalesce("source", F.lit("none")).alias("canonical"), F.col("doc_id").alias("priority")).where(F.size("w") > 1).select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("alias"), "canonical", "priority")
    return L.normalize_topics(docs.select("doc_id", "text"), "text", aliases).select("doc_id", F.when(F.col("alias").isNull(), F.md5("topic")).otherwise(F.col("topic")).alias("topic"), "alias")


_SLUG = r"regexp_replace(regexp_replace(lower({}),'[^a-z0-9]+','-','g'),'^-+|-+$','','g')"


@query(f"""with r as (select p_partkey as reference, p_brand as brand, unnest(list_distinct([cast(p_partkey as varchar), p_name, lower(p_name), {_SLUG.format('p_name')}])) as key from part),
a as (select p_partkey as asked, p_brand as brand, case p_partkey%4 when 0 then cast(p_partkey as varchar) when 1 then p_name when 2 then upper(p_name) else replace(p_name,' ','_')||'!' end as said from part),
k as (select asked, brand, said, unnest([said, lower(said), {_SLUG.format('said')}]) as key, unnest([0,1,2]) as key_no from a),
b as (select asked, min((key_no, reference)) as b from k join r using (key, brand) group by 1)
select a.asked, a.brand, a.said, b[2] as reference, cast(b[1] as bigint) as key_no from a left join b using (asked)""")
def resolved_references(spark, sf_dir):
    """Parts asked for by id, name, name in capitals or a slug, within their brand."""
    part = table(spark, sf_dir, "part")
    name, key = F.col("p_name"), F.col("p_partkey")
    said = F.when(key % 4 == 0, key.cast("string")).when(key % 4 == 1, name).when(key % 4 == 2, F.upper(name)).otherwise(F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit("!")))
    asked = part.select(key.alias("asked"), F.col("p_brand").alias("brand"), said.alias("said"))
    references = part.select(key.alias("reference"), F.col("p_brand").alias("brand"), name.alias("name"))
    return L.resolve(asked, references, [F.col("said"), F.lower("said"), T.slug("said")], [F.col("reference"), F.col("name"), F.lower("name"), T.slug("name")], ["brand"], "reference")


@query("""with p as (select doc_id as probe_id, source, substr(text,11,12) as probe from documents where doc_id%20=0 and source is not null and substr(text,11,12)<>'')
select probe_id, d.doc_id from p join documents d on d.source=p.source and contains(d.text, p.probe) where d.text is not null group by all""")
def substring_search(spark, sf_dir):
    """Documents that hold twelve characters of a document of their source whose id is divisible by 20."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    probes = docs.where(F.col("doc_id") % 20 == 0).select("source", F.col("doc_id").alias("probe_id"), F.substring("text", 11, 12).alias("probe"))
    return L.substring_hits(docs, probes, ["source"]).where("hit").drop("hit")
