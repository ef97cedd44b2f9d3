"""Registered queries over records and scalar rules: upserts, retention, retries, scripts, keys, versions and quizzes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import analytics as A
from quillspark.operators import audit as U
from quillspark.operators import knowledge as K
from quillspark.operators import retrieval as R
from quillspark.plans import queries as Q
from quillspark.plans.queries import ORACLE_SQL, query, table

_BOTH = "with old as (select p_partkey as pack_id, cast(p_size as double) as held from part), new as (select l_partkey as pack_id, max(l_quantity) as held from lineitem where l_returnflag='R' group by 1)"


def _registries(spark, sf_dir):
    """A registry of parts, and what returned items say of some of them."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pack_id"), F.col("p_size").cast("double").alias("held"))
    return old, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("pack_id")).agg(F.max("l_quantity").alias("held"))


@query(f"{_BOTH} select * from new union all select * from old where pack_id not in (select pack_id from new)")
def registry_upserts(spark, sf_dir):
    """The registry with newer records in place of those of equal key."""
    return A.upsert(*_registries(spark, sf_dir), ["pack_id"])


@query(f"{_BOTH} select * from new union all select * from old where pack_id not in (select pack_id from new)")
def ignored_inserts(spark, sf_dir):
    """Returned items' records, and those of the registry whose key they don't have."""
    old, new = _registries(spark, sf_dir)
    return A.insert_or_ignore(new, old, ["pack_id"])


@query("""with n as (select max(o_orderdate) as now from orders) select o_orderkey from orders, n where o_orderstatus='F' and o_orderdate < now - interval 365 day""")
def expired_records(spark, sf_dir):
    """Finished orders more than a year older than the newest order."""
    orders = table(spark, sf_dir, "orders")
    items = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"), F.col("o_orderdate").alias("updated_at"))
    now = orders.agg(F.max("o_orderdate").alias("now"))  # one row
    return U.expired(items.join(F.broadcast(now)), F.col("now"), 365).select("o_orderkey")


@query("""with t as (select user_id, count(*) filter (event_type='error')%5 as retries, max(value) as priority, min(ts) as created_at, max_by(event_type, (ts, event_id)) as last from events group by 1)
select user_id, cast(retries as bigint) as retries, priority from t where last='error' and retries<3""")
def retry_queue(spark, sf_dir):
    """Users whose last event is an error and may be tried again, of high value and old first."""
    t = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") % 5).alias("retries"), F.max("value").alias("priority"), F.min("ts").alias("created_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return U.interrupted(t.withColumn("status", F.when(F.col("last") == "error", "failed").otherwise("done"))).select("user_id", "retries", "priority")


@query(r"""with l as (select doc_id, unnest(list_distinct(list_filter(list_transform(string_split(text,chr(10)), lambda x: regexp_replace(x,'^\s+|\s+$','','g')), lambda x: x<>''))) as formula from documents)
select doc_id, formula from l where regexp_matches(formula,'[=+*/^]') and length(formula)<180""")
def formula_lines(spark, sf_dir):
    """Distinct short lines of documents with a sign of a formula."""
    return K.formulas(table(spark, sf_dir, "documents"))


_BLOCKS = (("kn", "Kannada", "ಀ-೿"), ("hi", "Devanagari", "ऀ-ॿ"), ("ta", "Tamil", "஀-௿"), ("te", "Telugu", "ఀ-౿"))
_SCRIPT = " ".join(f"when regexp_matches(text,'[{b}]') then '{c}:{n}'" for c, n, b in _BLOCKS)


@query(rf"""select doc_id, case {_SCRIPT} when regexp_matches(text,'[A-Za-z]') then 'en:Latin' else 'unknown:unknown' end as script, length(t) as n_chars, md5(t) as cleaned from
(select doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,chr(160)||'|[\x00-\x08\x0b\x0c\x0e-\x1f]',' ','g'),'[ \t]+',' ','g'),'(\w)-\n(\w)','\1\2','g'),'\n{{3,}}',chr(10)||chr(10),'g'),'^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$','','g') as t from documents) where text is not null""")
def scripts_and_breaks(spark, sf_dir):
    """The script of each document, and its text with mended breaks as length and MD5."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    s, t = T.script_language("text"), T.clean_breaks("text")
    return docs.select("doc_id", F.concat_ws(":", s["language"], s["script"]).alias("script"), F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("cleaned"))


@query("""with w as (select item_id, regexp_extract_all(lower(text),'[a-z0-9]+') as w from benchmark), g as (select item_id, list_concat(list_concat(
 case when len(w)>=3 then list_transform(range(1,len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2]) else [] end, case when len(w)>=2 then list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1]) else [] end), w) as f from w),
u as (select item_id, unnest(f) as f, unnest(range(len(f))) as i from g), d as (select item_id, f, min(i) as i from u group by 1,2), r as (select *, row_number() over (partition by item_id order by i) as n from d)
select item_id, string_agg(f,'|' order by n) as fragments from r where n<=24 group by 1""")
def question_fragments(spark, sf_dir):
    """The first 24 distinct word n-grams of each benchmark item, wide ones first."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.fragments("text"), "|").alias("fragments")).where("fragments <> ''")


@query("""select p_partkey, 'sha256:'||sha256('{"p_brand":"'||p_brand||'","p_name":"'||p_name||'","p_size":'||p_size||'}') as checksum, 'retrieval:'||substr(sha256(lower(p_name)),1,16)||':'||substr(sha256(p_brand),1,8) as cache_key,
 case when p_size<=5 then 'easy' when p_size<=8 then 'medium' else 'hard' end as difficulty from part""")
def record_keys(spark, sf_dir):
    """Checksums of parts as JSON with sorted keys, cache keys, and the difficulty of their size as a grade."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", T.checksum({c: F.col(c) for c in ("p_name", "p_size", "p_brand")}).alias("checksum"), T.cache_key("p_name", F.col("p_brand")).alias("cache_key"), T.difficulty(F.col("p_size")).alias("difficulty"))


@query("""with v as (select p_brand, p_size, p_partkey%12 as minor, p_partkey%7 as patch from part), m as (select p_brand, max((p_size, minor, patch)) as v, count(*) as versions from v where p_size%10<>9 group by 1)
select p_brand, v[1] as major, cast(v[2] as int) as minor, cast(v[3] as int) as patch, versions from m""")
def latest_versions(spark, sf_dir):
    """The latest version of each brand; texts that are no versions have no part in it."""
    key = F.col("p_partkey")
    said = F.when(F.col("p_size") % 10 == 9, F.concat(F.lit("beta "), F.col("p_size"))).otherwise(F.concat_ws(".", F.concat(F.lit("v"), F.col("p_size")), key % 12, key % 7))
    v = table(spark, sf_dir, "part").select("p_brand", T.semver(said).alias("v")).where("v is not null")
    return v.groupBy("p_brand").agg(F.max("v").alias("v"), F.count("*").alias("versions")).select("p_brand", "v.major", "v.minor", "v.patch", "versions")


@query(f"""with gl as ({ORACLE_SQL['definition_glossary']}), o as (select *, list(term) over (partition by source order by term_key rows between 1 following and 3 following) as others from gl)
select source, 'Which term means: '||definition||'?' as question, array_to_string(list_sort(list_concat([term], coalesce(others,[]))),'|') as options, term as answer from o""")
def glossary_quizzes(spark, sf_dir):
    """A question for each entry of a source's glossary, with the next three terms as wrong answers."""
    return K.quizzes(K.glossary(table(spark, sf_dir, "documents"), ["source"]), ["source"]).withColumn("options", F.array_join("options", "|"))


_KIND = r"case when regexp_matches(lt,'\b(is defined as|definition|refers to)\b') then 'definition' when regexp_matches(lt,'formula|[a-z]\s*=\s*[a-z0-9]') then 'formula' when regexp_matches(lt,'\b(for example|example)\b') then 'example' when regexp_matches(lt,'\b(experiment|activity|procedure)\b') then 'experiment' when regexp_matches(lt,'\b(question|answer)\b|\?') then 'qa' else 'explanation' end"
_WORTH = "case kind " + " ".join(f"when '{k}' then {v}e0" for k, v in R.WORTH.items()) + f" else {R.OTHER_WORTH}e0 end"
_ASKED = ",".join(f"case when kind='{k}' and regexp_matches(lower(query),'{w}') then {v}e0 else 0e0 end" for k, (w, v) in R.ASKED_FOR.items())


@query(rf"""with {Q._BM25}, h as (select query_id, doc_id, round(raw,10) as bm25 from bm qualify row_number() over (partition by query_id order by round(raw,10) desc, doc_id)<=20),
j as (select h.*, b.text as query, d.text, lower(d.text) as lt, d.lang, d.source from h join benchmark b on b.item_id=h.query_id join documents d on d.doc_id=h.doc_id),
k as (select *, {_KIND} as kind, {Q._CONTENT.format('query')} as a, {Q._CONTENT.format('text')} as b from j),
e as (select *, 0.40e0*case lang when 'en' then 1e0 when 'de' then 0.75e0 when 'fr' then 0.6e0 else 0e0 end+0.20e0*(source is not distinct from 'src0')::double+0.15e0*(lang is not distinct from 'en')::double
 +0.25e0*greatest({_WORTH}, case when kind='formula' and len(regexp_extract_all(text,'[A-Za-z0-9]+'))>=50 and length(text)>=220 then {R.LONG_FORMULA}e0 else 0e0 end, {_ASKED}) as education from k),
s as (select query_id, doc_id, text, round(0.35e0*greatest(0e0,least(1e0,bm25/20))+0.35e0*(len(list_intersect(a,b))/greatest(len(a),1))+0.30e0*education+case when length(text)<2000 then 0.08e0 else 0e0 end,6) as final_score from e),
c as (select query_id, doc_id, final_score from s where final_score>=0.25 qualify row_number() over (partition by query_id, {Q._NORM.format('substr(text,1,500)')} order by final_score desc, doc_id)=1)
select *, row_number() over (partition by query_id order by final_score desc, doc_id) as rank from c qualify rank<=5""")
def reranked_hits(spark, sf_dir):
    """The five best of each benchmark item's twenty lexical hits by what they teach, once a text: topics are languages, chapters sources, and short documents are at hand."""
    docs, questions = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = R.top_hits(R.bm25(docs, questions.withColumnRenamed("query", "text"), places=10), "bm25", 20).drop("rank")
    rows = hits.join(docs.select("doc_id", "text", "lang", "source"), "doc_id").join(questions, "query_id")
    band = R.topic_band(F.array(F.lit("en")), F.array(F.coalesce("lang", F.lit(""))), F.array(F.lit("de")), F.array(F.lit("fr")))
    rows = rows.withColumns({"score": F.col("bm25") / 20, "chunk_type": K.first_class(F.col("text")), "topic_score": band, "chapter_match": F.col("source").eqNullSafe("src0"), "subject_match": F.col("lang").eqNullSafe("en"), "local": F.length("text") < 2000})
    return R.rerank(rows, 5).select("query_id", "doc_id", "final_score", "rank")
