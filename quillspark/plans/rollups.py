"""More registered queries: scans, counters, overlays and orders of curricula, caches and devices, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.plans.queries import query, table

#: Kinds of cards in the order in which they are tested, and patterns of their lower-cased text.
CARD_TYPES = (("Formula", "[=+^]"), ("Cause-Effect", "because|why|cause|effect"), ("Definition", "what is|define|meaning"), ("Concept", "how|explain"))


@query("""select source, count(*) as files, count(distinct lang) as languages, array_to_string(list_sort(list(distinct lang)),',') as language_list, cast(sum(coalesce(n_chars,0)) as bigint) as chars from documents group by 1""")
def scan_rollup(spark, d):
    """Files, languages and size of each source."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.count_distinct("lang").alias("languages"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("language_list"), F.sum(F.coalesce("n_chars", F.lit(0))).cast("long").alias("chars"))


@query("""with g as (select event_type, count(*) as entries, round(coalesce(sum(value),0),2) as used from events group by 1) select event_type, entries, used, round(100*entries/sum(entries) over (),6) as utilisation from g""")
def category_utilisation(spark, d):
    """Entries and sizes of each category and its share of all entries in percent."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("entries"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("used"))
    total = F.sum("entries").over(Window.partitionBy())  # over one row for each category
    return g.select("event_type", "entries", "used", F.round(100 * F.col("entries") / total, 6).alias("utilisation"))


@query("""select o_orderpriority, count(*) as transfers, count(*) filter (o_orderstatus='F') as completed, count(*) filter (o_orderstatus='P') as pending, count(*) filter (o_orderstatus='O') as opened,
 round(count(*) filter (o_orderstatus='F')/count(*),6) as success_rate from orders group by 1""")
def distribution_metrics(spark, d):
    """Transfers by status for each priority, and the share of completed ones."""
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("transfers"), of("F").alias("completed"), of("P").alias("pending"), of("O").alias("opened"), F.round(of("F") / F.count("*"), 6).alias("success_rate"))


@query("""select n_name, count(c_custkey) as devices, count(*) filter (c_acctbal>0) as online, round(case when count(c_custkey)>0 then 100*count(*) filter (c_acctbal>0)/count(c_custkey) else 0 end,6) as online_percent from nation left join customer on c_nationkey=n_nationkey group by 1""")
def online_share(spark, d):
    """Devices of each classroom and the percentage that is online; 0 without devices."""
    j = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    online, devices = F.count_if(F.col("c_acctbal") > 0), F.count("c_custkey")
    return j.groupBy("n_name").agg(devices.alias("devices"), online.alias("online"), F.round(F.when(devices > 0, 100 * online / devices).otherwise(0.0), 6).alias("online_percent"))


@query("""select event_id, coalesce(try_cast(json_extract_string(case when json_valid(props) then props else '{}' end,'$.k') as bigint),0) as k, coalesce(json_valid(props),false) as valid from events""")
def json_defaults(spark, d):
    """A key of a JSON column; text that is null or no JSON counts as an empty object."""
    parsed = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(parsed, "$.k", "long"), F.lit(0).cast("long")).alias("k"), parsed.isNotNull().alias("valid"))


@query("""with g as (select p_brand, p_type, cast(sum(p_size) as bigint) as score from part group by 1,2), r as (select *, row_number() over (partition by p_brand order by score desc, p_type) as i from g) select p_brand, p_type as profile, score from r where i=1""")
def best_profile(spark, d):
    """The profile of each brand with the largest sum of scores, the first by name of equal ones."""
    g = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").cast("long").alias("score"))
    top = g.groupBy("p_brand").agg(F.max("score").alias("score"))
    return g.join(top, ["p_brand", "score"]).groupBy("p_brand", "score").agg(F.min("p_type").alias("profile"))


@query("""select role, case when regexp_matches(lower(text),'[=+^]') then 'Formula' when regexp_matches(lower(text),'because|why|cause|effect') then 'Cause-Effect' when regexp_matches(lower(text),'what is|define|meaning') then 'Definition' when regexp_matches(lower(text),'how|explain') then 'Concept' else 'Fact' end as kind, count(*) as n from conversations group by 1,2""")
def card_types(spark, d):
    """Kinds of cards by ordered patterns of their text, counted for each role."""
    kind = F.lit("Fact")
    for name, pattern in reversed(CARD_TYPES):
        kind = F.when(F.lower("text").rlike(pattern), name).otherwise(kind)
    return table(spark, d, "conversations").groupBy("role", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""with f as (select source, lang, min(doc_id) as first_seen, count(*) as chunks from documents group by 1,2) select source, lang as chapter, chunks, dense_rank() over (partition by source order by first_seen) as chapter_number from f""")
def curriculum_tree(spark, d):
    """Chapters of each source, numbered in the order in which they are first seen."""
    f = table(spark, d, "documents").groupBy("source", F.col("lang").alias("chapter")).agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("chunks"))
    number = F.dense_rank().over(Window.partitionBy("source").orderBy(F.col("first_seen").asc_nulls_last()))
    return f.select("source", "chapter", "chunks", number.cast("long").alias("chapter_number"))


@query("""select page_id, case when regexp_matches(url,'/(de|german)/') then 'de' when regexp_matches(url,'/(fr|french)/') then 'fr' when regexp_matches(url,'/(es|spanish)/') then 'es' when regexp_matches(url,'/(en|english)/') then 'en' else 'unknown' end as language from pages""")
def path_language(spark, d):
    """The language that a path names."""
    language = F.lit("unknown")
    for code, name in (("en", "english"), ("es", "spanish"), ("fr", "french"), ("de", "german")):
        language = F.when(F.col("url").rlike(f"/({code}|{name})/"), code).otherwise(language)
    return table(spark, d, "pages").select("page_id", language.alias("language"))


@query("""select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority like '1-%' desc, o_orderkey desc) as place from orders""")
def sync_priority(spark, d):
    """The order in which each device is brought up to date: matching items first, then the latest put in."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderpriority").like("1-%").desc(), F.desc("o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("""with l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) select d.doc_id, cast(coalesce(l.quality,0) as bigint) as quality, cast(coalesce(l.toxic,0) as bigint) as toxic, coalesce(lang,'unknown') as lang, l.doc_id is not null as labelled from documents d left join l on l.doc_id=d.doc_id""")
def metadata_overlay(spark, d):
    """Documents with the metadata of a second table laid over defaults."""
    l = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"), F.lit(True).alias("labelled"))
    j = table(spark, d, "documents").select("doc_id", "lang").join(l, "doc_id", "left")
    return j.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("quality", "toxic")], F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("""select source, count(*) as packs, count(*) filter (l.doc_id is null) as without_manifest, count(*) filter (v.vec_id is null) as without_archive, count(*) filter (l.doc_id is not null and v.vec_id is not null) as complete
from documents d left join (select distinct doc_id from labels) l on l.doc_id=d.doc_id left join (select distinct vec_id from embeddings) v on v.vec_id=d.doc_id group by 1""")
def inventory_audit(spark, d):
    """Registered documents of each source that have no label or no vector."""
    l = table(spark, d, "labels").select("doc_id", F.lit(True).alias("manifest")).distinct()
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("archive")).distinct()
    j = table(spark, d, "documents").select("source", "doc_id").join(l, "doc_id", "left").join(v, "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("packs"), F.count_if(F.col("manifest").isNull()).alias("without_manifest"), F.count_if(F.col("archive").isNull()).alias("without_archive"), F.count_if(F.col("manifest") & F.col("archive")).alias("complete"))


@query("""select p_partkey, p_brand from part where contains(lower(p_name),'steel') or contains(lower(p_type),'steel') or contains(lower(p_brand),'steel') or contains(lower(p_name),'widget')""")
def topic_match(spark, d):
    """Parts any of whose texts holds one of the topics."""
    holds = lambda c, topic: F.contains(F.lower(c), F.lit(topic))
    return table(spark, d, "part").where(holds("p_name", "steel") | holds("p_type", "steel") | holds("p_brand", "steel") | holds("p_name", "widget")).select("p_partkey", "p_brand")


@query("""select s_suppkey, n_name from supplier join nation on n_nationkey=s_nationkey where s_acctbal>0 and s_name<>'' and n_regionkey in (0,1,2) and s_suppkey in (select l_suppkey from lineitem where l_quantity>0)""")
def certified_suppliers(spark, d):
    """Suppliers that meet every rule: region, balance, name and some delivery."""
    s = table(spark, d, "supplier").where("s_acctbal > 0 and s_name <> ''").join(table(spark, d, "nation").where(F.col("n_regionkey").isin(0, 1, 2)), F.col("n_nationkey") == F.col("s_nationkey"))
    delivered = table(spark, d, "lineitem").where("l_quantity > 0").select(F.col("l_suppkey").alias("s_suppkey"))
    return s.join(delivered, "s_suppkey", "left_semi").select("s_suppkey", "n_name")
