"""Registered queries: payload checks, broadcasts, ordered resolution, inventories and stable ids, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.plans.queries import query, table


@query("""select c_custkey, p.p_brand, count(*) as deliveries from customer join orders on o_custkey=c_custkey join lineitem on l_orderkey=o_orderkey join part p on p_partkey=l_partkey where c_acctbal>0 group by 1,2""")
def classroom_broadcast(spark, d):
    """Deliveries of each brand to each device that is online."""
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return l.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")).groupBy("c_custkey", "p_brand").agg(F.count("*").alias("deliveries"))


@query("""with v as (select event_id, event_type, props, json_valid(props) as ok, json_extract_string(case when json_valid(props) then props else '{}' end,'$.k') as k from events)
select event_type, count(*) as entries, count(*) filter (props is null) as missing, count(*) filter (props is not null and not ok) as bad_json, count(*) filter (ok and coalesce(k,'')='') as empty_payloads,
 round(count(*) filter (ok)/count(*),6) as coverage, round(count(*) filter (ok and coalesce(k,'')<>'')/count(*),6) as filled_coverage from v group by 1""")
def artifact_inventory(spark, d):
    """Artifacts of each kind: missing, not JSON, with an empty payload, and their coverage."""
    v = F.try_parse_json("props")
    e = table(spark, d, "events").select("event_type", "props", v.isNotNull().alias("ok"), F.coalesce(F.try_variant_get(v, "$.k", "string"), F.lit("")).alias("k"))
    ok, n = F.col("ok"), F.count("*")
    return e.groupBy("event_type").agg(n.alias("entries"), F.count_if(F.col("props").isNull()).alias("missing"), F.count_if(F.col("props").isNotNull() & ~ok).alias("bad_json"), F.count_if(ok & (F.col("k") == "")).alias("empty_payloads"),
        F.round(F.count_if(ok) / n, 6).alias("coverage"), F.round(F.count_if(ok & (F.col("k") != "")) / n, 6).alias("filled_coverage"))


@query("""select source, lang, count(*) as packs, cast(sum(coalesce(n_chars,0)) as bigint) as bytes, round(avg(coalesce(n_chars,0)),6) as mean_size, count(*) filter (n_chars is distinct from length(text)) as mismatches, min(n_chars) as least, max(n_chars) as most from documents group by 1,2""")
def selective_sync_audit(spark, d):
    """Sizes of the packs of each source and language, and how many don't keep to their declared length."""
    n = F.coalesce("n_chars", F.lit(0))
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("packs"), F.sum(n).cast("long").alias("bytes"), F.round(F.avg(n), 6).alias("mean_size"), F.count_if(~F.col("n_chars").eqNullSafe(F.length("text"))).alias("mismatches"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""select doc_id, left(sha256(left(coalesce(text,''),4000)||'|'||coalesce(lang,'')||'|'||coalesce(source,'')),24) as chunk_id from documents""")
def stable_chunk_ids(spark, d):
    """Ids of chunks from the head of the text, as the id is defined, and the metadata."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat(F.substring(blank("text"), 1, 4000), F.lit("|"), blank("lang"), F.lit("|"), blank("source")), 256), 1, 24).alias("chunk_id"))


@query("""with m as (select max(o_orderdate) as now from orders) select o_orderkey, cast(epoch_ms(now)-epoch_ms(o_orderdate) as bigint) as duration_ms, strftime(o_orderdate,'%Y-%m-%dT%H:%M:%SZ') as started from orders, m""")
def run_durations(spark, d):
    """Time from each start to the last one, and the start as an ISO text read back with its zone."""
    o = table(spark, d, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    now = o.agg(F.max("o_orderdate").alias("now"))  # one row
    return o.join(F.broadcast(now)).select("o_orderkey", (F.unix_millis(F.col("now").cast("timestamp")) - F.unix_millis(F.to_timestamp(iso))).alias("duration_ms"), iso.alias("started"))


@query("""with b as (select conv_id, role, turn, text, row_number() over (partition by conv_id, role order by turn) as i from conversations)
select conv_id, role, count(*) as items, array_to_string(list(cast(turn as varchar) order by turn),',') as turns from b where i<=case role when 'assistant' then 3 else 5 end group by 1,2""")
def search_bundle(spark, d):
    """The first items of each kind, with a limit for each kind."""
    i = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    few = table(spark, d, "conversations").select("conv_id", "role", "turn", i.alias("i")).where("i <= 5").where(F.col("i") <= F.when(F.col("role") == "assistant", 3).otherwise(5))
    g = few.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list("turn")).alias("t"))  # five turns at most
    return g.select("conv_id", "role", F.size("t").cast("long").alias("items"), F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("turns"))
