"""More registered queries: neighbours, runs, set differences, rankings, samples, projections and rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import knowledge as K
from quillspark.operators import retrieval as R
from quillspark.plans.queries import query, table


@query("""select conv_id, turn, array_to_string(list(coalesce(role,'')) over (partition by conv_id order by turn rows between 2 preceding and 2 following),'|') as near from conversations""")
def neighbour_context(spark, d):
    """Each turn with the roles of up to two turns before and after it."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"))
    return K.neighbours(rows, "conv_id", "turn", "role").select("conv_id", "turn", F.array_join("near", "|").alias("near"))


@query("""with e as (select user_id, event_id, ts, event_type, case when lag(event_type) over w=event_type then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as run_no from e)
select user_id, cast(run_no as bigint) as run_no, event_type, count(*) as n from r group by 1,2,3""")
def consecutive_runs(spark, d):
    """Runs of adjacent events of one kind for each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.lag("event_type").over(w) == F.col("event_type"), 0).otherwise(1)
    runs = table(spark, d, "events").withColumn("fresh", fresh).withColumn("run_no", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    return runs.groupBy("user_id", "run_no", "event_type").agg(F.count("*").alias("n"))


@query("""with t as (select conv_id, role, unnest(list_distinct(regexp_extract_all(lower(text),'[a-z0-9]{4,}'))) as term from conversations),
g as (select distinct conv_id, term from t where role='assistant'), s as (select distinct conv_id, term from t where role<>'assistant' or role is null),
m as (select g.conv_id, g.term, row_number() over (partition by g.conv_id order by g.term) as i from g left join s using (conv_id, term) where s.term is null)
select conv_id, count(*) as missing, array_to_string(list(term order by term) filter (i<=40),',') as terms from m group by 1""")
def unsupported_terms(spark, d):
    """Terms that only the answers of a conversation have, the first forty by name."""
    t = table(spark, d, "conversations").select("conv_id", "role", F.explode(F.array_distinct(T.tokens("text", "[a-z0-9]{4,}"))).alias("term"))
    said, asked = t.where("role = 'assistant'"), t.where("role <> 'assistant' or role is null")
    only = said.select("conv_id", "term").distinct().join(asked.select("conv_id", "term").distinct(), ["conv_id", "term"], "left_anti")
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("term"))
    return only.withColumn("i", i).groupBy("conv_id").agg(F.count("*").alias("missing"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("i") <= 40, F.col("term")))), ",").alias("terms"))


@query("""with l as (select l_orderkey, count(*) as parts, count(distinct l_linenumber) as numbers from lineitem group by 1)
select coalesce(o_orderstatus,'?') as status, count(*) as registered, count(*) filter (l.l_orderkey is null) as missing, count(*) filter (parts>numbers) as duplicated,
 case when count(*) filter (l.l_orderkey is null)>0 then 'FAILED' when count(*) filter (parts>numbers)>0 then 'WARNING' else 'OK' end as integrity from orders left join l on l_orderkey=o_orderkey group by 1""")
def archive_index_audit(spark, d):
    """Registered ids against the ids of their parts: missing and duplicated ones, by status."""
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("parts"), F.count_distinct("l_linenumber").alias("numbers"))
    o = table(spark, d, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = o.groupBy(F.coalesce("o_orderstatus", F.lit("?")).alias("status")).agg(F.count("*").alias("registered"), F.count_if(F.col("l_orderkey").isNull()).alias("missing"), F.count_if(F.col("parts") > F.col("numbers")).alias("duplicated"))
    return out.withColumn("integrity", F.when(F.col("missing") > 0, "FAILED").when(F.col("duplicated") > 0, "WARNING").otherwise("OK"))


@query("""with a as (select l_suppkey as k, count(*) as n, sum(case when l_returnflag='R' then 1 else 0 end) as back from lineitem group by 1),
b as (select l_suppkey as k, sum(case when l_linestatus='F' then 1 else 0 end) as done from lineitem group by 1), j as (select s_suppkey, coalesce(n,0) as n, coalesce(back,0) as back, coalesce(done,0) as done, s_acctbal from supplier left join a on a.k=s_suppkey left join b on b.k=s_suppkey),
s as (select s_suppkey, round(0.5*done/greatest(n,1)+0.3*(1-back/greatest(n,1))+case when s_acctbal>0 then 0.2 else 0 end,6) as score from j)
select s_suppkey, score, row_number() over (order by score desc, s_suppkey) as place from s qualify place<=100""")
def composite_ranking(spark, d):
    """Reports joined by key, ranked by a weighted score; the hundred best."""
    l = table(spark, d, "lineitem")
    counts = l.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("back"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    j = table(spark, d, "supplier").join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left").na.fill(0, ["n", "back", "done"])
    of = F.greatest("n", F.lit(1))
    score = F.round(0.5 * F.col("done") / of + 0.3 * (1 - F.col("back") / of) + F.when(F.col("s_acctbal") > 0, 0.2).otherwise(0.0), 6)
    best = j.select("s_suppkey", score.alias("score")).orderBy(F.desc("score"), "s_suppkey").limit(100)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "s_suppkey")).cast("long"))


@query(r"""with c as (select source, lang, text, len(regexp_extract_all(text,'[A-Za-z0-9]+')) as n, sha256(trim(regexp_replace(lower(text),'\s+',' ','g'))) as h from documents where text is not null)
select source, lang, count(*) as chunks, count(distinct h) as unique_chunks, round(1-count(distinct h)/count(*),6) as duplicate_ratio, min(n) as least, max(n) as most, round(avg(n),6) as mean from c group by 1,2""")
def metrics_by_chapter(spark, d):
    """Corpus metrics of each source and language."""
    c = table(spark, d, "documents").where("text is not null").select("source", "lang", T.word_count("text").cast("long").alias("n"), T.content_hash("text").alias("h"))
    unique = F.count_distinct("h")
    return c.groupBy("source", "lang").agg(F.count("*").alias("chunks"), unique.alias("unique_chunks"), F.round(1 - unique / F.count("*"), 6).alias("duplicate_ratio"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("""with r as (select source, doc_id, row_number() over (partition by source order by md5(doc_id||':7'), doc_id) as place from documents) select source, doc_id, place from r where place<=20""")
def seeded_sample(spark, d):
    """Twenty documents of each source, drawn by a seeded hash."""
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).cast("long").alias("place")).where("place <= 20")


@query("""select o_orderkey, cast(floor(o_totalprice*100) as bigint) as bytes, round(floor(o_totalprice*100)*8/(5*1000*1000),6) as eta_seconds, cast(case o_orderstatus when 'F' then 100 when 'P' then 50 else 0 end as double) as progress from orders""")
def transfer_eta(spark, d):
    """Time left of each transfer at 5 Mbit/s and its progress."""
    size = F.floor(F.col("o_totalprice") * 100)
    progress = F.when(F.col("o_orderstatus") == "F", 100.0).when(F.col("o_orderstatus") == "P", 50.0).otherwise(0.0)
    return table(spark, d, "orders").select("o_orderkey", size.cast("long").alias("bytes"), F.round(size * 8 / F.lit(5_000_000), 6).alias("eta_seconds"), progress.alias("progress"))


@query("""with m as (select max(ts) as now from events) select event_type, count(*) as n, count(distinct user_id) as users, sum(case when value is null then 1 else 0 end) as without_value, max(ts) as last from events, m where ts>now-interval 6 hour group by 1""")
def recent_by_type(spark, d):
    """Events of the last six hours by kind."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now), F.expr("ts > now - interval 6 hours")).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value").isNull()).alias("without_value"), F.max("ts").alias("last"))


@query("""select doc_id, 'grade '||coalesce(lang,'unknown')||' subject '||coalesce(source,'general')||' length '||case when coalesce(n_chars,0)<1000 then 'short' when n_chars<10000 then 'medium' else 'long' end as prefix from documents""")
def embedding_prefix(spark, d):
    """The line of metadata, with defaults, that goes before a text to be embedded."""
    n = F.coalesce("n_chars", F.lit(0))
    size = F.when(n < 1000, "short").when(n < 10000, "medium").otherwise("long")
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("grade "), F.coalesce("lang", F.lit("unknown")), F.lit(" subject "), F.coalesce("source", F.lit("general")), F.lit(" length "), size).alias("prefix"))


@query("""with p as (select p_partkey, p_brand, p_type, p_size, p_retailprice, row_number() over (partition by p_brand, p_type order by p_size desc, p_partkey) as i from part), f as (select p_brand, p_type, p_partkey as first_part from p where i=1)
select p.p_partkey, coalesce(f.first_part, 0) as first_part, p.p_partkey<>f.first_part as related from p join f using (p_brand, p_type)""")
def related_by_key(spark, d):
    """Each part with the leading part of its brand and type."""
    p = table(spark, d, "part")
    lead = p.groupBy("p_brand", "p_type").agg(F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("first_part"))
    return p.join(lead, ["p_brand", "p_type"]).select("p_partkey", "first_part", (F.col("p_partkey") != F.col("first_part")).alias("related"))


@query("""with h as (select conv_id as query_id, turn as doc_id, cast(length(coalesce(text,''))%100 as double)/100 as score, 'dense' as source from conversations union all select conv_id, turn, cast(length(coalesce(text,''))%37 as double)/100, 'lexical' from conversations where role='assistant')
select query_id, doc_id, max(score) as score, array_to_string(list_sort(list(distinct source)),'|') as sources from h group by 1,2""")
def merged_hits(spark, d):
    """Hits of two searches merged: best score and all sources of each."""
    c = table(spark, d, "conversations").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    hit = lambda rows, by, source: rows.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("doc_id"), ((F.col("n") % by).cast("double") / 100).alias("score"), F.lit(source).alias("source"))
    return R.merge_hits(hit(c, 100, "dense"), hit(c.where("role = 'assistant'"), 37, "lexical"))
