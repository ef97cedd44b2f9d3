"""Registered queries over the given tables, with the same query in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import analytics as A
from quillspark.operators import corpus as C
from quillspark.operators import knowledge as K
from quillspark.operators import quality as Q
from quillspark.operators import retrieval as R
from quillspark.sources import files as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("student_id"), F.col("o_orderpriority").alias("experiment_id"), status.alias("status"), F.floor(F.col("o_totalprice") * 10).cast("long").alias("duration_ms"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_extendedprice").alias("score"), (100 * (1 - F.col("l_discount"))).alias("completion"))


_RUNS_SQL = """runs as (select o_orderkey as run_id, o_custkey as student_id, o_orderpriority as experiment_id,
 case o_orderstatus when 'F' then 'completed' when 'P' then 'failed' else 'running' end as status,
 cast(floor(o_totalprice*10) as bigint) as duration_ms from orders),
results as (select l_orderkey as run_id, l_extendedprice as score, 100*(1-l_discount) as completion from lineitem),
j as (select r.*, s.score, s.completion from runs r left join results s on r.run_id=s.run_id)"""
_STATS_SQL = """count(run_id) as total_runs, count(*) filter (status='completed') as completed_runs,
 count(*) filter (status='failed') as failed_runs, count(*) filter (status in ('created','running','paused')) as active_runs,
 round(avg(score),6) as average_score, round(avg(completion),6) as average_completion,
 round(avg(duration_ms),6) as average_duration_ms, cast(coalesce(sum(duration_ms),0) as bigint) as total_time_spent_ms"""


@query(f"with {_RUNS_SQL} select student_id, {_STATS_SQL} from j group by student_id")
def student_run_stats(spark, d):
    return A.run_stats(_runs(spark, d), _results(spark, d), ["student_id"], places=6)


@query(f"with {_RUNS_SQL} select experiment_id, {_STATS_SQL}, count(distinct student_id) as unique_students from j group by experiment_id")
def experiment_stats_distinct(spark, d):
    return A.run_stats(_runs(spark, d), _results(spark, d), ["experiment_id"], students=True, places=6)


@query(f"with {_RUNS_SQL} select {_STATS_SQL}, count(distinct student_id) as unique_students, (select count(*) from events) as total_events, (select count(*) from lineitem) as total_results from j")
def system_stats(spark, d):
    stats = A.run_stats(_runs(spark, d), _results(spark, d), [], students=True, places=6)
    events = table(spark, d, "events").agg(F.count("*").alias("total_events"))
    results = table(spark, d, "lineitem").agg(F.count("*").alias("total_results"))
    return stats.join(F.broadcast(events)).join(F.broadcast(results))  # one row each


@query(f"""with runs as (select o_orderkey as run_id, o_custkey as experiment_id, case o_orderstatus when 'F' then 1.0 else 0.0 end as done from orders),
j as (select r.*, l_extendedprice as score from runs r left join lineitem on run_id=l_orderkey)
select experiment_id, count(run_id) as run_count, round(avg(done)*100,4) as completion_rate, round(avg(score),2) as average_score
from j group by experiment_id order by run_count desc, completion_rate desc, experiment_id limit 20""")
def top_experiments(spark, d):
    runs = _runs(spark, d).drop("experiment_id").withColumnRenamed("student_id", "experiment_id")
    return A.top_experiments(runs, _results(spark, d), "experiment_id", 20)


@query("""select 'results without run' as kind, count(*) as orphans from lineitem where not exists (select 1 from orders where o_orderkey=l_orderkey)
union all select 'runs without student', count(*) from orders where not exists (select 1 from customer where c_custkey=o_custkey)
union all select 'results without part', count(*) from lineitem where not exists (select 1 from part where p_partkey=l_partkey)
union all select 'students without run', count(*) from customer where not exists (select 1 from orders where o_custkey=c_custkey)""")
def orphan_scan(spark, d):
    lineitem, orders, customer = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    found = A.orphans(lineitem, orders, "l_orderkey", "o_orderkey", "results without run")
    found = found.union(A.orphans(orders, customer, "o_custkey", "c_custkey", "runs without student"))
    found = found.union(A.orphans(lineitem, table(spark, d, "part"), "l_partkey", "p_partkey", "results without part"))
    return found.union(A.orphans(customer, orders, "c_custkey", "o_custkey", "students without run"))


@query("""with f as (select p_partkey, p_name, p_brand, p_size from part where contains(lower(p_name||' '||p_brand||' '||p_type),'1') and p_size between 5 and 40)
select p_partkey, p_name, p_brand, p_size, (select count(*) from f) as total, 2 as page, 10 as page_size from f order by p_size, p_partkey limit 10 offset 10""")
def registry_faceted_search(spark, d):
    part = table(spark, d, "part")
    found = part.where(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("1")) & F.col("p_size").between(5, 40))
    return A.paginate(found.select("p_partkey", "p_name", "p_brand", "p_size"), [F.col("p_size"), F.col("p_partkey")], 2, 10).drop("place")


@query("""select r_name as grade, n_name as subject, count(*) as packs, count(*) filter (s_acctbal > 0) as installable, round(sum(s_acctbal),2) as balance
from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by rollup(r_name, n_name)""")
def coverage_rollup(spark, d):
    supplier, nation, region = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    named = joined.select(F.col("r_name").alias("grade"), F.col("n_name").alias("subject"), "s_acctbal")
    return named.rollup("grade", "subject").agg(F.count("*").alias("packs"), A.count_where(F.col("s_acctbal") > 0).alias("installable"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("select lang, source, count(*) as documents, cast(sum(n_chars) as bigint) as chars from documents group by cube(lang, source)")
def metadata_cube(spark, d):
    return table(spark, d, "documents").cube("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("""with h as (select p_partkey as pack_id, p_size as host_version, cast(floor(p_retailprice*100) as bigint) as bytes from part where p_partkey%3<>0),
c as (select p_partkey as pack_id, p_size - cast(p_partkey%5=0 as int) as client_version from part where p_partkey%4<>0)
select coalesce(h.pack_id,c.pack_id) as pack_id, host_version, bytes, client_version, a.action,
 case when a.action in ('add','update') then bytes else 0 end as download_bytes
from h full join c on h.pack_id=c.pack_id, lateral (select case when client_version is null then 'add' when host_version is null then 'remove' when host_version<>client_version then 'update' else 'keep' end as action) a""")
def catalog_delta(spark, d):
    part = table(spark, d, "part")
    host = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("pack_id"), F.col("p_size").alias("version"), F.floor(F.col("p_retailprice") * 100).cast("long").alias("bytes"))
    client = part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("pack_id"), (F.col("p_size") - (F.col("p_partkey") % 5 == 0).cast("int")).alias("version"))
    return A.catalog_delta(host, client)


@query("select p_brand, p_partkey, p_retailprice, p_size from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_size desc, p_partkey) as rn from part) where rn=1")
def best_pack_per_key(spark, d):
    best = A.latest_per_key(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.desc("p_size"), F.col("p_partkey")])
    return best.select("p_brand", "p_partkey", "p_retailprice", "p_size")


@query("select doc_id, source, turn from (select doc_id, source, row_number() over (partition by source order by doc_id) as turn from documents) order by turn, source limit 50")
def stratified_sample(spark, d):
    return A.round_robin_sample(table(spark, d, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], 50)


@query("""select o_custkey, o_orderkey, row_number() over w as version_no, o_totalprice, lag(o_totalprice) over w as previous, round(o_totalprice-lag(o_totalprice) over w,2) as delta
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def version_history_delta(spark, d):
    return A.version_deltas(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "version_no", "o_totalprice", "previous", "delta")


@query("""with l as (select user_id, event_id, event_type, value, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events)
select user_id, event_id as last_event, event_type as last_type, value as last_value from l where rn=1""")
def latest_state_per_user(spark, d):
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("l")
    return table(spark, d, "events").groupBy("user_id").agg(last).select("user_id", F.col("l.event_id").alias("last_event"), F.col("l.event_type").alias("last_type"), F.col("l.value").alias("last_value"))


@query("""with m as (select max(ts) as now from events), e as (select events.* from events, m where ts >= now - interval 24 hours)
select count(*) as events, count(*) filter (event_type<>'error') as successful, round(100.0*count(*) filter (event_type<>'error')/count(*),4) as success_rate,
 round(sum(value)/greatest(count(*) filter (event_type<>'error'),1),4) as value_per_success from e""")
def lookback_success_rate(spark, d):
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))  # one row
    recent = events.join(F.broadcast(now)).where(F.col("ts") >= F.col("now") - F.expr("interval 24 hours"))
    good = F.count_if(F.col("event_type") != "error")
    return recent.agg(F.count("*").alias("events"), good.alias("successful"), F.round(100.0 * good / F.count("*"), 4).alias("success_rate"), F.round(F.sum("value") / F.greatest(good, F.lit(1)), 4).alias("value_per_success"))


@query("""select cast(epoch(date_trunc('minute', ts)) as bigint) as minute_start, event_type, count(*) as events, round(avg(value),4) as mean_value from events group by 1,2""")
def tumbling_minute_metrics(spark, d):
    w = F.window("ts", "1 minute")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.avg("value"), 4).alias("mean_value")).select(F.unix_timestamp("w.start").alias("minute_start"), "event_type", "events", "mean_value")


@query("""with a as (select *, cast(floor(epoch(ts)) as bigint) as sec from events), b as (select *, case when sec - lag(sec) over (partition by user_id order by ts,event_id) <= 7200 then 0 else 1 end as new from a),
c as (select *, cast(sum(new) over (partition by user_id order by ts,event_id) as bigint) as session_no from b)
select user_id, session_no, min(sec) as started, max(sec) as ended, count(*) as events from c group by 1,2""")
def session_liveness(spark, d):
    return A.sessions(table(spark, d, "events"), "user_id", "ts", 7200)


@query("""with a as (select *, cast(floor(epoch(ts)) as bigint) as sec from events), b as (select event_type, coalesce(sec - lag(sec) over (partition by user_id,event_type order by ts,event_id) <= 86400, false) as hit from a)
select event_type, count(*) as lookups, count(*) filter (hit) as hits, round(100.0*count(*) filter (hit)/count(*),4) as hit_rate from b group by 1""")
def cache_hit_rate_ttl(spark, d):
    hits = A.ttl_hits(table(spark, d, "events"), ["user_id", "event_type"], "ts", 86400)
    return hits.groupBy("event_type").agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"), F.round(100.0 * F.count_if("hit") / F.count("*"), 4).alias("hit_rate"))


@query("""with b as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts,event_id) as previous from events)
select previous, event_type, count(*) as violations from b where previous is not null and not ((previous='view' and event_type in ('view','click','error')) or (previous='click' and event_type in ('purchase','view','error')) or (previous='error' and event_type in ('view','click'))) group by 1,2""")
def run_transition_violations(spark, d):
    allowed = {"view": ("view", "click", "error"), "click": ("purchase", "view", "error"), "error": ("view", "click")}
    return A.transition_violations(table(spark, d, "events"), "user_id", "ts", "event_type", allowed).groupBy("previous", "event_type").agg(F.count("*").alias("violations"))


@query("""with i as (select user_id as item, count(*)*100 as size, cast(floor(epoch(max(ts))) as bigint) as last_accessed from events group by 1),
h as (select *, cast(sum(size) over (order by last_accessed desc, item rows unbounded preceding) as bigint) as held from i) select item, size, last_accessed, held, held > 300000 as evict from h""")
def lru_eviction_plan(spark, d):
    items = table(spark, d, "events").groupBy(F.col("user_id").alias("item")).agg((F.count("*") * 100).alias("size"), F.unix_timestamp(F.max("ts")).alias("last_accessed"))
    return A.eviction_plan(items, 300_000)


_NORM = r"regexp_replace(regexp_replace(lower(coalesce({0},'')),'^\s+|\s+$','','g'),'\s+',' ','g')"
_WORDS = r"len(regexp_extract_all({0},'[A-Za-z0-9]+'))"
_TERMS = r"regexp_extract_all(lower({0}),'{1}')"
_STOP = "[" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_CONTENT = "list_filter(list_distinct(regexp_extract_all(lower({0}),'[a-z0-9]{{4,}}')), lambda x: not list_contains(" + _STOP + ", x))"
_LINES = r"list_filter(list_transform(string_split({0},chr(10)), lambda x: regexp_replace(x,'^\s+|\s+$','','g')), lambda x: x<>'')"


@query(f"""with p as (select lang, {_WORDS.format('text')} as words, length(regexp_replace(text,'[^\\p{{L}}]','','g'))/greatest(length(text),1) as letters from documents),
s as (select lang, list_sort(list(words)) as w from p group by 1)
select p.lang, count(*) as documents, cast(sum(words) as bigint) as words, min(words) as shortest, max(words) as longest, round(avg(words),4) as mean_words, median(words) as median_words,
 any_value(w[cast(round_even(0.9*(len(w)-1),0) as bigint)+1]) as p90_words, count(*) filter (words<10) as below_10, count(*) filter (words<100) as below_100, round(avg(letters),6) as letter_ratio
from p join s on p.lang=s.lang group by 1""")
def doc_text_profile(spark, d):
    """Nearest-rank p90 from ranks: a window sorts each group's counts, spilling as needed, and one row is picked."""
    p = table(spark, d, "documents").select("lang", T.word_count("text").alias("words"), T.letter_ratio("text").alias("letters"))
    by_value = p.groupBy("lang", "words").agg(F.count("*").alias("n"))

    w = Window.partitionBy("lang").orderBy("words")
    ranked = by_value.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
    p90 = ranked.where(F.col("upto") >= F.rint(0.9 * (F.col("total") - 1)) + 1).groupBy("lang").agg(F.min("words").alias("p90_words"))
    stats = p.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.min("words").alias("shortest"), F.max("words").alias("longest"), F.round(F.avg("words"), 4).alias("mean_words"), F.median("words").alias("median_words"), F.count_if(F.col("words") < 10).alias("below_10"), F.count_if(F.col("words") < 100).alias("below_100"), F.round(F.avg("letters"), 6).alias("letter_ratio"))
    return stats.join(p90, "lang")


_CLASSIFIED = r"""l as (select doc_id, source, unnest(string_split(text,chr(10))) as line, unnest(range(len(string_split(text,chr(10))))) as line_no from documents),
c as (select doc_id, source, line_no, regexp_replace(regexp_replace(regexp_replace(replace(line,chr(160),' '),'[ \t]+',' ','g'),'\n{3,}',chr(10)||chr(10),'g'),'^\s+|\s+$','','g') as t from l),
n as (select *, %NORM% as norm, %WORDS% as words, length(regexp_replace(t,'[\p{L}\p{Nd}\s]','','g')) as symbols, length(regexp_replace(t,'[^\p{L}]','','g')) as letters from c),
k as (select *, row_number() over (partition by norm order by doc_id, line_no) as copy from n),
z as (select *, case when t='' then 'EMPTY_CONTENT' when copy>1 then 'DUPLICATE_CONTENT' when regexp_matches(t,'(?i)^(page\s*(no\.?)?\s*)?\d{1,4}$') then 'PAGE_NUMBER'
 when regexp_matches(t,'(?i)^(reprint\s+\d{4}\s*-\s*\d{2}|(mathematics|science)\s*\|\s*grade\s+\d+|chapter\s+\d+|fig\.?\s*\d+(\.\d+)?|table\s+\d+(\.\d+)?)$') then 'HEADER_FOOTER'
 when regexp_matches(t,'[\x{f03d}\x{f0b4}\x{f0a7}\x{f0d8}\x{f0fc}\x{00ad}\x{fffd}\x08]') or (length(t)>=12 and regexp_matches(t,'(?:[A-Za-z]\s){5,}[A-Za-z]')) or (length(t)>=20 and symbols/length(t)>0.45) then 'OCR_NOISE'
 when length(t)<=180 and regexp_matches(t,'[=+\-×÷*/^√∠∆π≤≥<>°]') and words<=10 and letters<35 then 'FORMULA_ONLY'
 when length(t)<80 or words<12 then 'SHORT_FRAGMENT' else 'EDUCATIONAL_TEXT' end as chunk_class from k)""".replace("%NORM%", _NORM.format("t")).replace("%WORDS%", _WORDS.format("t"))


def _classified(spark, d):
    lines = C.lines_of(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "line_no", "line")
    return C.classify_chunks(lines, ["doc_id", "line_no"], text="line")


@query(f"with {_CLASSIFIED} select source, chunk_class, count(*) as chunks from z group by 1,2")
def chunk_classify(spark, d):
    return _classified(spark, d).groupBy("source", "chunk_class").agg(F.count("*").alias("chunks"))


@query(f"""with {_CLASSIFIED}, s as (select source, count(*) as chunks, avg(length(t)) as len, count(*) filter (chunk_class='EDUCATIONAL_TEXT')/count(*) as e, count(*) filter (chunk_class='DUPLICATE_CONTENT')/count(*) as u,
 count(*) filter (chunk_class='EMPTY_CONTENT')/count(*) as o, count(*) filter (chunk_class in ('OCR_NOISE','PAGE_NUMBER','FORMULA_ONLY','TABLE_FRAGMENT','SHORT_FRAGMENT'))/count(*) as n from z group by 1)
select source, chunks, round(least(greatest(70*e+20*least(len/500,1.0)-20*u-15*n-30*o,0),100),2) as quality_score from s""")
def pack_quality_score(spark, d):
    return C.pack_quality(_classified(spark, d), ["source"])


@query(rf"""with l as (select doc_id, unnest(string_split(text,chr(10))) as raw from documents), t as (select doc_id, regexp_replace(regexp_replace(raw,'^\s+|\s+$','','g'),'[ \t]+',' ','g') as line from l),
n as (select doc_id, line, {_NORM.format('line')} as norm, {_WORDS.format('line')} as words from t where line<>''), k as (select *, count(*) over (partition by doc_id, norm) as times from n),
f as (select doc_id, regexp_matches(line,'(?i)^(page\s*(no\.?)?\s*)?\d{{1,4}}$') or regexp_matches(line,'(?i)\b(isbn|copyright|all rights reserved|published by|republication|no part of this publication|printed at)\b')
 or (times>1 and regexp_matches(line,'(?i)^(reprint\s+\d{{4}}\s*-\s*\d{{2}}|(mathematics|science)\s*\|\s*grade\s+\d+|chapter\s+\d+|fig\.?\s*\d+(\.\d+)?|table\s+\d+(\.\d+)?)$')) or (words<=8 and times>=3) as drop_it from k)
select doc_id, count(*) filter (not drop_it) as kept, count(*) filter (drop_it) as dropped from f group by 1""")
def repeated_line_filter(spark, d):
    return C.filtered_line_counts(table(spark, d, "documents"))


@query(f"with h as (select doc_id, sha256({_NORM.format('text')}) as text_hash from documents), f as (select text_hash, min(doc_id) as first_id from h group by 1) select doc_id, h.text_hash, first_id, doc_id=first_id as keep from h join f on h.text_hash=f.text_hash")
def exact_dedup(spark, d):
    return C.exact_duplicates(table(spark, d, "documents"))


_KEYS = f"""w as (select doc_id, unnest(w) as w, unnest(range(len(w))) as i, len(w) as n from (select doc_id, string_split({_NORM.format('text')},' ') as w from documents)),
g as (select doc_id, n, i, w||' '||lead(w,1) over o||' '||lead(w,2) over o||' '||lead(w,3) over o||' '||lead(w,4) over o as s from w window o as (partition by doc_id order by i)),
s as (select doc_id, list(distinct s) as s from g where n>=10 and s is not null group by doc_id),
k as (select doc_id, s, sha1(array_to_string(list_sort(s)[1:18],'|')) as key from s)"""


@query(f"with {_KEYS} select key, min(doc_id) as first_id, count(*) as documents from k group by key having count(*)>1")
def near_dup_key_groups(spark, d):
    return C.key_groups(table(spark, d, "documents"))


@query(f"""with {_KEYS}, gr as (select key, min(doc_id) as first_id from k group by key having count(*)>1),
p as (select k.doc_id, first_id, k.s as a, f.s as b from k join gr on k.key=gr.key join k f on f.doc_id=gr.first_id where k.doc_id<>first_id),
j as (select doc_id, first_id, len(list_intersect(a,b)) as i, len(a) as na, len(b) as nb from p)
select doc_id, first_id, round(i/(na+nb-i),4) as similarity from j where round(i/(na+nb-i),4)>=0.75""")
def near_dup_jaccard_pairs(spark, d):
    return C.key_group_similarity(table(spark, d, "documents"))


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"""with q as (select item_id, unnest({_CONTENT.format('text')}) as term, len({_CONTENT.format('text')}) as n from benchmark),
t as (select doc_id, unnest({_CONTENT.format('text')}) as term from documents), m as (select item_id, doc_id, n, count(*) as shared from q join t on q.term=t.term group by 1,2,3)
select item_id, doc_id, shared, round(shared/n,6) as coverage from m where shared/n>=0.65""")
def benchmark_overlap(spark, d):
    q = table(spark, d, "benchmark").select("item_id", T.content_terms("text").alias("t"))
    q = q.select("item_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    t = table(spark, d, "documents").select("doc_id", F.explode(T.content_terms("text")).alias("term"))
    m = t.join(q, "term").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("shared"))
    return m.where(F.col("shared") / F.col("n") >= 0.65).select("item_id", "doc_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("coverage"))


@query(r"""with l as (select doc_id, unnest(string_split(text,chr(10))) as raw, unnest(range(len(string_split(text,chr(10))))) as line_no from documents),
t as (select doc_id, line_no, regexp_replace(raw,'^\s+|\s+$','','g') as line from l), u as (select *, len(regexp_split_to_array(line,'\s+')) as words from t where line<>''),
h as (select *, starts_with(line,'#') or (ends_with(line,':') and words<=12) or (upper(line)=line and regexp_matches(line,'\p{L}') and words<=10) or regexp_matches(line,'(?i)^((chapter|unit|lesson|section)\s+\d+|\d+(\.\d+)+\s)') as heading from u),
s as (select *, cast(sum(cast(heading as int)) over (partition by doc_id order by line_no rows unbounded preceding) as bigint) as section_no from h)
select doc_id, section_no, coalesce(max(case when heading then regexp_replace(regexp_replace(line,'^[# ]+',''),'^\s+|\s+$','','g') end),'Introduction') as title,
 string_agg(line, chr(10) order by line_no) filter (not heading) as content, count(*) filter (not heading) as n_lines from s group by 1,2 having count(*) filter (not heading)>0""")
def section_split(spark, d):
    return C.sections(table(spark, d, "documents"))


@query("""with w as (select doc_id, text, unnest(range(0, cast(greatest(0,ceil((length(text)-1200)/1000)) as bigint)+1)) as window_no from documents where length(text)>0)
select doc_id, window_no, window_no*1000 as start, substring(text, window_no*1000+1, 1200) as text from w""")
def sliding_windows(spark, d):
    return C.char_windows(table(spark, d, "documents"))


@query(r"""with w as (select doc_id, list_filter(regexp_split_to_array(text,'\s+'), lambda x: x<>'') as w from documents), n as (select doc_id, w, len(w) as n, case when len(w)>450 then greatest(2, cast(ceil(len(w)/350) as bigint)) else 1 end as p from w where len(w)>0),
e as (select doc_id, w, cast(ceil(n/p) as bigint) as e, unnest(range(p)) as piece_no from n), s as (select doc_id, piece_no, w[piece_no*e+1:piece_no*e+e] as part from e)
select doc_id, piece_no, len(part) as n_words, array_to_string(part,' ') as text from s where len(part)>0""")
def word_windows(spark, d):
    return C.word_windows(table(spark, d, "documents"))


_SENTENCES = r"list_filter(string_split(regexp_replace({0},'([.!?।])\s+','\1'||chr(1),'g'),chr(1)), lambda x: regexp_replace(x,'^\s+|\s+$','','g')<>'')"
_PARAGRAPHS = r"list_filter(list_transform(regexp_split_to_array({0},'\n\s*\n'), lambda x: regexp_replace(x,'^\s+|\s+$','','g')), lambda x: x<>'')"
_SPACED = r"len(regexp_extract_all({0},'\S+'))"


def folded(parts: str, length: str, fits: str, joint: int, separator: str) -> str:
    """A greedy fold over the parts of each document by recursion; `fits` is about `total`, of the group, and `longer`, with the next part x. A part of negative length stands alone."""
    fit = fits.replace("longer", f"(total+{joint}+lens[i+1])")
    fit = f"(total>=0 and lens[i+1]>=0 and ({fit}))"
    return f"""with recursive l as materialized (select doc_id, {parts} as parts from documents where text is not null), s as materialized (select doc_id, list_transform(parts, lambda x: {length}) as lens, len(parts) as n from l where len(parts)>0),
g(doc_id, i, id, total) as (select doc_id, 1, 0, cast(lens[1] as bigint) from s union all select g.doc_id, i+1, case when {fit} then id else id+1 end, cast(case when {fit} then total+{joint}+lens[i+1] else lens[i+1] end as bigint) from g join s on s.doc_id=g.doc_id where i<n),
c as (select g.doc_id, cast(id as bigint) as chunk_no, string_agg(parts[i], {separator} order by i) as text from g join l on l.doc_id=g.doc_id group by 1,2)"""


@query(f"{folded(_LINES.format('text'), 'length(x)', 'longer<=1500 or (total<800 and longer<=5000)', 2, 'chr(10)||chr(10)')} select *, length(text) as n_chars from c")
def adjacent_merge(spark, d):
    return C.merge_paragraphs(table(spark, d, "documents"))


@query(f"{folded(_SENTENCES.format('text'), _SPACED.format('x'), 'longer<=200 or (total<200 and longer<=400)', 0, chr(39) + ' ' + chr(39))} select *, {_SPACED.format('text')} as n_words from c")
def semantic_chunks(spark, d):
    return C.semantic_chunks(table(spark, d, "documents"))


@query(f"{folded(_PARAGRAPHS.format('text'), 'length(x)', 'total<120', 2, 'chr(10)||chr(10)')} select * from c")
def paragraph_merge(spark, d):
    return C.merge_short_paragraphs(table(spark, d, "documents"))


@query(f"{folded(_LINES.format('text'), _SPACED.format('x'), 'longer<=2000', 0, 'chr(10)')} select * from c")
def section_pieces(spark, d):
    return C.section_pieces(table(spark, d, "documents"))


@query(f"{folded(_LINES.format('text'), 'case when regexp_matches(x,' + chr(39) + '[=+*/^-]' + chr(39) + ') then -length(x) else length(x) end', 'longer<=1298', 2, 'chr(10)||chr(10)')} select * from c")
def atomic_chunks(spark, d):
    """Lines packed to chunks, those with formulas by themselves."""
    return C.atomic_chunks(table(spark, d, "documents"), lambda p: p.rlike(r"[=+*/^\-]"))


_CLAUSES = r"string_split(regexp_replace(s,'([,;:])\s+','\1'||chr(1),'g'),chr(1))"
_SPOKEN = rf"flatten(list_transform(flatten(list_transform(list_transform({_SENTENCES.format('text')}, lambda q: regexp_replace(q,'^\s+|\s+$','','g')), lambda s: case when length(s)<=240 then [s] else list_filter({_CLAUSES}, lambda y: y<>'') end)), lambda z: case when length(z)<=240 then [z] else list_filter(regexp_split_to_array(z,'\s+'), lambda y: y<>'') end))"


@query(f"{folded(_SPOKEN, 'length(x)', 'longer<=240', 1, chr(39) + ' ' + chr(39))} select * from c")
def speech_parts(spark, d):
    """Texts in parts of 240 characters at most."""
    return C.speech_parts(table(spark, d, "documents"))


_PROFILES = ((100, 200), (150, 300), (200, 400), (250, 500))


@query(f"""with {', '.join(f"p{a} as (select doc_id, " + str(a) + " as least, " + str(b) + f" as most, n_words from ({folded(_SENTENCES.format('text'), _SPACED.format('x'), f'longer<={a} or (total<{a} and longer<={b})', 0, chr(39) + ' ' + chr(39))} select *, {_SPACED.format('text')} as n_words from c))" for a, b in _PROFILES)},
u as ({' union all '.join(f'select * from p{a}' for a, _ in _PROFILES)}), g as (select least, most, count(*) as chunks, round(avg(n_words),6) as mean_words, round(100*count(*) filter (n_words between least and most)/count(*),6) as score from u group by 1,2)
select *, row_number() over (order by score desc, least)=1 as best from g""")
def chunking_profiles(spark, d):
    """Profiles of chunk lengths, scored by the share of chunks within them; the best one marked."""
    docs, parts = table(spark, d, "documents"), None
    for least, most in _PROFILES:
        c = C.semantic_chunks(docs, least, most).select(F.lit(least).alias("least"), F.lit(most).alias("most"), "n_words")
        parts = c if parts is None else parts.unionByName(c)
    g = parts.groupBy("least", "most").agg(F.count("*").alias("chunks"), F.round(F.avg("n_words"), 6).alias("mean_words"), F.round(100 * F.count_if(F.col("n_words").between(F.col("least"), F.col("most"))) / F.count("*"), 6).alias("score"))
    return g.withColumn("best", F.row_number().over(Window.orderBy(F.desc("score"), "least")) == 1)  # four rows


_TERM_ROWS = f"""tok as (select doc_id, unnest({_TERMS.format('text', '[a-z0-9]{4,}')}) as term, unnest(range(len({_TERMS.format('text', '[a-z0-9]{4,}')}))) as pos from documents),
tc as (select doc_id, term, count(*) as n, min(pos) as first_at from tok where not list_contains({_STOP}, term) group by 1,2),
top as (select doc_id, term, n, row_number() over (partition by doc_id order by n desc, first_at) as rank from tc)"""


@query(f"with {_TERM_ROWS} select doc_id, term, n, rank from top where rank<=8")
def top_terms_per_doc(spark, d):
    return K.top_terms(table(spark, d, "documents"))


@query(f"""with w as (select source, list_filter({_TERMS.format('text', '[a-z0-9]+')}, lambda x: length(x)>=3 and not list_contains({_STOP}, x)) as w from documents),
b as (select source, unnest(list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1])) as bigram from w), n as (select source, bigram, count(*) as n from b group by 1,2 having count(*)>=2),
r as (select *, row_number() over (partition by source order by n desc, bigram) as rank from n) select * from r where rank<=20""")
def frequent_bigrams(spark, d):
    return K.frequent_bigrams(table(spark, d, "documents"), ["source"])


@query(rf"""with l as (select doc_id, source, unnest({_LINES.format('text')}) as line, unnest(range(len({_LINES.format('text')}))) as line_no from documents),
m as (select * from l where regexp_matches(line,'(?i)^([A-Za-z][A-Za-z0-9\- ]{{2,40}}?)\s*(?::|\s-\s|\s+is\s+)\s*(.{{10,220}})$')),
p as (select *, regexp_replace(regexp_extract(line,'(?i)^([A-Za-z][A-Za-z0-9\- ]{{2,40}}?)\s*(?::|\s-\s|\s+is\s+)\s*(.{{10,220}})$',1),'^\s+|\s+$','','g') as term,
 regexp_replace(regexp_replace(regexp_extract(line,'(?i)^([A-Za-z][A-Za-z0-9\- ]{{2,40}}?)\s*(?::|\s-\s|\s+is\s+)\s*(.{{10,220}})$',2),'^\s+|\s+$','','g'),'\.+$','') as definition from m),
k as (select *, {_NORM.format('term')} as term_key, row_number() over (partition by source, {_NORM.format('term')} order by doc_id, line_no) as rn, count(*) over (partition by source, {_NORM.format('term')}) as found from p)
select source, term_key, term, definition, found from k where rn=1""")
def definition_glossary(spark, d):
    return K.glossary(table(spark, d, "documents"), ["source"])


@query(rf"""with {_TERM_ROWS}, ts as (select doc_id, list(term) as terms from top where rank<=8 group by 1),
sp as (select doc_id, list_filter(string_split(regexp_replace(text,'([.!?।])\s+','\1'||chr(31),'g'),chr(31)), lambda x: regexp_replace(x,'^\s+|\s+$','','g')<>'') as s from documents),
e as (select doc_id, unnest(s) as sentence, unnest(range(len(s))) as sentence_no from sp),
sc as (select e.doc_id, sentence_no, coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(sentence),'[a-z0-9]{{4,}}')), terms)),0)
 + case when regexp_matches(sentence,'[=+*/^]') then 2.5 else 0 end + case when regexp_matches(lower(sentence),'because|therefore|for example|means|is called') then 1.5 else 0 end + case when regexp_matches(sentence,'^[A-Z]') then 0.25 else 0 end as score
 from e left join ts on e.doc_id=ts.doc_id), r as (select doc_id, sentence_no, cast(score as double) as score, row_number() over (partition by doc_id order by score desc, sentence_no) as rank from sc)
select * from r where rank<=5""")
def extractive_summary(spark, d):
    return K.summary_sentences(table(spark, d, "documents"))


@query(f"with {_TERM_ROWS}, t as (select doc_id, term from top where rank<=8) select a.term as src, b.term as dst, count(*) as weight from t a join t b on a.doc_id=b.doc_id and a.term<>b.term group by 1,2")
def cooccurrence_edges(spark, d):
    return K.co_occurrence(K.top_terms(table(spark, d, "documents")), "doc_id", "term")


@query(f"""with {_TERM_ROWS}, s as (select source, term, sum(n) as n from top join documents using (doc_id) where rank<=8 group by 1,2),
k as (select source, term from (select *, row_number() over (partition by source order by n desc, term) as r from s) where r<=30)
select source, term as topic, lag(term) over (partition by source order by term) as prerequisite from k qualify prerequisite is not null""")
def prerequisite_edges(spark, d):
    docs = table(spark, d, "documents")
    terms = K.top_terms(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "term").agg(F.sum("n").alias("n"))
    return K.prerequisites(A.top_per_key(terms, ["source"], [F.desc("n"), F.col("term")], 30), "source", "term")


_BM25 = f"""q as (select query_id, term, count(*) as repeats from (select item_id as query_id, unnest({_TERMS.format('text', '[a-z0-9]{4,}')}) as term from benchmark) group by 1,2),
dl as (select doc_id, text, len({_TERMS.format('text', '[a-z0-9]{4,}')}) as length from documents), st as (select count(*) as documents, avg(length) as avgdl from dl),
pt as (select doc_id, length, term, count(*) as tf from (select doc_id, length, unnest({_TERMS.format('text', '[a-z0-9]{4,}')}) as term from dl) where term in (select term from q) group by 1,2,3),
dq as (select term, count(*) as df from pt group by 1),
bm as (select query_id, doc_id, round(sum(repeats*ln(1+(documents-df+0.5)/(df+0.5))*tf*2.5/(tf+1.5*(0.25+0.75*greatest(length,1)/greatest(avgdl,1e-6)))),4) as bm25, sum(repeats*ln(1+(documents-df+0.5)/(df+0.5))*tf*2.5/(tf+1.5*(0.25+0.75*greatest(length,1)/greatest(avgdl,1e-6)))) as raw from pt join q using (term) join dq using (term), st group by 1,2)"""


@query(f"with {_BM25}, r as (select *, row_number() over (partition by query_id order by bm25 desc, doc_id) as rank from bm) select query_id, doc_id, bm25, rank from r where rank<=10")
def bm25_topk(spark, d):
    return R.top_hits(R.bm25(table(spark, d, "documents"), _questions(spark, d)), "bm25", 10)


@query("""with s as (select q.vec_id as query_id, v.vec_id, round(list_sum(list_transform(range(1,len(q.embedding)+1), lambda i: cast(q.embedding[i] as double)*cast(v.embedding[i] as double))),6) as score
 from embeddings q, embeddings v where q.vec_id%20=0 and q.vec_id<>v.vec_id), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) select * from r where rank<=10""")
def dense_topk(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.dense(vectors, vectors.where("vec_id % 20 = 0"), 10)


@query(f"""with {_BM25}, f as (select bm.query_id, bm.doc_id, bm25, lang, source, round(0.55*(shared/greatest(n,1))+0.35*raw+case when lang='en' then 0.10 else 0 end+case when source='src0' then 0.10 else 0 end,6) as fused
 from bm join (select q2.query_id, t.doc_id, count(*) as shared from (select distinct query_id, term from q) q2 join pt t on q2.term=t.term group by 1,2) o on bm.query_id=o.query_id and bm.doc_id=o.doc_id
 join (select query_id, count(distinct term) as n from q group by 1) c on c.query_id=bm.query_id join documents on documents.doc_id=bm.doc_id),
r as (select query_id, doc_id, fused, row_number() over (partition by query_id order by fused desc, doc_id) as rank from f where fused>0) select * from r where rank<=10""")
def hybrid_fusion(spark, d):
    """Dense stand-in: the share of the query's distinct terms in the document."""
    docs, questions = table(spark, d, "documents"), _questions(spark, d)
    asked = questions.select("query_id", F.explode(F.array_distinct(T.tokens("text", R.TERM))).alias("term"))
    n = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    shared = R.postings(docs).join(asked, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("shared")).join(n, "query_id")
    hits = R.bm25(docs, questions, places=12).join(shared, ["query_id", "doc_id"]).join(docs.select("doc_id", "lang", "source"), "doc_id")
    fused = R.fuse(F.col("shared") / F.greatest(F.col("n"), F.lit(1)), F.col("bm25"), [F.col("lang") == "en", F.col("source") == "src0"])
    return R.top_hits(hits.select("query_id", "doc_id", fused.alias("fused")).where("fused > 0"), "fused", 10)


_OVERLAP = f"""dt as (select doc_id, unnest(t) as term, len(t) as n from (select doc_id, {_CONTENT.format('text')} as t from documents)),
qt as (select item_id as query_id, unnest({_CONTENT.format('text')}) as term from benchmark), ov as (select query_id, doc_id, count(*) as shared, round(count(*)/sqrt(n),6) as score from qt join dt using (term) group by query_id, doc_id, n),
rk as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from ov)"""


@query(f"""with {_OVERLAP}, rel as (select item_id as query_id, doc_id from benchmark join documents on contains(documents.text, benchmark.text)),
f as (select rel0.query_id, max(case when rank<=1 and rel.doc_id is not null then 1 else 0 end) as a, max(case when rank<=3 and rel.doc_id is not null then 1 else 0 end) as b, max(case when rank<=5 and rel.doc_id is not null then 1 else 0 end) as c
 from (select distinct query_id from rel) rel0 left join (select * from rk where rank<=5) h on h.query_id=rel0.query_id left join rel on rel.query_id=h.query_id and rel.doc_id=h.doc_id group by 1)
select count(*) as queries, round(avg(a),6) as top1_accuracy, round(avg(b),6) as top3_accuracy, round(avg(c),6) as top5_accuracy from f""")
def overlap_search_eval(spark, d):
    """Relevant: documents that hold the item's text, found among those that share all of its distinct terms."""
    docs, questions = table(spark, d, "documents"), _questions(spark, d)
    hits = R.overlap_search(docs, questions)
    asked = questions.select("query_id", F.array_distinct(T.tokens("text", "[a-z0-9]{4,}")).alias("t"), F.col("text").alias("item"))
    need = asked.select("query_id", "item", F.size("t").alias("n"), F.explode("t").alias("term"))
    seen = docs.select("doc_id", F.explode(F.array_distinct(T.tokens("text", "[a-z0-9]{4,}"))).alias("term"))
    full = seen.join(need.drop("item"), "term").groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("k")).where("k >= n - 2")
    relevant = full.join(questions.withColumnRenamed("text", "item"), "query_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("query_id", "doc_id")
    return R.retrieval_accuracy(hits, relevant)


@query("""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), m as (select vec_id, v, list_min(v) as lo, list_max(v)-list_min(v) as span from v)
select vec_id, array_to_string(list_transform(v, lambda x: cast(trunc((x-lo)/case when span=0 then 1 else span end*255) as int)),',') as codes from m""")
def quantize_embeddings(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(T.quantize8("embedding"), lambda x: x.cast("string")), ",").alias("codes"))


def _turns(spark, d):

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return t.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


_TURNS = "tn as (select conv_id, turn, text as question, answer from (select *, lead(role) over w as next_role, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn)) where role='user' and next_role='assistant')"


@query(rf"""with {_TURNS}, s as (select *, list_distinct(regexp_extract_all(lower(answer),'[a-z][a-z0-9_-]{{3,}}')) as a, list_distinct(regexp_extract_all(lower(question),'[a-z][a-z0-9_-]{{3,}}')) as c, len(list_filter(regexp_split_to_array(answer,'\s+'), lambda x: x<>'')) as w from tn),
o as (select *, case when len(a)=0 or len(c)=0 then 0.0 else len(list_intersect(a,c))/greatest(len(a),1) end as ov,
 case when w=0 then 0.0 else least(1.0, least(1.0,w/80)+case when regexp_matches(lower(answer),'for example|because|therefore|means|is called') then 0.15 else 0 end+case when regexp_matches(question,'\?\s*$') and w>=25 then 0.1 else 0 end) end as co from s)
select conv_id, turn, round(ov,3) as context_overlap, round(co,3) as completeness, case when ov<0.03 and w>40 then 'high' when ov<0.08 then 'medium' else 'low' end as hallucination_risk,
 array_to_string(list_filter([case when ov<0.05 then 'low_context_overlap' end, case when w=0 then 'empty_answer' end, case when co<0.45 then 'low_completeness' end], lambda x: x is not null),',') as issues from o""")
def answer_evaluation(spark, d):
    return Q.answer_scores(_turns(spark, d).withColumn("context", F.col("question"))).select("conv_id", "turn", "context_overlap", "completeness", "hallucination_risk", "issues")


@query(r"""with c as (select conv_id, turn, len(regexp_extract_all(text,'[A-Za-z0-9]+')) as n, length(regexp_replace(text,'[^A-Za-z0-9]','','g')) as l, greatest(1,len(regexp_extract_all(text,'[.!?]+'))) as s from conversations)
select conv_id, turn, case when n>0 then round(100*(0.65*greatest(0.0,1-abs(n/s-18.0)/30.0)+0.35*greatest(0.0,1-abs(l/n-5.2)/5.0)),5) else 0.0 end as readability from c""")
def readability(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.readability("text", 5).alias("readability"))


@query(rf"""with {_TURNS}, p as (select conv_id, regexp_replace({_NORM.format('question')},'[^ -~]','','g') as a, regexp_replace({_NORM.format('answer')},'[^ -~]','','g') as b from tn),
e as (select conv_id%2 as half, conv_id%3 as third, case when length(a)=0 then case when length(b)=0 then 0.0 else 1.0 end else levenshtein(a,b)/length(a) end as cer from p)
select half, third, count(*) as pairs, round(avg(cer),6) as mean_cer from e group by grouping sets ((half),(third),())""")
def error_rates(spark, d):
    """Character error rates of an answer against its question, over ASCII characters, as SQL compares bytes."""
    t = _turns(spark, d)
    plain = lambda c: F.regexp_replace(T.normalize_text(c), "[^ -~]", "")
    p = t.select("conv_id", plain("question").alias("reference"), plain("answer").alias("hypothesis"))
    reference, hypothesis = F.col("reference"), F.col("hypothesis")
    cer = F.when(F.length(reference) == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))
    p = p.select((F.col("conv_id") % 2).alias("half"), (F.col("conv_id") % 3).alias("third"), cer.alias("cer"))
    return p.groupingSets([["half"], ["third"], []], "half", "third").agg(F.count("*").alias("pairs"), F.round(F.avg("cer"), 6).alias("mean_cer"))


@query(rf"""with p as (select quality, text, {_WORDS.format('text')} as words, {_LINES.format('text')} as ls from documents join labels using (doc_id)),
r as (select quality=1 as actual, words>=60 and not regexp_matches({_NORM.format('text')},'(?i)\b(isbn|copyright|all rights reserved|published by|printed at|reprint|contents|table of contents|answer key)\b')
 and not (len(ls)=0 or len(list_filter(ls, lambda x: regexp_matches(x,'^\d{{1,4}}$') or regexp_matches(x,'(?i)^(fig|table)\.?\s*\d+')))/greatest(len(ls),1)>0.2 or regexp_matches(text,'[\x07\x08\x{{fffd}}]'))
 and length(regexp_replace(text,'[^\p{{L}}]','','g'))/greatest(length(text),1)>0.45 as predicted from p),
c as (select count(*) filter (predicted and actual) as tp, count(*) filter (predicted and not actual) as fp, count(*) filter (not predicted and actual) as fn, count(*) filter (not predicted and not actual) as tn from r)
select *, case when tp+fp=0 then 100.0 else round(100.0*tp/(tp+fp),2) end as precision_pct, case when tp+fn=0 then 100.0 else round(100.0*tp/(tp+fn),2) end as recall_pct, case when 2*tp+fp+fn=0 then 100.0 else round(100.0*2*tp/(2*tp+fp+fn),2) end as f1_pct from c""")
def classifier_precision_recall(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(Q.readable(F.col("text")).alias("predicted"), (F.col("quality") == 1).alias("actual"))
    return Q.binary_scores(joined, F.col("predicted"), F.col("actual"))


@query(f"""with h as (select source, doc_id, {_WORDS.format('text')} as words, {_NORM.format('text')} as norm from documents), s as (select source, count(*) as documents, 1-count(distinct norm)/count(*) as dup, avg(words) as len, count(*) filter (words<10)/count(*) as short from h group by 1)
select source, documents, round(dup,6) as duplicate_ratio, round(len,4) as average_words, f.failures, f.failures='' as passed from s,
 lateral (select array_to_string(list_filter([case when not dup<0.10 then 'duplicate_ratio' end, case when not (len between 200 and 400) then 'average_length' end, case when not short<0.05 then 'short_documents' end], lambda x: x is not null),',') as failures) f""")
def quality_gate(spark, d):
    h = table(spark, d, "documents").select("source", T.word_count("text").alias("words"), T.content_hash("text").alias("h"))
    s = h.groupBy("source").agg(F.count("*").alias("documents"), (1 - F.countDistinct("h") / F.count("*")).alias("dup"), F.avg("words").alias("len"), (F.count_if(F.col("words") < 10) / F.count("*")).alias("short"))
    gated = Q.gate(s, {"duplicate_ratio": F.col("dup") < 0.10, "average_length": F.col("len").between(200, 400), "short_documents": F.col("short") < 0.05})
    return gated.select("source", "documents", F.round("dup", 6).alias("duplicate_ratio"), F.round("len", 4).alias("average_words"), "failures", "passed")


@query(f"""with {_TERM_ROWS}, q as (select distinct unnest({_CONTENT.format('text')}) as term from benchmark),
a as (select term, count(distinct doc_id) as documents from tc group by 1), k as (select term, count(distinct doc_id) as kept from tc join (select min(doc_id) as doc_id from documents group by {_NORM.format('text')}) using (doc_id) group by 1),
t as (select term, count(*) as tops from top where rank<=8 group by 1)
select q.term, coalesce(documents,0) as documents, coalesce(kept,0) as kept, coalesce(tops,0) as tops, case when documents is null then 'retrieval' when kept is null then 'dedup' when tops is null then 'extraction' else 'survived' end as lost_at
from q left join a using (term) left join k using (term) left join t using (term)""")
def stage_loss(spark, d):
    """Where terms of benchmark items are lost: not in the corpus, gone with duplicates, no top term, or survived."""
    docs = table(spark, d, "documents")
    terms = table(spark, d, "benchmark").select(F.explode(T.content_terms("text")).alias("term")).distinct()
    counts = K.term_counts(docs)
    kept = C.exact_duplicates(docs).where("keep").select("doc_id")
    every = counts.groupBy("term").agg(F.count("*").alias("documents"))
    left = counts.join(kept, "doc_id").groupBy("term").agg(F.count("*").alias("kept"))
    tops = K.top_terms(docs).groupBy("term").agg(F.count("*").alias("tops"))
    out = terms.join(every, "term", "left").join(left, "term", "left").join(tops, "term", "left").na.fill(0, ["documents", "kept", "tops"])
    return Q.stage_of_loss(out, {"retrieval": F.col("documents") > 0, "dedup": F.col("kept") > 0, "extraction": F.col("tops") > 0})


@query(r"""with u as (select page_id, url, regexp_extract(url,'^[a-z]+://([^/?#]+)',1) as host, list_filter(string_split(regexp_extract(url,'^[a-z]+://[^/?#]+([^?#]*)',1),'/'), lambda x: x<>'') as seg from pages)
select page_id, host, regexp_extract(host,'([^.]+\.[^.]+)$',1) as site, coalesce(seg[1],'') as section, regexp_replace(regexp_replace(lower(coalesce(seg[len(seg)],'')),'[^a-z0-9]+','-','g'),'^-+|-+$','','g') as page, contains(url,'?') as has_query from u""")
def url_metadata(spark, d):
    return table(spark, d, "pages").select("page_id", S.url_parts("url").alias("u")).select("page_id", "u.*")
