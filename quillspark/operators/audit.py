"""Audits of registries, caches and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def metadata_filter(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows whose normalised values equal, or for lists are among, the wanted ones; null, "" and [] ask for nothing."""
    for column, value in wanted.items():
        if value in (None, "", []):
            continue
        values = value if isinstance(value, list) else [value]
        df = df.where(T.normalize_name(F.col(column).cast("string")).isin(*[str(v).strip().lower() for v in values]))
    return df


def registry_totals(packs: DataFrame) -> DataFrame:
    """packs(pack_id, bytes): how many, their bytes, and a hash of the sorted list. A registry is a small table."""
    listed = F.array_sort(F.collect_list(F.struct("pack_id", "bytes")))
    text = F.array_join(F.transform(listed, lambda s: F.concat(s["pack_id"].cast("string"), F.lit(":"), s["bytes"].cast("string"))), ",")
    return packs.agg(F.count("*").alias("packs"), F.sum("bytes").alias("bytes"), F.sha2(text, 256).alias("content_hash"))


def duplicates(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(id_column).alias("first_id")).where("n > 1")


def row_counts(tables: dict[str, DataFrame], k: int) -> DataFrame:
    """The k largest tables."""
    every = None
    for name, df in tables.items():
        n = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        every = n if every is None else every.unionByName(n)
    return every.orderBy(F.desc("n"), "name").limit(k)


def recent_means(events: DataFrame, n: int) -> DataFrame:
    """Counts and means by type of the last n events."""
    last = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def rank_percentiles(df: DataFrame, key: str, value: str, points: tuple[float, ...]) -> DataFrame:
    """Nearest-rank percentiles of each key by counts of distinct values, so that a common key is pre-aggregated."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    ranked = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_total", F.sum("_n").over(w))
    at = lambda p: F.min(F.when(F.col("_upto") >= F.rint(F.lit(p) * (F.col("_total") - 1)) + 1, F.col(value)))
    return ranked.groupBy(key).agg(F.max("_total").alias("n"), F.round(F.sum(F.col(value) * F.col("_n")) / F.sum("_n"), 6).alias("mean_value"), *[at(p).alias(f"p{round(100 * p)}") for p in points])


def public_ids(df: DataFrame, id_column: str, title: str) -> DataFrame:
    """A slug of the title for the first id that has it, the slug and a checksum of the id for the others."""
    s = df.select(id_column, T.slug(title).alias("slug"))
    first = s.groupBy("slug").agg(F.min(id_column).alias("_first"))
    suffix = F.concat("slug", F.lit("-"), F.substring(F.sha2(F.col(id_column).cast("string"), 256), 1, 8))
    return s.join(first, "slug").select(id_column, F.when(F.col(id_column) == F.col("_first"), F.col("slug")).otherwise(suffix).alias("public_id"))


def best_and_worst(df: DataFrame, score: str, id_column: str, k: int) -> DataFrame:
    best = df.orderBy(F.desc(score), id_column).limit(k).withColumn("side", F.lit("best"))
    return best.unionByName(df.orderBy(score, id_column).limit(k).withColumn("side", F.lit("worst")))


def route(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Best k chapters of index(term, chapter, weight) for each query, with their share of all weight as confidence."""
    asked = queries.select("query_id", F.explode(F.array_distinct(T.tokens("text", "[a-z0-9]{4,}"))).alias("term"))
    scores = asked.join(index, "term").groupBy("query_id", "chapter").agg(F.sum("weight").alias("score"))
    w = Window.partitionBy("query_id")
    ranked = scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "chapter")).cast("long")).withColumn("confidence", F.round(F.col("score") / F.sum("score").over(w), 6))
    return ranked.where(F.col("rank") <= k)


def quiz_fold(events: DataFrame, key: str, correct: Column, items: int) -> DataFrame:
    """Progress of each session: answered, correct, completion, status and the item it is at."""
    n = F.count("*")
    return events.groupBy(key).agg(n.alias("answered"), F.count_if(correct).alias("correct"), F.round(100.0 * F.least(n, F.lit(items)) / items, 4).alias("completion_pct"), F.when(n >= items, "completed").otherwise("active").alias("status"), F.max_by("event_type", F.struct("ts", "event_id")).alias("current_item"))


def conflicts(backend: DataFrame, local: DataFrame, strategy: str = "latest") -> DataFrame:
    """Packs whose content differs on both sides(pack_id, updated, content), and which side wins."""
    both = backend.alias("b").join(local.alias("l"), "pack_id").where("b.content <> l.content")
    winner = F.when(F.col("b.updated") >= F.col("l.updated"), "backend").otherwise("local") if strategy == "latest" else F.lit(strategy)
    return both.select("pack_id", winner.alias("winner"))


def hash_status(df: DataFrame, stored: str, now: str) -> DataFrame:
    return df.withColumn("status", F.when(F.col(stored).isNull(), "WARNING").when(F.col(stored) == F.col(now), "OK").otherwise("FAILED"))


def asset_issues(items: DataFrame, keys: list[str]) -> DataFrame:
    """items(words, h, ...): empty, duplicate and low-information items of each group, and a score."""
    empty, low, copies = F.count_if(F.col("words") == 0), F.count_if(F.col("words").between(1, 19)), F.count("*") - F.countDistinct("h")
    score = F.greatest(F.lit(0.0), 100 - 100.0 * (empty + copies + low) / F.count("*"))
    return items.groupBy(*keys).agg(F.count("*").alias("items"), empty.alias("empty_items"), copies.alias("duplicate_items"), low.alias("low_info"), F.round(score, 4).alias("score"))


def interrupted(transfers: DataFrame, retries: int = 3) -> DataFrame:
    """Transfers that failed or stopped and may be tried again, those of high priority and old ones first."""
    return transfers.where(F.col("status").isin("failed", "interrupted") & (F.col("retries") < retries)).orderBy(F.desc("priority"), "created_at")


def expired(items: DataFrame, now: Column, days: int) -> DataFrame:
    """Finished items older than so many days."""
    return items.where((F.col("status") == "completed") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(days))))


def revision_history(revisions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Revisions newest first with the hash of their fields, filled in where it is missing, and whether it changed."""
    w = Window.partitionBy(key).orderBy("created_at")
    full = revisions.withColumn("revision_hash", F.coalesce("revision_hash", T.checksum({f: F.col(f) for f in fields})))
    return full.withColumn("changed", ~F.col("revision_hash").eqNullSafe(F.lag("revision_hash").over(w))).orderBy(key, F.desc("created_at"))


def manifest_diff(host: DataFrame, client: DataFrame) -> DataFrame:
    """Per artifact counts of two manifests(pack_id, version, artifact_counts): count on either side and the difference."""
    rows = lambda m, name: m.select("pack_id", F.explode("artifact_counts").alias("artifact", name))
    both = rows(host, "host_count").join(rows(client, "client_count"), ["pack_id", "artifact"], "full_outer").na.fill(0, ["host_count", "client_count"])
    return both.withColumn("delta", F.col("host_count") - F.col("client_count"))
