"""Aggregates, windows, joins and deltas over runs, registries, catalogs and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.scratch import checkpointed


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def run_stats(runs: DataFrame, results: DataFrame, keys: list[str], students: bool = False, latest_result: bool = False, places: int = 2) -> DataFrame:
    """Statistics of runs(run_id, status, duration_ms, student_id, ...) with results(run_id, score, completion).

    A left join: a run with several results counts once for each, unless latest_result keeps only the result of
    greatest created_at. Averages are null without values, times 0.
    """
    if latest_result:
        results = latest_per_key(results, ["run_id"], [F.desc("created_at")])
    joined = runs.join(results, "run_id", "left")
    aggregates = [
        F.count("run_id").alias("total_runs"),
        count_where(F.col("status") == "completed").alias("completed_runs"),
        count_where(F.col("status") == "failed").alias("failed_runs"),
        count_where(F.col("status").isin("created", "running", "paused")).alias("active_runs"),
        F.round(F.avg("score"), places).alias("average_score"),
        F.round(F.avg("completion"), places).alias("average_completion"),
        F.round(F.avg("duration_ms"), places).alias("average_duration_ms"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("total_time_spent_ms"),
    ]
    if students:
        aggregates.append(F.countDistinct("student_id").alias("unique_students"))
    return joined.groupBy(*keys).agg(*aggregates)


def top_experiments(runs: DataFrame, results: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The `limit` (1 to 100) experiments of most runs, ties by completion rate, then by key."""
    joined = runs.join(results, "run_id", "left")
    out = joined.groupBy(key).agg(F.count("run_id").alias("run_count"), F.round(F.avg(F.when(F.col("status") == "completed", 1.0).otherwise(0.0)) * 100, 4).alias("completion_rate"), F.round(F.avg("score"), 2).alias("average_score"))
    return out.orderBy(F.desc("run_count"), F.desc("completion_rate"), key).limit(max(1, min(limit, 100)))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, kind: str) -> DataFrame:
    """How many rows of child have no parent."""
    missing = child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
    return missing.agg(F.lit(kind).alias("kind"), F.count("*").alias("orphans"))


def paginate(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Rows of one page, each with page, page_size and total."""
    total = df.agg(F.count("*").alias("total"))
    ranked = df.orderBy(*order).limit(page * size).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    # one row, so it may be broadcast
    return ranked.where(F.col("place") > (page - 1) * size).join(F.broadcast(total)).withColumns({"page": F.lit(page), "page_size": F.lit(size)})


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; WindowGroupLimit keeps one row per key and task before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def catalog_delta(host: DataFrame, client: DataFrame) -> DataFrame:
    """host(pack_id, version, bytes) against client(pack_id, version): add, update, remove or keep, and the bytes to load."""
    h, c = host.withColumnsRenamed({"version": "host_version"}), client.withColumnsRenamed({"version": "client_version"})
    both = h.join(c, "pack_id", "full_outer")
    action = F.when(F.col("client_version").isNull(), "add").when(F.col("host_version").isNull(), "remove").when(F.col("host_version") != F.col("client_version"), "update").otherwise("keep")
    return both.withColumn("action", action).withColumn("download_bytes", F.when(action.isin("add", "update"), F.col("bytes")).otherwise(F.lit(0)))


def round_robin_sample(df: DataFrame, strata: list[str], order: list[Column], n: int) -> DataFrame:
    """n rows, one of each stratum in turn."""
    rn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order)).cast("long")
    return df.withColumn("turn", rn).where(F.col("turn") <= n).orderBy("turn", *strata).limit(n)


def version_deltas(df: DataFrame, key: str, order: list[str], size: str) -> DataFrame:
    """Each version with the one before it of its key, and the change of size."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("version_no", F.row_number().over(w).cast("long")).withColumn("previous", F.lag(size).over(w)).withColumn("delta", F.round(F.col(size) - F.col("previous"), 2))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Gaps and islands: session number per key, start and end in epoch seconds, events."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    at = F.unix_timestamp(ts)
    new = F.when(at - F.lag(at).over(w) <= gap_seconds, 0).otherwise(1)
    numbered = events.withColumn("_at", at).withColumn("session_no", F.sum(new).over(w))
    return numbered.groupBy(key, F.col("session_no").cast("long").alias("session_no")).agg(F.min("_at").alias("started"), F.max("_at").alias("ended"), F.count("*").alias("events"))


def ttl_hits(events: DataFrame, keys: list[str], ts: str, ttl_seconds: int) -> DataFrame:
    """Flag `hit`: the same key was seen at most ttl_seconds before."""
    w = Window.partitionBy(*keys).orderBy(ts, "event_id")
    at = F.unix_timestamp(ts)
    return events.withColumn("hit", F.coalesce(at - F.lag(at).over(w) <= ttl_seconds, F.lit(False)))


def transition_violations(events: DataFrame, key: str, ts: str, state: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Changes of state that are not among the allowed ones of the state before."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    before = F.lag(state).over(w)
    fine = F.lit(False)
    for a, b in allowed.items():
        fine = fine | ((F.col("previous") == a) & F.col(state).isin(*b))
    return events.withColumn("previous", before).where(F.col("previous").isNotNull() & ~fine)


def running_sum(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with the running sum of a column in an order of the whole table, without a window over the whole table.

    Rows are dealt into ranges of the order, each range is summed in its own tasks, and sums of ranges, one row each,
    say what comes before.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))  # a row for each range
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn(name, within).join(before, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def eviction_plan(items: DataFrame, budget: int) -> DataFrame:
    """items(item, size, last_accessed): most recently used stay while their sizes fit the budget, the rest go."""
    return running_sum(items, [F.desc("last_accessed"), F.asc("item")], "size", "held").withColumn("evict", F.col("held") > budget)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and of old whose key new doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def inverse_index(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sorted distinct values of each key."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("members"))


def weighted_rollup(reports: DataFrame, keys: list[str], rate: str, weight: str) -> DataFrame:
    return reports.groupBy(*keys).agg((F.sum(F.col(rate) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))).alias(rate), F.sum(weight).alias(weight))
