"""Helpers that several operators share: shared scratch tables, ASCII words, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that deletes the shuffle files of a query when it ends, not when the driver's collector gets to them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges that one task of connected_components takes, and its tasks at least.
EDGES_A_TASK, LEAST_TASKS = 100_000, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset (tests), a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes that are run within leave no shuffle files behind (Spark does not do so for checkpoint())."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it again, so that lost executors cost no lineage; and its path, for drop_scratch."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """stored() for a table that stays."""
    return stored(df, label)[0]


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder; Spark deletes the files when df is no longer used."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch path by Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def word_count(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of each node that has an edge.

    edges: columns src, dst of one orderable type, any direction, repeats and self loops allowed, no nulls.
    Returns (node, component), one row for each node of a non-loop edge.

    Alternating large-star and small-star rounds: each is one aggregation and one join, hubs are split by
    AQE's skew join, and the driver sees only a count and a checksum per round, in one query. The number of tasks that write a
    round's edges follows their number, so few edges don't leave a file in every shuffle partition.
    """
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()

    def settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
        """cut(edges), with the count and checksum that its own pass observes, so that a round is one query."""
        state = Observation()
        out = cut(edges.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
        return out, (state.get["n"], state.get["sum"])

    pairs, seen = settled(pairs)
    n = seen[0]
    for _ in range(max_rounds):
        tasks = max(LEAST_TASKS, min(most, n // EDGES_A_TASK + 1))
        pairs = pairs.coalesce(tasks)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        pairs, now = settled(small.coalesce(tasks))
        if now == seen:
            break
        seen, n = now, now[0]
    else:
        raise RuntimeError("connected components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
