"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, word_count

#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """Targets of sources: one row (source, source_size, rows, source_no, target) for each source.

    Sources in code-point order, null last, get the weights in turn. They share `share` times all words by
    weight; a target stops at `repeats` times its source's size and the excess is dealt out again by weight
    until none is above. Sorted by cap / weight, the level at which the rest share evenly has a closed form, so
    no rounds are needed.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = by_source.withColumn("source_no", place).withColumn("weight", F.element_at(cycle, F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1))
    t = t.withColumn("cap", F.col("source_size") * repeats).withColumn("budget", F.sum("source_size").over(everything) * share)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    t = t.withColumn("open", F.col("level") <= F.col("cap") / F.col("weight")).withColumn("order", F.row_number().over(by_ratio))
    t = t.withColumn("level", F.min_by("level", F.when(F.col("open"), F.col("order"))).over(everything))
    return t.select("source", "source_size", "rows", "source_no", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def _served(limit: Column, start: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(size, limit - start))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 17, bucket_rows: int = 50_000) -> DataFrame:
    """Weighted fair queueing of documents: one row for each row of docs, in order of virtual finish time.

    Returns doc_id, source, size, source_size, target, virtual_start, virtual_finish (of the first copy) and
    taken, the words that the mix takes of all copies of the row.

    Within its source a document stands at the place its seeded hash gives (60 bits of the MD5 of doc_id, size and
    seed, which SQL has too). Its first copy is served from
    virtual time start / target to end / target, where start and end are the source's cumulative words; its
    next copies follow after a whole pass of the source. The budget, the sum of all targets, ends at virtual
    time 1: copies that finish by then are taken whole, the copy in service is cut there, later ones are not
    taken. So each source gives its target to within rounding.

    Cumulative words are a two-level prefix sum: hash buckets of about bucket_rows rows, split further with
    the source's size, so a source with a third of all rows is spread over many tasks.

    Null text and text without words: size 0, taken 0. Null source: a source of its own, last in order. Null
    doc_id and repeated rows: each row is a document. An empty table gives no rows. Other columns are ignored.
    """
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, repeats), "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    t = targets.select(F.col("source").alias("t_source"), "source_size", "source_no", "target", F.ceil(F.col("rows") / F.lit(bucket_rows)).alias("buckets"))
    placed = sizes.join(t, sizes["source"].eqNullSafe(t["t_source"])).drop("t_source")
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string"), F.lit(str(seed)))
    placed = placed.withColumn("place", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"))
    placed = placed.withColumn("bucket", F.floor(F.col("place") / F.lit(2.0**60) * F.col("buckets")))
    sums = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.sum("size").over(inside)).join(sums, ["source_no", "bucket"])
    start = F.col("ahead") + F.col("end") - F.col("size")
    limit = F.round("target").cast("long")
    taken = _served(limit, start, F.col("size"))
    for copy in range(1, repeats):
        taken = taken + _served(limit, start + copy * F.col("source_size"), F.col("size"))
    at = lambda words: F.when(F.col("target") > 0, words / F.col("target"))
    out = placed.select("doc_id", "source", "size", "source_size", "target", at(start).alias("virtual_start"), at(start + F.col("size")).alias("virtual_finish"), taken.cast("long").alias("taken"))
    return out.orderBy("virtual_finish", "doc_id")
