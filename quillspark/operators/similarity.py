"""Similar names and texts: overlap joins with prefix filters, matching-block ratios, and repeats of texts kept before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.concepts import holding_pairs, joined
from quillspark.sources.scratch import checkpointed

#: Bins in which trigrams are counted to bound ratios. A collision makes the bound looser, never wrong.
BINS = 4096
#: Lengths of the runs of characters that are counted, one after the other, before a ratio of texts is measured: texts of a language share most trigrams, but few longer runs.
LONG_GRAMS = (6, 8)


def matching_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks by the length of both: the longest block, then those left and right of it, and so on."""
    return SequenceMatcher(None, a, b).ratio()


def trigrams(text: str) -> np.ndarray:
    """How often trigrams of characters fall into each of BINS bins."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.bincount((c[:-2] * 1_000_003 + c[1:-1] * 10_007 + c[2:]) % BINS, minlength=BINS).astype(np.int32) if len(c) > 2 else np.zeros(BINS, np.int32)


def possible(lengths: np.ndarray, counts: np.ndarray, length: int, count: np.ndarray, least: float) -> np.ndarray:
    """Which of several texts can have a ratio of `least` with one text, by lengths and trigram counts.

    m characters of s in both match if the ratio is 2m/s. At most u = s - 2m are left over, and two blocks in a row
    have one of them between, so there are at most u + 1 blocks, which share m - 2(u + 1) trigrams or more.
    """
    s = lengths + length
    m = np.floor(least * s / 2 - 1e-6)
    shared = np.minimum(counts, count).sum(axis=1)
    return (np.minimum(lengths, length) >= m) & (shared >= m - 2 * (s - 2 * m + 1))


def long_grams(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of n characters of a text as numbers, each once in order, and how often they occur."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = np.zeros(max(len(c) - n + 1, 0), np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + len(h)]
    return np.unique(h, return_counts=True)


def still_possible(a: str, b: str, a_grams: tuple[np.ndarray, np.ndarray], b_grams: tuple[np.ndarray, np.ndarray], n: int, least: float) -> bool:
    """Whether two texts can have a ratio of `least` by runs of n characters: as in `possible`, u + 1 blocks share m - (n - 1)(u + 1) of them or more."""
    s = len(a) + len(b)
    m = np.floor(least * s / 2 - 1e-6)
    _, x, y = np.intersect1d(a_grams[0], b_grams[0], assume_unique=True, return_indices=True)
    return np.minimum(a_grams[1][x], b_grams[1][y]).sum() >= m - (n - 1) * (s - 2 * m + 1)


def overlap_pairs(left: DataFrame, right: DataFrame, least: Callable[[Column], Column]) -> DataFrame:
    """Pairs of sets that may share enough items, with how many they share: left_id, right_id, shared, left_size, right_size. left, right: id and items (a set each).

    least gives, for the size of a set, how many items it shares with any partner that counts, 1 at least. Items
    stand in one order, rarest first, and a set of n items looks for partners under its first n - least(n) + 1: two
    sets that share least items meet under one of those. How many they share is
    counted on whole sets; the caller keeps what is enough.
    """
    known = right.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("sets"))

    def prefix(sets: DataFrame, name: str) -> DataFrame:
        n = F.size("items")
        items = sets.select(F.col("id").alias(name), n.alias("n"), least(n).cast("int").alias("least"), F.explode("items").alias("item")).join(known, "item")
        order = Window.partitionBy(name).orderBy("sets", "item")
        return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("n") - F.col("least") + 1).select(name, "item")

    met = prefix(left, "left_id").join(prefix(right, "right_id"), "item").select("left_id", "right_id").distinct()
    full = met.join(left.select(F.col("id").alias("left_id"), F.col("items").alias("a")), "left_id").join(right.select(F.col("id").alias("right_id"), F.col("items").alias("b")), "right_id")
    shared = F.size(F.array_intersect("a", "b")).cast("long").alias("shared")
    return full.select("left_id", "right_id", shared, F.size("a").alias("left_size"), F.size("b").alias("right_size"))


def _bigrams(name: Column) -> Column:
    """Pairs of characters, the second and later of a kind with their number, so that a set of them counts repeats."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i, F.lit(2)))
    return T.bound(pairs, lambda p: F.transform(p, lambda x, i: F.concat(x, F.size(F.filter(F.slice(p, F.lit(1), i), lambda y: y == x)).cast("string"))))


def fuzzy_names(asked: DataFrame, names: DataFrame, least: float = 0.82) -> DataFrame:
    """Names that match a name asked for: asked, name, how (equal, contained or similar), ratio (null unless similar).

    asked and names have a column `name` of normalised names. A name matches if it is equal, if either contains the
    other, or if their matching ratio is `least` (above 2/3) or more. Null and empty names match nothing; repeated
    names count once. No pair is formed but under a shared n-gram that one of them has among its rarest ones: by the
    rule of `possible`, with pairs of characters, names of s characters in both share s(3r/2 - 1) - 1 pairs or more,
    and the shortest partner of a name of n has nr/(2 - r); names of two characters or fewer must be equal.
    """
    a, b = (df.select(F.col("name").alias("key")).where("key <> ''").distinct() for df in (asked, names))
    equal = a.join(b, "key").select(F.col("key").alias("asked"), F.col("key").alias("name"), F.lit("equal").alias("how"))
    one = F.lit(0).alias("g")
    parts = holding_pairs(a.select(one, "key"), b.select(one, "key"), ["g"]).select(F.col("part").alias("asked"), F.col("whole").alias("name"))
    wholes = holding_pairs(b.select(one, "key"), a.select(one, "key"), ["g"]).select(F.col("whole").alias("asked"), F.col("part").alias("name"))
    contained = parts.unionByName(wholes).withColumn("how", F.lit("contained"))
    sets = lambda df: df.where(F.length("key") > 2).select(F.col("key").alias("id"), _bigrams(F.col("key")).alias("items"))
    shared = lambda n: F.greatest(F.ceil(2 * (n + 1) * (1.5 * least - 1) / (2 - least) - 1 - 1e-9), F.lit(1))
    met = overlap_pairs(sets(a), sets(b), shared).select(F.col("left_id").alias("asked"), F.col("right_id").alias("name"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratios = [matching_ratio(y.as_py(), x.as_py()) for x, y in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ratios, pa.float64())], ["asked", "name", "ratio"])

    near = met.where("asked <> name and not contains(asked, name) and not contains(name, asked)").mapInArrow(measure, "asked string, name string, ratio double").where(F.col("ratio") >= least)
    plain = equal.unionByName(contained).withColumn("ratio", F.lit(None).cast("double"))
    return plain.unionByName(near.select("asked", "name", F.lit("similar").alias("how"), "ratio"))


class Recent:
    """The last texts of a bucket that were kept, with what bounds their ratios."""

    def __init__(self, texts: list[str], last: int, least: float) -> None:
        self._last, self._least = last, least
        self._counts, self._lengths, self.texts = np.zeros((last, BINS), np.int32), np.zeros(last, np.int64), []
        self._grams: list[dict] = [{} for _ in range(last)]
        for t in texts:
            self.add(t)

    def add(self, text: str) -> None:
        at = len(self.texts) % self._last
        self._counts[at], self._lengths[at], self._grams[at] = trigrams(text), len(text), {}
        self.texts.append(text)

    def tail(self) -> list[str]:
        return self.texts[-self._last :]

    def repeats(self, text: str) -> bool:
        n = min(len(self.texts), self._last)
        may = np.flatnonzero(possible(self._lengths[:n], self._counts[:n], len(text), trigrams(text), self._least))
        newest, own = len(self.texts) - 1, {}

        def near(at: int) -> bool:
            other = self.texts[newest - (newest - at) % self._last]
            for n in LONG_GRAMS:
                if n not in own:
                    own[n] = long_grams(text, n)
                if n not in self._grams[at]:
                    self._grams[at][n] = long_grams(other, n)
                if not still_possible(text, other, own[n], self._grams[at][n], n, self._least):
                    return False
            return matching_ratio(text, other) >= self._least

        return any(near(i) for i in may.tolist())


def near_repeats(rows: DataFrame, keys: list[str], last: int = 40, least: float = 0.95, ranges: int | None = None, max_rounds: int = 1000) -> DataFrame:
    """Whether each row of rows(keys, doc_id, text) repeats an earlier one: doc_id, text_key (hash of its text), status.

    In order of doc_id, a row is `exact` if its normalised text has come before, whatever its keys; else `near` if its
    matching ratio with one of the last `last` texts of its bucket (rows of equal keys, nulls included) that were
    kept is `least` or more; else `kept`. Null texts count as empty. Of rows that share doc_id and text one, of
    the first bucket, is returned; rows that share a doc_id alone are ordered by text_key. An empty table gives no rows.

    What is kept hangs on what was kept before. So that a bucket isn't one task's work, rows are dealt into ranges of
    (bucket, doc_id), and every range is folded at once as if it were the first. Then ranges whose bucket began
    earlier are folded again from the texts the range before ended with, until none begins with other texts than
    before. A range seldom ends otherwise because it began otherwise, so few are folded twice. The first range is right
    after a round, each next one a round later at most, so the end is that of one long fold. There are as many ranges
    as shuffle partitions unless `ranges` says how many.
    """
    bucket = F.to_json(F.struct(*keys)) if keys else F.lit("")
    norm = rows.select(bucket.alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), T.normalize_text("text").alias("text"))
    # all but the folds goes by keys, as texts take disk each time they are dealt
    both = ["doc_id", "text_key"]
    known = checkpointed(norm.select(*both, "bucket", F.unhex(F.sha2("text", 256)).alias("hash")).groupBy(*both).agg(F.min("bucket").alias("bucket"), F.min("hash").alias("hash")))
    first = known.groupBy("hash").agg(F.min(F.struct(*both)).alias("at")).select("at.doc_id", "at.text_key")
    exact = joined(known, first, both, "left_anti").select(*both, F.lit("exact").alias("status"))
    order = ("bucket", "doc_id", "text_key")
    rest = joined(known, first, both, "left_semi").select(*order)
    parts = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = checkpointed(rest.repartitionByRange(parts, *order).select("*", F.spark_partition_id().alias("part")))
    dealt = checkpointed(joined(norm, places, list(order), "inner"))
    placed = checkpointed(places.select("bucket", "part").distinct().withColumn("before", F.lag("part").over(Window.partitionBy("bucket").orderBy("part"))))
    schema = "bucket string, part int, doc_id long, text_key long, kept boolean, state array<string>"
    target = pa.schema([("bucket", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("kept", pa.bool_()), ("state", pa.list_(pa.string()))])

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return target.empty_table()
        left = left.sort_by([("doc_id", "ascending"), ("text_key", "ascending")])
        if left.column("doc_id").null_count:  # nulls come first in Spark's order
            left = pa.concat_tables([left.filter(pa.compute.is_null(left.column("doc_id"))), left.filter(pa.compute.is_valid(left.column("doc_id")))])
        at = list(zip(*[left.column(c).to_pylist() for c in both], strict=True))
        left = left.take([i for i in range(len(at)) if not i or at[i] != at[i - 1]])  # each text of a doc_id once
        recent, kept = Recent(right.column("state")[0].as_py() if right.num_rows else [], last, least), []
        for text in left.column("text").to_pylist():
            kept.append(not recent.repeats(text))
            if kept[-1]:
                recent.add(text)
        n = left.num_rows
        ids = [left.column(c).to_pylist() for c in ("bucket", "part", "doc_id", "text_key")]
        return pa.Table.from_arrays([pa.array([*x, end], t) for x, end, t in zip([*ids, kept, [None] * n], [ids[0][0], ids[1][0], None, None, None, recent.tail()], target.types, strict=True)], schema=target)

    def folded(some: DataFrame, states: DataFrame) -> DataFrame:
        begins = states.select(F.col("bucket").alias("to_bucket"), F.col("part").alias("to_part"), "state")
        return checkpointed(some.groupBy("bucket", "part").cogroup(begins.groupBy("to_bucket", "to_part")).applyInArrow(fold, schema))

    on = ["bucket", "part"]
    used = placed.select(*on, F.array().cast("array<string>").alias("state"))
    done = folded(dealt, used.limit(0))
    for _ in range(max_rounds):
        ends = done.where("state is not null").select("bucket", F.col("part").alias("before"), "state")
        begins = placed.where("before is not null").join(ends, ["bucket", "before"]).select(*on, "state")
        changed = checkpointed(begins.join(used.select(*on, F.col("state").alias("old")), on).where("state <> old").select(*on, "state"))
        if changed.isEmpty():
            kept = done.where("kept is not null").select(*both, F.when(F.col("kept"), "kept").otherwise("near").alias("status"))
            return kept.unionByName(exact)
        again = folded(dealt.join(changed.select(*on), on, "left_semi"), changed)
        done = checkpointed(done.join(changed.select(*on), on, "left_anti").unionByName(again))
        used = checkpointed(used.join(changed.select(*on), on, "left_anti").unionByName(changed))
    raise RuntimeError("repeats did not settle")
