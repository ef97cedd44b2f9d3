"""Near-duplicate documents by MinHash bands with sequential Bayesian verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import connected_components, cut, materialize

#: 128 hashes in 32 bands of 4: a pair of similarity 0.75 shares no band with probability 5e-6.
BANDS, ROWS = 32, 4
#: Words whose hashes a worker remembers.
MEMO_WORDS = 200_000
COEFFICIENTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, memo: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; of fewer words, of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((memo[w] for w in words), np.uint64, len(words))
    take = min(width, len(h))
    n = len(h) - take + 1
    total = np.full(n, take, np.uint64)
    for i in range(take):
        total = _mix(total + h[i : i + n] * COEFFICIENTS[i % len(COEFFICIENTS)] + np.uint64(i))
    return np.unique(total)


def _parameters(seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**63, BANDS * ROWS, np.uint64) | np.uint64(1), r.integers(0, 2**63, BANDS * ROWS, np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 512) -> np.ndarray:
    """The MinHash signature of a set of shingles, 32 bits a hash."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), chunk):
        np.minimum(low, (s[at : at + chunk, None] * a + b).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def sketch(docs: DataFrame, seed: int = 5) -> DataFrame:
    """For each row: doc_id, n_shingles, set_key (hash of the set), bands (8 bytes a band), sig (2 bytes a hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        a, b = _parameters(seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, keys, bands, sigs = [], [], [], []
                for t in part.column(1):
                    s = shingles(t.as_py(), memo)
                    n.append(len(s))
                    if len(s):
                        sig = signature(s, a, b)
                        rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
                        h = np.arange(BANDS, dtype=np.uint64)
                        for i in range(ROWS):
                            h = _mix(h * COEFFICIENTS[0] + rows[:, i] + np.uint64(1))
                        keys.append(xxhash.xxh128_digest(s.tobytes()))
                        bands.append(h.tobytes())
                        sigs.append(sig.astype(np.uint16).tobytes())
                    else:
                        keys.append(None), bands.append(None), sigs.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "bands", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands binary, sig binary")


def least_matches(compared: int, similarity: float, miss: float) -> int:
    """Fewest matches among `compared` hashes for which similarity >= `similarity` is not yet improbable.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) after m matches of n, and it exceeds t with
    the probability that a binomial of n + 1 trials at t has at most m successes. Pairs for which that is
    below `miss` are dropped.
    """
    total = 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * similarity**m * (1 - similarity) ** (compared + 1 - m)
        if total >= miss:
            return m
    return compared


def likely(pairs: DataFrame, classes: DataFrame, similarity: float, miss: float, step: int = 16) -> DataFrame:
    """Pairs (a, b) that the sequential comparison of their signatures doesn't drop, with the matches found."""
    limits = [(n, least_matches(n, similarity, miss)) for n in range(step, BANDS * ROWS + 1, step)]
    sig = classes.select("rep", "sig")
    joined = pairs.join(sig.withColumnsRenamed({"rep": "b", "sig": "sig_b"}), "b").join(sig.withColumnsRenamed({"rep": "a", "sig": "sig_a"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in batch.columns[2:])
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for n, least in limits:
                matches[alive] += (x[alive, n - step : n] == y[alive, n - step : n]).sum(1)
                alive = alive[matches[alive] >= least]
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(matches[alive])], ["a", "b", "matches"])

    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, matches long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    joined = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, left = WordHashes(), None, None
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                if text != last:  # rows come sorted by a
                    last, left = text, shingles(text, memo)
                right = shingles(batch.column(3)[i].as_py(), memo)
                both = len(np.intersect1d(left, right, assume_unique=True))
                good.append(bool(both) and 100 * both >= percent * (len(left) + len(right) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def shared_shingles(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """For each document of texts: rep, n (its shingles) and common (those that another document of texts has too).

    A document whose id is in `repeated` stands for several texts; all its shingles count as common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t.as_py(), memo) for t in part.column(1)]
                ids = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], ["rep", "shingle"])

    rows = texts.select("doc_id", "text").mapInArrow(run, "rep long, shingle long")
    owners = rows.groupBy("shingle").agg(F.min("rep").alias("rep"), F.count("*").alias("n")).where("n = 1")
    own = owners.groupBy("rep").agg(F.count("*").alias("own")).join(repeated.select(F.col("doc_id").alias("rep")), "rep", "left_anti")
    n = rows.groupBy("rep").agg(F.count("*").alias("n"))
    return n.join(own, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))


def rare_first(texts: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of the documents in reps, so many that a linked pair shares one: rep, shingle, place, n.

    Shingles are ordered by how many of these documents have them. A partner has percent % of a set at least,
    so it has one of the first n - ceil(n * percent / 100) + 1; shingles of one document only are left out.
    Rows of one doc_id with the same set count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t.as_py(), memo) for t in part.column(1)]
                n = [len(s) for s in sets]
                keys = [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
                columns = [np.repeat(part.column(0).to_numpy(), n), np.repeat(np.array(keys, np.uint64).view(np.int64), n), np.repeat(np.array(n, np.int64), n), np.concatenate(sets).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "text_key", "n", "shingle"])

    mixed = texts.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    repeated = texts.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    of = lambda docs: docs.mapInArrow(run, "rep long, text_key long, n long, shingle long")
    rows = of(mixed.join(repeated, "doc_id", "left_anti")).unionByName(of(mixed.join(repeated, "doc_id", "left_semi")).distinct())
    common = rows.groupBy("shingle").agg(F.count("*").alias("owners")).where("owners > 1")
    order = Window.partitionBy("rep", "text_key").orderBy(F.col("owners").asc_nulls_first(), "shingle")
    placed = rows.join(common, "shingle", "left").withColumn("place", F.row_number().over(order))
    return placed.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1) & F.col("owners").isNotNull()).select("rep", "shingle", "place", "n")


def possible(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be similar, of members(rep, part, outside).

    One of the two is outside the largest component of a bucket. They share one of their rarest shingles, at
    places that leave room for the similarity: with a shingle at place p the first to be shared, a set of size
    n shares n - p + 1 at most, and t * (n + m) / (1 + t) are needed with a set of size m.
    """
    rows = rare_first(texts, members.select("rep").distinct(), percent).join(members, "rep")
    most = F.floor((F.col("n") - F.col("place") + 1) * (100 + percent) / F.lit(percent) + 1e-9) - F.col("n")
    rows = rows.withColumn("most", most)
    x = rows.where("outside").select("shingle", F.col("rep").alias("x"), F.col("part").alias("x_part"), F.col("n").alias("x_n"), F.col("most").alias("x_most"))
    y = rows.select("shingle", "rep", "part", "n", "most")
    sizes = (100 * F.col("n") >= percent * F.col("x_n")) & (100 * F.col("x_n") >= percent * F.col("n"))
    on = (x["shingle"] == y["shingle"]) & (F.col("part") != F.col("x_part")) & (F.col("n") <= F.col("x_most")) & (F.col("x_n") <= F.col("most")) & sizes
    return x.join(y, on).select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = 1e-6, seed: int = 5) -> DataFrame:
    """Components of documents linked by 100 * |A & B| >= percent * |A | B| of their 5-word shingle sets.

    Returns a row for each row of docs(doc_id, text): doc_id, n_shingles, component_id (smallest doc_id
    reachable), kept (doc_id = component_id).

    Rows with the same set are one class, represented by its smallest doc_id. Classes that share a band are
    candidates. First each is compared with the most central class of its bucket, the one with the smallest
    share of shingles that no other candidate has. Then, where that leaves a bucket with several components,
    those outside its largest one are compared with classes of other components that share one of their rarest
    shingles, which every similar pair does. So a bucket of copies costs a pass over its members, and a link
    between components of a bucket is never missed. Candidates are pruned by `likely` with miss probability
    `miss`; survivors are compared on full sets, of the first kind only the best of each class.

    Null or empty text and text without words: n_shingles 0, its own component, kept. Null doc_id: component
    null, kept, and linked with nothing. Rows that share a doc_id are linked. An empty table gives no rows.
    Whole texts are read; other columns are ignored.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(sketch(named, seed), "near-sketch")
    known = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(known.groupBy("set_key", "bands", "sig").agg(F.min("doc_id").alias("rep")), "near-classes")
    key = lambda i: F.xxhash64(F.substring(F.col("bands"), i * 8 + 1, F.lit(8)))
    buckets = classes.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("bucket")
    buckets = materialize(buckets.join(shared, "bucket"), "near-buckets")
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    texts = named.join(wanted, "doc_id", "left_semi")
    texts = materialize(texts.join(repeated, "doc_id", "left_anti").unionByName(texts.join(repeated, "doc_id", "left_semi").distinct()), "near-texts")
    sizes = materialize(shared_shingles(texts, repeated), "near-sizes")

    central = F.struct((F.col("n") - F.col("common")) / F.col("n"), "rep")
    heads = buckets.join(sizes, "rep").groupBy("bucket").agg(F.min(central).alias("head")).select("bucket", F.col("head.rep").alias("head"))
    pairs = buckets.join(heads, "bucket").where("rep <> head").select(F.least("head", "rep").alias("a"), F.greatest("head", "rep").alias("b"), "rep").distinct()
    best = likely(pairs.select("a", "b").distinct(), classes, percent / 100, miss).join(pairs, ["a", "b"]).groupBy("rep").agg(F.max_by(F.struct("a", "b"), F.struct("matches", -F.col("a"), -F.col("b"))).alias("e")).select("e.*").distinct()
    several = known.join(repeated, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(classes.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    edges = cut(verified(best, texts, percent).select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(several))
    parts = cut(connected_components(edges))

    part_of = parts.select(F.col("node").alias("rep"), F.col("component").alias("part"))
    placed = buckets.join(part_of, "rep", "left").select("bucket", "rep", F.coalesce("part", "rep").alias("part"))
    counts = placed.groupBy("bucket", "part").agg(F.count("*").alias("members"))
    divided = counts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("members", "part")).alias("top")).where("parts > 1").select("bucket", F.col("top.part").alias("main"))
    mixed = placed.join(divided, "bucket").groupBy("rep", "part").agg(F.bool_or(F.col("part") != F.col("main")).alias("outside"))
    crossing = possible(mixed, texts, percent)
    more = cut(verified(likely(crossing, classes, percent / 100, miss), texts, percent).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    parts = cut(connected_components(more.unionByName(parts.select(F.col("node").alias("src"), F.col("component").alias("dst")))))

    part_of = parts.select(F.col("node").alias("rep"), F.col("component").alias("part"))
    class_part = classes.join(part_of, "rep", "left").select("set_key", F.coalesce("part", "rep").alias("part"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(class_part, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least("doc_id", F.coalesce("part", "doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that near_duplicates does not keep, and one row of each doc_id; same columns.

    Of rows that share a doc_id the one with the smallest hash of all its columns stays, so reruns agree. Rows
    with null doc_id stay.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns)))
    one = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").withColumn("_quill_place", place).where("_quill_place = 1")
    return one.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
