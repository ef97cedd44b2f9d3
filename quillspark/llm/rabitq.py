"""Approximate nearest neighbours with randomly rotated one-bit codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The centre of the codes is the mean of at most this many vectors, those of smallest hash.
CENTRE_SAMPLE = 4096


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same dim and seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of uint64 words."""
    n, d = bits.shape
    words = -(-d // 64)
    out = np.zeros((n, words * 64), np.uint8)
    out[:, :d] = bits
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null, not empty, not zero and has only finite components, and whose id is not null."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))


def _once(rows: DataFrame) -> DataFrame:
    """rows with repeats of an id and vector once; ids are counted first, as vectors need only be dealt out where some repeat."""
    if rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.dropDuplicates(["vec_id", "embedding"])


def build_index(vectors: DataFrame, dim: int, seed: int = 11) -> tuple[DataFrame, np.ndarray]:
    """The code of every vector: vec_id, embedding, code (packed bits), norm (distance from the centre), corr; and the centre.

    A vector minus the centre, made a unit vector o, is rotated; its code is the signs of the components,
    standing for the unit vector x with components +-1/sqrt(dim). corr is <x, o>, the correction by which an
    inner product with the code is divided.
    """
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(CENTRE_SAMPLE)
    means = sample.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()
    centre = np.array([r["x"] for r in means] or [0.0] * dim)
    turn = rotation(dim, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            off = _matrix(b.column(1), dim) - centre
            norm = np.linalg.norm(off, axis=1)
            o = (off / np.where(norm > 0, norm, 1)[:, None]) @ turn
            bits = o >= 0
            corr = np.abs(o).sum(1) / math.sqrt(dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in _pack(bits)], pa.binary()), pa.array(norm), pa.array(corr)], ["vec_id", "embedding", "code", "norm", "corr"])

    return vectors.mapInArrow(run, f"vec_id long, embedding {vectors.schema['embedding'].dataType.simpleString()}, code binary, norm double, corr double"), centre


def nearest(block: dict, queries: tuple[np.ndarray, np.ndarray], k: int, seed: int, eps: float, chunk: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of one block of coded vectors for each query: query ids, vector ids, distances.

    With y the rotated unit query on 4-bit steps, <x, y> comes from popcounts of the code with the four bit
    planes of y. <o, y> is estimated as <x, y> / corr, and lies within
    eps * sqrt((1 - corr^2) / corr^2 / (dim - 1)) of it but for a small chance. The k smallest estimates are
    measured exactly; every vector whose lower bound does not exceed the k-th exact distance, or has none as squares
    overflow, is measured too. Where ids repeat, k is multiplied by the most vectors an id has, so that k ids are found.
    """
    ids, vectors, codes, norm, corr, centre = (block[n] for n in ("ids", "vectors", "codes", "norm", "corr", "centre"))
    q_ids, q_vectors = queries
    dim, n = vectors.shape[1], len(ids)
    k *= int(np.unique(ids, return_counts=True)[1].max())
    turn = rotation(dim, seed)
    ones = np.bitwise_count(codes).sum(1).astype(np.float64)
    safe = np.where(corr > 0, corr, 1)
    slack = eps * np.sqrt(np.maximum(0, 1 - safe**2)) / safe / math.sqrt(max(1, dim - 1))
    slack = np.where(corr > 0, slack, 2.0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q_ids), chunk):
        off = q_vectors[at : at + chunk] - centre
        q_norm = np.linalg.norm(off, axis=1)
        y = (off / np.where(q_norm > 0, q_norm, 1)[:, None]) @ turn
        low, step = y.min(1), np.maximum((y.max(1) - y.min(1)) / 15, 1e-12)
        u = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint8)
        dots = np.zeros((len(y), n))
        for j in range(4):
            plane = _pack((u >> j) & 1)
            for w in range(codes.shape[1]):
                dots += np.multiply(np.bitwise_count(codes[None, :, w] & plane[:, None, w]), 1 << j, dtype=np.float64)  # a byte holds no more than 255
        # <x, y> = (2 * sum of y over set bits - sum of y) / sqrt(dim), with y = low + step * u
        inner = (2 * (low[:, None] * ones + step[:, None] * dots) - y.sum(1)[:, None]) / math.sqrt(dim) / safe
        base = norm**2 + (q_norm**2)[:, None]
        scale = 2 * q_norm[:, None] * norm
        estimate, bound = base - scale * inner, base - scale * (inner + slack + step[:, None])
        for i, q in enumerate(q_ids[at : at + chunk]):
            own = ids == q
            guess = np.where(own, np.inf, np.nan_to_num(estimate[i], nan=np.finfo(float).max))
            least = min(k, n - int(own.sum()))
            if least <= 0:
                continue
            first = np.argpartition(guess, least - 1)[:least]
            limit = ((vectors[first] - q_vectors[at + i]) ** 2).sum(1).max()
            pick = np.flatnonzero(~own & ~(bound[i] > limit * (1 + 1e-9)))
            pick = np.union1d(pick, first)
            d = np.sqrt(((vectors[pick] - q_vectors[at + i]) ** 2).sum(1))
            order = np.lexsort((ids[pick], d))[:k]
            out.append((np.full(len(order), q), ids[pick][order], d[order]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _within(vectors: DataFrame, queries: DataFrame, dim: int, v_blocks: int, q_blocks: int, k: int, seed: int, eps: float) -> DataFrame:
    """The k nearest of each block of vectors for each query, all of one length: query_id, vec_id, score."""
    index, centre = build_index(vectors, dim, seed)
    left = index.withColumn("v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(v_blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = queries.withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(q_blocks)).cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(v_blocks - 1).cast("long"))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if a.num_rows and b.num_rows:
            a, b = a.combine_chunks(), b.combine_chunks()
            one = lambda t, n: t.column(n).combine_chunks() if isinstance(t.column(n), pa.ChunkedArray) else t.column(n)
            codes = np.frombuffer(b"".join(one(a, "code").to_pylist()), np.uint64).reshape(a.num_rows, -1)
            block = {"ids": one(a, "vec_id").to_numpy(), "vectors": _matrix(one(a, "embedding"), dim), "codes": codes, "norm": one(a, "norm").to_numpy(), "corr": one(a, "corr").to_numpy(), "centre": centre}
            found = nearest(block, (one(b, "vec_id").to_numpy(), _matrix(one(b, "embedding"), dim)), k, seed, eps)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, seed: int = 11, eps: float = 2.2, block_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """The k nearest of vectors(vec_id, embedding) for each row of queries(vec_id, embedding).

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance of the original vectors in double
    precision), nearest first and ties to the smaller vec_id. A query's own vec_id is no candidate.

    Every vector is indexed. Codes are dealt in hash blocks of about block_rows, queries in blocks of about
    query_rows, and each pair of blocks is one bounded group; the k best of the blocks are then merged.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with null vec_id, take
    no part. A vector is compared with those of its own length, each length having an index of its own; lengths are
    few, as each adds to the plan. Copies of a vector under other ids are all candidates; repeated rows count once,
    in queries too. Fewer than k candidates: all of them. No queries or no vectors: no rows.
    """
    spark = vectors.sparkSession
    good, ask = _once(usable(vectors)), _once(usable(queries))
    of_length = lambda rows, n: rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias(n))
    lengths = of_length(good, "rows").join(of_length(ask, "asked"), "dim").orderBy("dim").collect()  # a row for each length
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "array<float>" if {df.schema["embedding"].dataType.simpleString() for df in (vectors, queries)} == {"array<float>"} else "array<double>"
    good, ask = (df.select("vec_id", F.col("embedding").cast(kind).alias("embedding")) for df in (good, ask))
    same = lambda rows, dim: rows.where(F.size("embedding") == dim)
    parts = [_within(same(good, r["dim"]), same(ask, r["dim"]), r["dim"], math.ceil(r["rows"] / block_rows), math.ceil(r["asked"] / query_rows), k, seed, eps) for r in lengths]
    found = reduce(DataFrame.unionByName, parts)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # an id may have several vectors
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
