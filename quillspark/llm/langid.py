"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets of n-grams.
BUCKETS = 1 << 14
#: The classifier is fitted on at most this many rows of each language, those of smallest hash.
ROWS_PER_LANGUAGE = 1000
UNKNOWN = "und"


class Grams:
    """Distinct hashed n-grams, of 1 to 3 characters, of lower-cased words with a space on either side."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, counts); both empty where the text has no letter."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[c]
        if not letter.any():
            return none, none
        c = np.where(letter, c, np.uint32(32))
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first other character after a letter stays, as a space
        c = np.concatenate([[np.uint32(32)], c[keep], [np.uint32(32)]]).astype(np.uint32)
        a, b, d = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77), c * np.uint32(0xC2B2AE3D)
        two = a[:-1] ^ (b[1:] + np.uint32(0x27D4EB2F))
        three = (two[:-1] * np.uint32(0x165667B1)) ^ (d[2:] + np.uint32(0x9E3779B9))
        h = np.concatenate([a, two * np.uint32(0xC2B2AE35), three * np.uint32(0x85EBCA6B)])
        counts = np.bincount(h >> np.uint32(18), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        return at, counts[at]


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length, term frequency damped by a logarithm."""
    x = (1 + np.log(counts)) * idf
    norm = np.sqrt((x * x).sum())
    return x / norm if norm > 0 else x


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def probabilities(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = weigh(counts, self.idf[buckets]) @ self.weights[buckets] / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float, beta: float, l1: float, l2: float, passes: int) -> np.ndarray:
    """Weights by follow-the-regularised-leader with per-coordinate rates and elastic-net penalties."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def solve(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for at, x, y in rows:
            w = solve(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[at] = new
    return solve(slice(None))


def train(docs: DataFrame, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, passes: int = 3, seed: int = 3) -> LanguageModel | None:
    """Learn from docs(doc_id, text, lang) with text and lang not null; None if there are none.

    Document frequencies are counted over all of docs. Weights are fitted on at most ROWS_PER_LANGUAGE rows of
    each language; every fifth of those is kept back to fit the temperature.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df, total = Grams(), np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                at, _ = grams(t.as_py())
                df[at] += 1
                total += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], total))], ["bucket", "n"])

    counted = known.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = int(counted.loc[counted["bucket"] == -1, "n"].sum())
    if not total:
        return None
    df = np.zeros(BUCKETS)
    counted = counted[counted["bucket"] >= 0]
    df[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1

    row = F.xxhash64("doc_id", "lang", "text").alias("row")
    each = known.where(F.col("doc_id").isNotNull()).select("doc_id", "lang", row).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "row")
    chosen = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ROWS_PER_LANGUAGE).select("row")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            rows = [grams(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([a.astype(np.uint16).tobytes() for a, _ in rows], pa.binary()), pa.array([n.astype(np.float32).tobytes() for _, n in rows], pa.binary())], ["doc_id", "lang", "buckets", "counts"])

    # the broadcast holds at most ROWS_PER_LANGUAGE numbers of each language, and as many rows are collected: repeats
    # of a row go, and other rows of its doc_id are not joined. A row has at most BUCKETS buckets of six bytes.
    fitted = known.withColumn("row", row).join(F.broadcast(chosen), "row").dropDuplicates(["row"])
    sample = fitted.select("doc_id", "text", "lang").mapInArrow(features, "doc_id long, lang string, buckets binary, counts binary").collect()
    sample.sort(key=lambda r: ((r["doc_id"] * 0x9E3779B97F4A7C15) % 2**64, r["doc_id"], r["lang"], r["buckets"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return None
    place = {x: i for i, x in enumerate(languages)}
    rows = []
    for r in sample:
        at = np.frombuffer(r["buckets"], np.uint16).astype(np.int64)
        if len(at):
            rows.append((at, weigh(np.frombuffer(r["counts"], np.float32).astype(float), idf[at]), place[r["lang"]]))
    fit = [r for i, r in enumerate(rows) if i % 5] or rows
    kept = [r for i, r in enumerate(rows) if i % 5 == 0] or rows
    weights = _ftrl(fit, len(languages), alpha, beta, l1, l2, passes)
    temperature = 1.0
    if kept:
        logits, y = np.array([x @ weights[at] for at, x, _ in kept]), np.array([c for _, _, c in kept])
        best = np.inf
        for t in np.geomspace(0.02, 20, 121):
            s = logits / t
            loss = (np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y]).mean()
            if loss < best:
                best, temperature = loss, float(t)
    return LanguageModel(languages, idf, weights.astype(np.float64), temperature)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """lang_pred and score of the whole text of every row of docs(doc_id, text): doc_id, lang_pred, score.

    Null texts, texts without a letter, and all texts if nothing could be learned, get `und` and score 0.
    Equal scores go to the language that sorts first.
    """
    # the model is BUCKETS rows of one number for each language
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Grams(), shared.value
        for b in batches:
            names, scores = [], []
            for t in b.column(1):
                at, counts = grams(t.as_py())
                if not len(at) or m is None:
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                p = m.probabilities(at, counts)
                i = int(p.argmax())
                names.append(m.languages[i]), scores.append(float(p[i]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str, parts: int, part: int):
    """Whether crc32 of the id's text is `part` modulo `parts`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows of docs(doc_id, text, lang) that are not held out and have an id, and predict all rows.

    Returns doc_id, held_out, lang_pred, score; see predict. Repeated rows are each predicted. An empty table
    gives no rows. lang, source and doc_id are no inputs of a prediction; other columns are ignored.
    """
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1)))
    return predict(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
