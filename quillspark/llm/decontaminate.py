"""Benchmark decontamination: BM25 with block-max WAND over test items, then question and answer overlap."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one broadcast index have at most about this many postings; more items are taken in several passes.
SHARD_POSTINGS = 1_000_000
#: Items of a block of postings.
BLOCK_ITEMS = 16
_SPACES = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; every ASCII character that is no letter or digit separates words."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split() if text else []


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of an item's question, all sentences but the last, and of its answer, the last sentence.

    An item of one sentence has its last third as the answer.
    """
    parts = [w for w in (words(s) for s in re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    w = parts[0] if parts else []
    cut = len(w) - max(1, len(w) // 3)
    return w[:cut], w[cut:]


def grams(w: list[bytes], n: int = 3) -> set:
    n = min(n, len(w))
    return set(zip(*(w[i:] for i in range(n)), strict=False)) if n else set()


def overlap(part: list[bytes], seen: list[bytes]) -> float:
    """Share of a part's distinct word trigrams (shorter parts: of the whole part) that occur in `seen`."""
    own = grams(part)
    return len(own & grams(seen, min(3, len(part)))) / len(own) if own else 1.0


@dataclass
class Index:
    """A BM25 index of test items. Weights are shares of the item's score against itself.

    Common terms that even together stay below the threshold in every item are not looked up: a passage can
    only reach the threshold for an item by at least one of the other terms. `rest` is what the common terms
    can add at most for an item, `rest_block` for a block of items.
    """

    item_ids: np.ndarray
    items: list[dict[bytes, float]]
    parts: list[tuple[list[bytes], list[bytes]]]
    terms: dict[bytes, int]
    starts: np.ndarray
    post_item: np.ndarray
    post_weight: np.ndarray
    block_starts: np.ndarray
    block_no: np.ndarray
    block_max: np.ndarray
    rest: np.ndarray
    rest_block: np.ndarray
    threshold: float
    width: int


def build_index(rows: list[tuple[int, str, list[tuple[str, float]]]], commonness: dict[bytes, int], threshold: float, width: int) -> Index:
    """rows: (item_id, text, [(term, BM25 weight)]). commonness: items that have the term."""
    items = []
    for _, _, weights in rows:
        total = sum(w for _, w in weights) or 1.0
        items.append({t.encode(): w / total for t, w in weights})
    postings: dict[bytes, list[tuple[int, float]]] = {}
    for i, item in enumerate(items):
        for t, w in item.items():
            postings.setdefault(t, []).append((i, w))
    rest = np.zeros(len(items))
    lookup = []
    for t in sorted(postings, key=lambda t: (-commonness.get(t, 0), t)):
        if max(rest[i] + w for i, w in postings[t]) < 0.9 * threshold:
            for i, w in postings[t]:
                rest[i] += w
        else:
            lookup.append(t)
    starts, at, weight, block_starts, block_no, block_max = [0], [], [], [0], [], []
    for t in lookup:
        for i, w in postings[t]:
            at.append(i), weight.append(w)
            if len(block_no) > block_starts[-1] and block_no[-1] == i // BLOCK_ITEMS:
                block_max[-1] = max(block_max[-1], w)
            else:
                block_no.append(i // BLOCK_ITEMS), block_max.append(w)
        starts.append(len(at)), block_starts.append(len(block_no))
    blocks = -(-len(items) // BLOCK_ITEMS)
    rest_block = np.array([rest[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS].max() for b in range(blocks)])
    ints = lambda x: np.array(x, np.int64)
    return Index(ints([r[0] for r in rows]), items, [split_item(r[1]) for r in rows], {t: i for i, t in enumerate(lookup)}, ints(starts), ints(at), np.array(weight), ints(block_starts), ints(block_no), np.array(block_max), rest, rest_block, threshold, width)


def _expand(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `which`, all positions of its list: (index into which, position)."""
    n = starts[which + 1] - starts[which]
    owner = np.repeat(np.arange(len(which)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[which], n)


def retrieve(w: list[bytes], index: Index) -> list[tuple[int, int, float]]:
    """(passage, item, score) of all passages of a document and items with score >= threshold.

    Passages are `width` words long, each beginning half a width after the last, so an item of half a width
    lies whole in one. For all passages at once: blocks of items whose block maxima can't reach the threshold
    are skipped, then items whose weights with what common terms may add can't; the rest are scored in full.
    """
    term = np.fromiter((index.terms.get(x, -1) for x in w), np.int64, len(w))
    at = np.flatnonzero(term >= 0)
    if not len(at):
        return []
    half = index.width // 2
    last = max(0, -(-(len(w) - index.width) // half))
    passage = np.minimum(at // half, last)
    before = (at // half >= 1) & (at // half - 1 <= last)
    p = np.concatenate([passage, at[before] // half - 1])
    t = np.concatenate([term[at], term[at[before]]])
    pairs = np.unique(p * len(index.terms) + t)
    p, t = pairs // len(index.terms), pairs % len(index.terms)
    blocks = len(index.rest_block)
    owner, pos = _expand(index.block_starts, t)
    key, where = np.unique(p[owner] * blocks + index.block_no[pos], return_inverse=True)
    bound = np.bincount(where, index.block_max[pos]) + index.rest_block[key % blocks]
    open_blocks = key[bound >= index.threshold - 1e-9]
    if not len(open_blocks):
        return []
    used = np.isin(p, open_blocks // blocks)
    p, t = p[used], t[used]
    owner, pos = _expand(index.starts, t)
    item = index.post_item[pos]
    inside = np.isin(p[owner] * blocks + item // BLOCK_ITEMS, open_blocks)
    owner, pos, item = owner[inside], pos[inside], item[inside]
    key, where = np.unique(p[owner] * len(index.items) + item, return_inverse=True)
    bound = np.bincount(where, index.post_weight[pos]) + index.rest[key % len(index.items)]
    found, seen_of, seen = [], -1, set()
    for k in key[bound >= index.threshold - 1e-9]:
        passage, i = divmod(int(k), len(index.items))
        if passage != seen_of:
            seen_of, seen = passage, set(w[passage * half : passage * half + index.width])
        score = sum(x for word, x in index.items[i].items() if word in seen)
        if score >= index.threshold:
            found.append((passage, i, score))
    return found


def _shards(items: DataFrame, threshold: float, k1: float = 1.2, b: float = 0.75) -> Iterator[Index]:
    """Indexes of all items, each of about SHARD_POSTINGS postings at most, with statistics over all items."""
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[x.decode("utf-8", "replace") for x in words(t.as_py())] for t in batch.column(1)], pa.list_(pa.string()))], ["item_id", "text", "words"])

    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows = rows.mapInArrow(tokens, "item_id long, text string, words array<string>").where(F.size("words") > 0)
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avg"), F.max(F.size("words")).alias("longest"), F.sum(F.size(F.array_distinct("words"))).alias("postings")).first()
    if not stats["n"]:
        return
    width = max(64, 2 * stats["longest"])
    shards = math.ceil(stats["postings"] / SHARD_POSTINGS)
    tf = rows.select("item_id", "text", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("item_id", "text", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / stats["avg"]))
    weighted = tf.join(df, "term").groupBy("item_id", "text").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight"), "df"))).alias("terms"))
    for s in range(shards):
        part = weighted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s).orderBy("item_id", "text").collect()
        common = {x["term"].encode(): x["df"] for r in part for x in r["terms"]}
        if part:
            yield build_index([(r["item_id"], r["text"], [(x["term"], x["weight"]) for x in r["terms"]]) for r in part], common, threshold, width)


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.5, question: float = 0.6, answer: float = 0.6) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_passages, n_retrieved, item_ids, contaminated.

    Every passage of every document queries the index of items(item_id, text). n_retrieved counts pairs of
    passage and item whose BM25 score reaches `threshold` times the item's score against itself. Those with at
    least the shares `question` and `answer` of the trigrams of the item's question and answer in the passage
    are verified; item_ids has their items in order, and a document with any is contaminated.

    Null or empty text: no passages, not contaminated. Items with null id or text, or without words, take no
    part; equal items are one, items of one text under several ids all match. No items: nothing is retrieved.
    doc_id is passed on, nulls and repeats included; whole texts are read; other columns are ignored.
    """
    out = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, threshold, question, answer)
    return out.select("doc_id", F.col("_quill_passages").alias("n_passages"), F.col("_quill_retrieved").alias("n_retrieved"), F.col("_quill_items").alias("item_ids"), (F.size("_quill_items") > 0).alias("contaminated"))


def annotate(docs: DataFrame, items: DataFrame, threshold: float = 0.5, question: float = 0.6, answer: float = 0.6) -> DataFrame:
    """docs with the columns _quill_passages, _quill_retrieved and _quill_items; see matches."""
    out = docs.withColumns({"_quill_passages": F.lit(0).cast("long"), "_quill_retrieved": F.lit(0).cast("long"), "_quill_items": F.array().cast("array<long>")})
    schema, at = out.schema, docs.columns.index("text")
    for index in _shards(items, threshold):
        # at most about SHARD_POSTINGS postings
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            half = index.width // 2
            for b in batches:
                passages, retrieved, ids = [], [], []
                for t, n, old in zip(b.column(at), b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                    w = words(t.as_py())
                    passages.append(1 + max(0, -(-(len(w) - index.width) // half)) if w else 0)
                    found = retrieve(w, index) if w else []
                    retrieved.append(n.as_py() + len(found))
                    good = set(old.as_py())
                    for passage, i, _ in found:
                        seen = w[passage * half : passage * half + index.width]
                        if overlap(index.parts[i][0], seen) >= question and overlap(index.parts[i][1], seen) >= answer:
                            good.add(int(index.item_ids[i]))
                    ids.append(sorted(good))
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(passages, pa.int64()), pa.array(retrieved, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], b.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a test item; same columns."""
    return annotate(docs, items).where(F.size("_quill_items") == 0).select(*docs.columns)
