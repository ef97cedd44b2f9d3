"""Alignment of two tokenizers' tokens by the byte offsets at which both end a token."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize

BYTE_VOCABULARY, PIECE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Split pattern of the byte-level vocabulary; a fixed value that belongs to it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents that follow one another are counted together in blocks of so many links, or of one document of more.
BLOCK_LINKS = 1 << 21
#: Links of one document that are expanded at a time.
EXPANDED = 1 << 21
#: A pair of ids in one number: the A id times PAIR, plus the B id.
PAIR = 1 << 32


def _byte_level() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: itself if printable, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}


class Tokenizers:
    """Both tokenizers, loaded from their files, with the bytes of every token."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str) -> None:
        import sentencepiece
        import tiktoken

        letters = _byte_level()
        with open(byte_vocabulary, encoding="utf-8") as f:
            content = json.load(f)
        special = {t["content"] for t in content.get("added_tokens", [])}
        entries = content["model"]["vocab"]
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = entry.encode() if entry in special else bytes(letters[c] for c in entry)
        # merges stand in the order of their ids, so ids serve as ranks; the tests hold both encoders against each other
        self._a = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks={self.bytes_a[i]: i for e, i in entries.items() if e not in special}, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.said_a, self.said_b = ([f"{i}{sign}" for sign in signs for i in range(len(x))] for x, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))
        self.said_a, self.said_b = np.array(self.said_a, object), np.array(self.said_b, object)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A for space + text and of B for text; none if either's bytes are not those of space + text."""
        none = np.array([], np.int64)
        if not text:
            return none, none
        source = (" " + text).encode()
        a, b = self._a.encode_ordinary(" " + text), self._b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != source or b"".join(map(self.bytes_b.__getitem__, b)) != source:
            return none, none
        return np.array(a, np.int64), np.array(b, np.int64)

    def slices(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the groups of encode()'s ids end in each of them."""
        stops = slices(np.cumsum(self.lengths_a[a]).tolist(), np.cumsum(self.lengths_b[b]).tolist())
        return np.array(stops[0], np.int64), np.array(stops[1], np.int64)

    def digest(self, a: np.ndarray, b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> str:
        """Hex SHA-256 of the groups as `a1,a2|b1;a3|b2,b3`, '' without tokens.

        Every token is said with the sign after it, all at the places they have when groups follow one another.
        """
        if not len(a):
            return ""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[stops_a - 1], last_b[stops_b - 1] = len(self.bytes_a), len(self.bytes_b)
        n_a, n_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
        said = np.empty(len(a) + len(b), object)
        said[np.arange(len(a)) + np.repeat(stops_b - n_b, n_a)] = self.said_a[a + last_a]
        said[np.arange(len(b)) + np.repeat(stops_a, n_b)] = self.said_b[b + last_b]
        return hashlib.sha256("".join(said.tolist())[:-1].encode()).hexdigest()


def slices(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Where the groups end in each list of tokens, from the cumulative ends of both.

    Each side's ends are the keys of a dictionary to the number of tokens up to them. The keys that both have,
    sorted, are the borders of the groups.
    """
    index_a, index_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    both = sorted(index_a.keys() & index_b.keys())
    return list(map(index_a.__getitem__, both)), list(map(index_b.__getitem__, both))


def linked_pairs(a: np.ndarray, b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (A id, B id) pairs that share a group, as A id * PAIR + B id in order, and how many links each has.

    Links are expanded for EXPANDED of them at a time, a group of more links by slices of its A tokens.
    """
    n_a, n_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
    group = np.repeat(np.arange(len(n_a)), n_a)  # of each A token
    partners = n_b[group]
    first = (stops_b - n_b)[group]
    done = np.concatenate([[0], np.cumsum(partners)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(group):
        stop = max(at + 1, int(np.searchsorted(done, done[at] + EXPANDED, "right")) - 1)
        n = partners[at:stop]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        keys = np.repeat(a[at:stop].astype(np.int64), n) * PAIR + b[np.repeat(first[at:stop], n) + within]
        found.append(np.unique(keys, return_counts=True))
        if len(found) > 8 or stop == len(group):
            found = [_added(found)]
        at = stop
    return found[0] if found else (np.array([], np.int64), np.array([], np.int64))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def groups(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """Aligned groups of every row of docs(doc_id, text): doc_id, a and b (token ids), stops_a and stops_b (tokens up to the end of each group).

    Group k holds the A tokens from stops_a[k-1] (0 for the first) to stops_a[k] and the B tokens likewise. Null or
    empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens and no groups. Rows with
    null or repeated doc_id are rows of their own; other columns are ignored; an empty table gives no rows.
    """
    names = ["doc_id", "a", "b", "stops_a", "stops_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers(byte_vocabulary, piece_vocabulary)
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                rows = []
                for text in part.column(1):
                    a, b = t.encode(text.as_py())
                    rows.append((a, b, *t.slices(a, b)))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.list_(pa.int32())) for c in zip(*rows, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, a array<int>, b array<int>, stops_a array<int>, stops_b array<int>")


def measured(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """doc_id, block, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (linked_pairs as bytes of longs and ints) of every row."""
    names = ["doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, block, held = Tokenizers(byte_vocabulary, piece_vocabulary), TaskContext.get().partitionId() << 31, 0
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                rows = []
                for text in part.column(1):
                    a, b = t.encode(text.as_py())
                    stops_a, stops_b = t.slices(a, b)
                    pairs, times = linked_pairs(a, b, stops_a, stops_b)
                    links = int(times.sum())
                    if held and held + links > BLOCK_LINKS:
                        block, held = block + 1, 0
                    held += links
                    rows.append((block, len(a), len(b), len(stops_a), links, t.digest(a, b, stops_a, stops_b), pairs.tobytes(), times.astype(np.int32 if links < 1 << 31 else np.int64).tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types[1:], strict=True)]], names)

    kinds = "doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def block_pairs(rows: DataFrame) -> DataFrame:
    """How many rows of a block hold a pair linked: block, pair, n. rows: block and pairs, as `measured` gives them.

    Blocks are not gathered, so a block has several rows for a pair where its rows came in several batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for no in np.unique(blocks):
                held = [np.frombuffer(batch.column(1)[int(i)].as_py(), np.int64) for i in np.flatnonzero(blocks == no)]
                pairs, n = np.unique(np.concatenate(held), return_counts=True)
                for at in range(0, len(pairs), 100_000):
                    part = pairs[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), no)), pa.array(part), pa.array(n[at : at + 100_000])], ["block", "pair", "n"])

    return rows.select("block", "pairs").mapInArrow(run, "block long, pair long, n long")


def align(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """Alignment of every row of docs(doc_id, text), and how strong its links are in the corpus.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A pair's count is the number of
    rows of docs that hold the pair linked; n_best counts the links whose count is the highest of their A id, ties
    included; count_sum adds the counts of all links. See `groups` for texts without tokens, whose numbers are 0, and
    for nulls, repeats, clashing names and empty tables.

    Texts are tokenised once. Each row keeps its distinct pairs as packed bytes and belongs to a block of rows. Pairs
    are counted in blocks before they are shuffled, so a pair that every document has costs a row for each block. The
    counts go back to the blocks, and each block of rows meets its own counts in one bounded task.
    """
    rows = materialize(measured(docs, byte_vocabulary, piece_vocabulary), "aligned")
    held = materialize(block_pairs(rows), "aligned-pairs")
    counts = held.groupBy("pair").agg(F.sum("n").alias("count"))
    a_id = F.shiftright("pair", 32)
    best = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("most"))
    counts = counts.join(best, a_id == best["a_id"]).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    known = held.select("block", "pair").distinct().join(counts, "pair").select("block", "pair", "count", "best")

    def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        pairs, count, top = (right.column(c).to_numpy() for c in ("pair", "count", "best"))
        n_best, sums = [], []
        for packed, times, links in zip(left.column("pairs").to_pylist(), left.column("times").to_pylist(), left.column("n_links").to_pylist(), strict=True):
            place = np.searchsorted(pairs, np.frombuffer(packed, np.int64))
            n = np.frombuffer(times, np.int32 if links < 1 << 31 else np.int64).astype(np.int64)
            n_best.append(int(n[top[place]].sum()) if len(n) else 0)
            sums.append(int((n * count[place]).sum()) if len(n) else 0)
        return left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", left.column("groups_sha256"))

    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(looked_up, kinds)
