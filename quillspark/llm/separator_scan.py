"""Token counts of documents by a separator scan of flat, unindexed token files."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Split pattern of the byte-level vocabulary; a fixed value that belongs to it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The free id of that vocabulary, put after every document.
END = 50256
#: A document may begin with its id: a sign and five digits to base 10,000, so that no token is END.
ID_TOKENS, ID_BASE = 6, 10_000


def id_tokens(doc_id: int) -> list[int]:
    n, out = abs(doc_id), [0] * 5
    for i in range(4, -1, -1):
        n, out[i] = divmod(n, ID_BASE)
    return [int(doc_id < 0), *out]


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, file_records: int = 20_000) -> None:
    """Write docs(doc_id, text) as flat files of 16-bit tokens with END after each document, and nothing else.

    Each document begins with the tokens of its id; rows with null doc_id are left out. Null text has no
    tokens. Spark's text writer writes the bytes, with END as its line separator, so any file system that Spark
    knows will do; a file holds file_records documents at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                values = []
                for i, t in zip(part.column(0), part.column(1), strict=True):
                    tokens = encoder.encode_ordinary(t.as_py() or "")
                    values.append(np.array(id_tokens(i.as_py()) + tokens, np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])

    end = np.array([END], np.uint16).tobytes().decode("latin-1")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", file_records).text(path)


def segments(tokens: np.ndarray, end: int, head: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Pieces of documents in each block of a file: (block, lengths, closed, places, first tokens of each piece)."""
    for number, at in enumerate(range(0, len(tokens), block)):
        part = tokens[at : at + block]
        ends = np.flatnonzero(part == end)
        starts = np.concatenate([[0], ends + 1])
        stops = np.concatenate([ends, [len(part)]])
        closed = np.arange(len(starts)) < len(ends)
        if stops[-1] == starts[-1]:  # nothing after the last separator
            starts, stops, closed = starts[:-1], stops[:-1], closed[:-1]
        yield number, stops - starts, closed, np.arange(len(starts)), [part[s : min(e, s + head)] for s, e in zip(starts, stops, strict=True)]


def scan(spark: SparkSession, path: str, end: int = END, head: int = 0, block_tokens: int = 1 << 18) -> DataFrame:
    """Documents of flat 16-bit token files: file, ordinal (in the file, from 0), start, n_tokens, head.

    Each file is cut into blocks of block_tokens. A block is compared with `end` at once, which gives the
    pieces of documents in it; a prefix sum of closed pieces over the blocks of a file numbers the documents,
    and pieces with one number are stitched. n_tokens counts all tokens of a document but the separator; head
    has its first `head` tokens. Tokens after the last separator are a document too; empty documents between
    two separators count; an empty file has none. Files are read whole, so each must be below 2 GB.
    """
    kinds = ["file", "block", "place", "n", "closed", "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                tokens = np.frombuffer(content.as_buffer(), np.uint16)
                for number, lengths, closed, places, heads in segments(tokens, end, head, block_tokens):
                    n = len(lengths)
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n, pa.string()), pa.array(np.full(n, number, np.int64)), pa.array(places.astype(np.int64)), pa.array(lengths.astype(np.int64)), pa.array(closed), pa.array([h.astype(np.int32) for h in heads], pa.list_(pa.int32()))], kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    pieces = files.mapInArrow(run, "file string, block long, place long, n long, closed boolean, head array<int>")
    order = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.withColumn("ordinal", F.coalesce(F.sum(F.col("closed").cast("long")).over(order), F.lit(0).cast("long")))
    numbered = numbered.withColumn("start", F.coalesce(F.sum(F.col("n") + F.col("closed").cast("long")).over(order), F.lit(0).cast("long")))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "head"))), lambda x: x["head"]))
    return numbered.groupBy("file", "ordinal").agg(F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.slice(joined, 1, max(head, 1)).alias("head"))


def with_ids(documents: DataFrame) -> DataFrame:
    """doc_id and n_tokens of scanned documents that begin with the tokens of their id, which aren't counted."""
    number = F.aggregate(F.slice("head", 2, 5), F.lit(0).cast("long"), lambda n, x: n * ID_BASE + x)
    return documents.select(F.when(F.col("head")[0] == 1, -number).otherwise(number).alias("doc_id"), (F.col("n_tokens") - ID_TOKENS).alias("n_tokens"), "ordinal", "start")
