"""Batch retrieval and ranking: a table of queries against a table of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Kinds of chunk that may answer a question, and those that are noise.
ANSWER_TYPES = ("definition", "formula", "example", "qa", "explanation")
NOISE_TYPES = ("metadata", "table_of_contents", "header_footer", "ocr_noise")
TERM = "[a-z0-9]{4,}"
#: What kinds are worth whatever is asked, the others, and a long formula; words that ask for a kind and what it is worth then.
WORTH = {"": 0.0, **dict.fromkeys(NOISE_TYPES, 0.0), "formula": 0.15, "definition": 0.6, "explanation": 0.6, "qa": 0.6}
OTHER_WORTH, LONG_FORMULA = 0.3, 0.55
ASKED_FOR = {"definition": ("define|what is|meaning", 1.0), "formula": ("formula|equation", 1.0), "example": ("example", 0.9), "experiment": ("experiment|activity|procedure", 0.9)}


def postings(docs: DataFrame, doc_id: str = "doc_id", pattern: str = TERM) -> DataFrame:
    """Inverted index: doc_id, term, tf, length (tokens of the document)."""
    t = docs.select(doc_id, T.tokens("text", pattern).alias("terms"))
    return t.select(doc_id, F.size("terms").cast("long").alias("length"), F.explode("terms").alias("term")).groupBy(doc_id, "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, pattern: str = TERM, places: int = 4) -> DataFrame:
    """query_id, doc_id, bm25 (to `places`) of documents that share a term with a query; a term repeated in a query counts each time.

    Only postings of terms that occur in a query are shuffled.
    """
    asked = queries.select("query_id", F.explode(T.tokens("text", pattern)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("repeats"))
    index = postings(docs, pattern=pattern)
    stats = docs.select(F.size(T.tokens("text", pattern)).alias("length")).agg(F.count("*").alias("documents"), F.avg("length").alias("avgdl"))
    wanted = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    # stats is one row
    weighted = asked.join(df, "term").join(F.broadcast(stats)).withColumn("idf", F.log(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    scored = wanted.join(weighted, "term")
    part = F.col("repeats") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.greatest(F.col("length"), F.lit(1)) / F.greatest(F.col("avgdl"), F.lit(1e-6))))
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(part.cast("decimal(38,14)")).cast("double"), places).alias("bm25"))


def top_hits(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k best of each query, ties by doc_id, with rank from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def dense(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """Best k of vectors(vec_id, embedding) for each query vector by inner product, rounded to six places: query_id, vec_id, score, rank.

    A query's own vec_id is no hit; vectors of another length score 0; null vectors and null ids take no part. Ties go
    to the smaller vec_id.

    Queries are taken in blocks of at most block_rows, dealt by their number in order. A block, so many vectors at
    most, is sent to every executor, and all vectors pass it where they are: a task multiplies matrices and keeps the
    k best of each query, so no vector is copied or shuffled, and what is shuffled is k rows a query and task.
    """
    asked = queries.where("vec_id is not null and embedding is not null").select("vec_id", "embedding").distinct()
    blocks = max(1, -(-asked.count() // block_rows))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(2 * blocks if blocks > 1 else 1)))  # twice as many, so that none is over the bound but by great chance
    stored = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    found = None
    for no in range(2 * blocks if blocks > 1 else 1):
        part = _best_of_block(stored, numbered.where(F.col("block") == no).select("vec_id", "embedding").collect(), k)
        found = part if found is None else found.unionByName(part)
    scored = found.groupBy("query_id", "vec_id").agg(F.max(F.round("score", 6)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _best_of_block(vectors: DataFrame, asked: list, k: int) -> DataFrame:
    """The k best of each task's vectors for each of a bounded list of queries: query_id, vec_id, score."""
    by_length: dict[int, tuple[list[int], list]] = {}
    for q in asked:
        ids, rows = by_length.setdefault(len(q["embedding"]), ([], []))
        ids.append(q["vec_id"])
        rows.append(q["embedding"])
    shared = vectors.sparkSession.sparkContext.broadcast([(n, np.array(ids, np.int64), np.array(rows, float).reshape(len(ids), n)) for n, (ids, rows) in by_length.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            ids, lengths = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
            flat = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), float)
            starts = np.cumsum(lengths) - lengths
            for n, q_ids, matrix in shared.value:
                scores = np.zeros((len(q_ids), len(ids)))
                same = np.flatnonzero(lengths == n)
                if len(same) and n:
                    scores[:, same] = matrix @ flat[starts[same][:, None] + np.arange(n)].T
                rounded = np.round(scores, 6)
                for i, q in enumerate(q_ids.tolist()):
                    old_ids, old = best.get(q, (ids[:0], rounded[i, :0]))
                    at = np.flatnonzero(ids != q)
                    if len(old) == k:
                        at = at[rounded[i, at] >= old.min()]
                    every, score = np.concatenate([old_ids, ids[at]]), np.concatenate([old, rounded[i, at]])
                    order = np.lexsort((every, -score))[:k]
                    best[q] = every[order], score[order]
        for q, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "query_id long, vec_id long, score double")


def fuse(dense_score: Column, lexical: Column, matches: list[Column] | None = None, chunk_type: Column | None = None) -> Column:
    """0.55 dense + 0.35 lexical + 0.10 for each matching filter + 0.05 for an answering kind of chunk, to six places."""
    score = 0.55 * dense_score + 0.35 * lexical
    for m in matches or []:
        score = score + F.when(m, 0.10).otherwise(0.0)
    if chunk_type is not None:
        score = score + F.when(chunk_type.isin(*ANSWER_TYPES), 0.05).otherwise(0.0)
    return F.round(score, 6)


def merge_hits(*sources: DataFrame) -> DataFrame:
    """Hits(query_id, doc_id, score, source) of several searches: best score of each document, sources joined by a bar."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    return every.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))


def type_score(query: Column, chunk_type: Column, text: Column) -> Column:
    """How well the kind of a chunk suits what a query asks for: the largest of what its kind is worth, what it is worth if asked for, and LONG_FORMULA for a formula that is explained at length."""
    kind, asked = F.coalesce(chunk_type, F.lit("")), F.lower(query)
    unasked = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in WORTH.items() for x in pair]), kind), F.lit(OTHER_WORTH))
    when_asked = [F.when((kind == k) & asked.rlike(words), worth) for k, (words, worth) in ASKED_FOR.items()]
    explained = F.when((kind == "formula") & (T.word_count(text) >= 50) & (F.length(text) >= 220), LONG_FORMULA)
    return F.greatest(unasked, explained, *when_asked)


def topic_band(asked: Column, topics: Column, prerequisites: Column, related: Column) -> Column:
    """1 if a topic is asked for, 0.75 if it is a prerequisite of one, 0.6 if related, else 0."""
    return F.when(F.arrays_overlap(topics, asked), 1.0).when(F.arrays_overlap(topics, prerequisites), 0.75).when(F.arrays_overlap(topics, related), 0.6).otherwise(0.0)


def rerank(hits: DataFrame, k: int, least: float = 0.25) -> DataFrame:
    """hits(query_id, doc_id, query, text, score, chunk_type, topic_score, chapter_match, subject_match, local) reranked.

    0.35 semantic + 0.35 lexical + 0.30 educational, 0.08 more for local hits, 0.18 less for noise; hits below
    `least` go, copies of a text within a query (first 500 characters normalised) keep their best.
    """
    q, t = T.content_terms("query"), T.content_terms("text")
    lexical = F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))
    education = 0.40 * F.col("topic_score") + 0.20 * F.col("chapter_match").cast("double") + 0.15 * F.col("subject_match").cast("double") + 0.25 * type_score(F.col("query"), F.col("chunk_type"), F.col("text"))
    score = 0.35 * T.clamp(F.col("score"), 0.0, 1.0) + 0.35 * lexical + 0.30 * education + F.when(F.col("local"), 0.08).otherwise(0.0) - F.when(F.col("chunk_type").isin(*NOISE_TYPES), 0.18).otherwise(0.0)
    ranked = hits.withColumn("final_score", F.round(score, 6)).where(F.col("final_score") >= least)
    copies = Window.partitionBy("query_id", T.normalize_text(F.substring("text", 1, 500))).orderBy(F.desc("final_score"), "doc_id")
    ranked = ranked.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1").drop("_copy")
    return top_hits(ranked, "final_score", k)


def overlap_search(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Best k by shared distinct terms / sqrt(terms of the document), joined on terms: query_id, doc_id, shared, score, rank."""
    terms = docs.select("doc_id", T.content_terms("text").alias("t")).select("doc_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    asked = queries.select("query_id", F.explode(T.content_terms("text")).alias("term"))
    both = asked.join(terms, "term").groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("shared"))
    return top_hits(both.select("query_id", "doc_id", "shared", F.round(F.col("shared") / F.sqrt("n"), 6).alias("score")), "score", k)


def retrieval_accuracy(hits: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of queries of relevant(query_id, doc_id) with a relevant document among their first 1, 3, 5 hits."""
    marked = relevant.select("query_id").distinct().join(hits.join(relevant.withColumn("good", F.lit(1)), ["query_id", "doc_id"], "left"), "query_id", "left")
    flags = marked.groupBy("query_id").agg(*[F.max(F.when((F.col("rank") <= k) & (F.col("good") == 1), 1).otherwise(0)).alias(f"top{k}") for k in cuts])
    return flags.agg(F.count("*").alias("queries"), *[F.round(F.avg(f"top{k}"), 6).alias(f"top{k}_accuracy") for k in cuts])


def cascade(requests: DataFrame, attempts: list[DataFrame]) -> DataFrame:
    """Rows of the first attempt that finds anything for a request; each attempt has request_id and the same columns."""
    every = None
    for i, a in enumerate(attempts):
        a = a.withColumn("attempt", F.lit(i))
        every = a if every is None else every.unionByName(a)
    first = every.groupBy("request_id").agg(F.min("attempt").alias("attempt"))
    return requests.join(every.join(first, ["request_id", "attempt"]), "request_id")
