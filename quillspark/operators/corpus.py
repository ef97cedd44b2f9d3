"""Cleaning, classification, sectioning, chunking and deduplication of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Characters that only bad extraction leaves.
EXTRACTION_MARKS = "­�"
#: What a whole line must match to be a header or footer.
HEADER = r"(?i)^(reprint\s+\d{4}\s*-\s*\d{2}|(mathematics|science)\s*\|\s*grade\s+\d+|chapter\s+\d+|fig\.?\s*\d+(\.\d+)?|table\s+\d+(\.\d+)?)$"
#: What marks a line of a book's imprint.
IMPRINT = r"(?i)\b(isbn|copyright|all rights reserved|published by|republication|no part of this publication|printed at)\b"
#: A line that is a page number, and one that is a heading.
PAGE_NUMBER = r"(?i)^(page\s*(no\.?)?\s*)?\d{1,4}$"
HEADING = r"(?i)^((chapter|unit|lesson|section)\s+\d+|\d+(\.\d+)+\s)"
#: Thresholds of the formula and table predicates by profile: longest formula, longest short line.
PROFILES = {"basic": (180, 28), "audit": (160, 25), "extract": (220, 28), "semantic": (260, 34)}


def clean_chunk(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), " ", " ")
    return T.strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def is_page_number(t: Column) -> Column:
    return t.rlike(PAGE_NUMBER)


def is_header_footer(t: Column) -> Column:
    return t.rlike(HEADER)


def is_formula_only(t: Column, profile: str = "basic") -> Column:
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    return (F.length(t) <= PROFILES[profile][0]) & t.rlike(r"[=+\-×÷*/^√∠∆π≤≥<>°]") & (T.word_count(t) <= 10) & (letters < 35)


def is_table_fragment(t: Column, profile: str = "basic") -> Column:
    found = T.lines(t)
    n = F.size(found)
    short = F.size(F.filter(found, lambda x: F.length(x) <= PROFILES[profile][1]))
    numeric = F.size(F.filter(found, lambda x: x.rlike(r"[0-9]")))
    return (n >= 4) & (short / n > 0.62) & (numeric / n > 0.30)


def is_extraction_noise(t: Column) -> Column:
    symbols = F.length(F.regexp_replace(t, r"[\p{L}\p{Nd}\s]+", ""))
    spaced = (F.length(t) >= 12) & t.rlike(r"(?:[A-Za-z]\s){5,}[A-Za-z]")
    return t.rlike(f"[{EXTRACTION_MARKS}]") | spaced | ((F.length(t) >= 20) & (symbols / F.greatest(F.length(t), F.lit(1)) > 0.45))


def classify_chunks(chunks: DataFrame, order: list[str], text: str = "text", least_chars: int = 80, least_words: int = 12) -> DataFrame:
    """chunks with `cleaned` and `chunk_class`; the first matching class wins, and later copies of a text are
    DUPLICATE_CONTENT whatever else they are.

    Copies are found by one hash aggregate of the smallest place of each hash, joined back, so a very common
    chunk is a skewed join key and not one window partition. Rules are tested before that join: where `cleaned`
    isn't used later, hash, place and class alone are shuffled.
    """
    c = chunks.withColumn("cleaned", clean_chunk(F.col(text))).withColumn("_hash", T.content_hash("cleaned"))
    place = F.struct(*order)
    first = c.groupBy("_hash").agg(F.min(place).alias("_first"))
    t = F.col("cleaned")
    small = F.length(t) < 20  # tested first, as most rules are for short chunks alone
    short = (F.length(t) < least_chars) | (T.word_count(t) < least_words)
    own = F.when(t == "", "EMPTY_CONTENT").when(small & is_page_number(t), "PAGE_NUMBER").when(is_header_footer(t), "HEADER_FOOTER").when(is_extraction_noise(t), "OCR_NOISE").when((F.length(t) <= PROFILES["basic"][0]) & is_formula_only(t), "FORMULA_ONLY").when(t.contains("\n") & is_table_fragment(t), "TABLE_FRAGMENT").when(short, "SHORT_FRAGMENT").otherwise("EDUCATIONAL_TEXT")
    classed = c.withColumn("_own", own).join(first, "_hash")
    rule = F.when((F.col("_own") != "EMPTY_CONTENT") & (place != F.col("_first")), "DUPLICATE_CONTENT").otherwise(F.col("_own"))
    return classed.withColumn("chunk_class", rule).drop("_hash", "_first", "_own")


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def filter_lines(text: Column) -> Column:
    """A text without page numbers, imprint lines, repeated headers, and lines of at most 8 words that occur 3 times or more."""
    raw = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(T.strip(x), r"[ \t]+", " "))
    times = lambda norm, n: F.size(F.filter(norm, lambda y: y == n))
    drop = lambda norm, x, n: (x != "") & (is_page_number(x) | x.rlike(IMPRINT) | (is_header_footer(x) & (times(norm, n) > 1)) | ((T.word_count(x) <= 8) & (times(norm, n) >= 3)))
    kept = T.bound(F.transform(raw, T.normalize_text), lambda norm: F.filter(raw, lambda x: ~drop(norm, x, T.normalize_text(x))))
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"(\w)-\n(\w)", "$1$2")
    return T.strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def filtered_line_counts(docs: DataFrame) -> DataFrame:
    """Lines of each document that filter_lines keeps and drops, counted over exploded lines."""
    found = lines_of(docs.select("doc_id", "text")).select("doc_id", "line_no", F.regexp_replace(T.strip("line"), r"[ \t]+", " ").alias("line"))
    found = found.where("line <> ''").withColumn("norm", T.normalize_text("line"))
    found = found.withColumn("times", F.count("*").over(Window.partitionBy("doc_id", "norm")))
    x = F.col("line")
    drop = is_page_number(x) | x.rlike(IMPRINT) | (is_header_footer(x) & (F.col("times") > 1)) | ((T.word_count(x) <= 8) & (F.col("times") >= 3))
    return found.groupBy("doc_id").agg(F.count_if(~drop).alias("kept"), F.count_if(drop).alias("dropped"))


def is_heading(line: Column) -> Column:
    words = F.size(F.split(line, r"\s+"))
    upper = (F.upper(line) == line) & line.rlike(r"\p{L}")
    return line.startswith("#") | (line.endswith(":") & (words <= 12)) | (upper & (words <= 10)) | line.rlike(HEADING)


def sections(docs: DataFrame) -> DataFrame:
    """Sections of documents: doc_id, section_no, title, content, n_lines. Text before a heading is `Introduction`.

    A running count of headings numbers the sections of a document; sections without content are left out.
    """
    found = lines_of(docs.select("doc_id", "text")).select("doc_id", "line_no", T.strip("line").alias("line")).where("line <> ''")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("heading", is_heading(F.col("line"))).withColumn("section_no", F.sum(F.col("heading").cast("long")).over(w))
    title = F.max(F.when(F.col("heading"), T.strip(F.regexp_replace("line", r"^[# ]+", ""))))
    parts = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("line_no", "line"))))
    out = found.groupBy("doc_id", "section_no").agg(F.coalesce(title, F.lit("Introduction")).alias("title"), parts.alias("parts"))
    return out.where(F.size("parts") > 0).select("doc_id", "section_no", "title", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("content"), F.size("parts").cast("long").alias("n_lines"))


def char_windows(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Sliding windows of characters: doc_id, window_no, start (from 0), text. The last one reaches the end."""
    step, n = size - overlap, F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    rows = docs.where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("w"))
    return rows.select("doc_id", F.col("w").cast("long").alias("window_no"), (F.col("w") * step).cast("long").alias("start"), F.substring("text", F.col("w") * step + 1, F.lit(size)).alias("text"))


def word_windows(docs: DataFrame, target: int = 350, longest: int = 450) -> DataFrame:
    """Texts of more than `longest` words in equal pieces of about `target`; others whole: doc_id, piece_no, n_words, text."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = docs.select("doc_id", w.alias("w")).withColumn("n", F.size("w")).where("n > 0")
    pieces = F.when(F.col("n") > longest, F.greatest(F.lit(2), F.ceil(F.col("n") / F.lit(target)))).otherwise(F.lit(1)).cast("int")
    rows = rows.withColumn("each", F.ceil(F.col("n") / pieces).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    part = F.slice("w", F.col("piece") * F.col("each") + 1, F.col("each"))
    return rows.select("doc_id", F.col("piece").cast("long").alias("piece_no"), F.size(part).cast("long").alias("n_words"), F.array_join(part, " ").alias("text")).where("n_words > 0")


def _starts(lengths, target: int, most: int, least: int, joint: int) -> list[int]:
    """Places, from 1, at which the groups of a greedy fold begin."""
    out, total = [], 0
    for place, x in enumerate(lengths, 1):
        longer = total + joint + abs(x)
        if out and x >= 0 and total >= 0 and (longer <= target or (total < least and longer <= most)):
            total = longer
        else:
            out.append(place)
            total = x
    return out


def fold_starts(lengths: Column, target: int, most: int = 1 << 60, least: int = 0, joint: int = 0) -> Column:
    """Greedy grouping of an array of lengths: the places, from 1, at which groups begin.

    An element joins the group before it while the sum, with `joint` between elements, is at most `target`, or
    at most `most` where the group is still below `least`. An element of negative length stands alone. One pass
    over lengths in Arrow batches; texts don't go through Python.
    """

    @F.pandas_udf("array<int>")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda x: _starts(x.tolist(), target, most, least, joint))

    return fold(lengths)


def grouped(parts: str, starts: str, separator: str) -> Column:
    """The parts of each group joined, by the places at which groups begin."""
    stop = lambda i: F.coalesce(F.get(F.col(starts), i + 1), F.size(parts) + 1)
    return F.transform(starts, lambda s, i: F.array_join(F.slice(parts, s, stop(i) - s), separator))


def merge_parts(docs: DataFrame, parts: Column, length, separator: str, target: int, most: int = 1 << 60, least: int = 0, joint: int = 0) -> DataFrame:
    """Parts of each text merged to chunks by fold_starts, within a row and without a shuffle: doc_id, chunk_no, text."""
    rows = docs.select("doc_id", parts.alias("parts")).where(F.size("parts") > 0)
    rows = rows.withColumn("starts", fold_starts(F.transform("parts", lambda p: length(p).cast("long")), target, most, least, joint))
    rows = rows.select("doc_id", F.posexplode(grouped("parts", "starts", separator)).alias("chunk_no", "text"))
    return rows.withColumn("chunk_no", F.col("chunk_no").cast("long"))


def spaced_words(text: Column) -> Column:
    """Runs of other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def merge_paragraphs(docs: DataFrame, target_min: int = 800, target_max: int = 1500, hard_max: int = 5000) -> DataFrame:
    """Adjacent lines of a document merged to chunks: doc_id, chunk_no, n_chars, text.

    A line joins the chunk before it up to target_max characters, or up to hard_max while that chunk is below
    target_min; a longer line is a chunk by itself.
    """
    return merge_parts(docs, T.lines("text"), F.length, "\n\n", target_max, hard_max, target_min, 2).withColumn("n_chars", F.length("text").cast("long"))


def semantic_chunks(docs: DataFrame, least: int = 200, most: int = 400) -> DataFrame:
    """Chunks of whole sentences of a document, at most `most` words unless one sentence has more: doc_id, chunk_no, n_words, text.

    A chunk ends at the first sentence end at which it has `least` words; the last one may have fewer.
    """
    return merge_parts(docs, T.sentences("text"), spaced_words, " ", least, most, least).withColumn("n_words", spaced_words(F.col("text")))


def merge_short_paragraphs(docs: DataFrame, least: int = 120) -> DataFrame:
    """Paragraphs joined to the one before while that has fewer than `least` characters: doc_id, chunk_no, text."""
    return merge_parts(docs, T.paragraphs("text"), F.length, "\n\n", -1, least=least, joint=2)


def section_pieces(docs: DataFrame, most: int = 2000) -> DataFrame:
    """Texts in pieces of whole lines of at most `most` words, unless one line has more: doc_id, chunk_no, text."""
    return merge_parts(docs, T.lines("text"), spaced_words, "\n", most)


def speech_parts(docs: DataFrame, most: int = 240) -> DataFrame:
    """Texts in parts of at most `most` characters to be spoken: doc_id, chunk_no, text.

    Whole sentences; those that are too long in clauses, and clauses that are too long in words. A longer word is a part by itself.
    """
    inner = lambda pieces, pattern: F.flatten(F.transform(pieces, lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(F.filter(F.split(s, pattern), lambda x: x != ""))))
    return merge_parts(docs, inner(inner(F.transform(T.sentences("text"), T.strip), r"(?<=[,;:])\s+"), r"\s+"), F.length, " ", most, joint=1)


def atomic_chunks(docs: DataFrame, alone, most: int = 1300) -> DataFrame:
    """Lines packed to chunks of less than `most` characters; those for which `alone` holds are chunks by themselves: doc_id, chunk_no, text."""
    signed = lambda p: F.when(alone(p), -F.length(p)).otherwise(F.length(p))
    return merge_parts(docs, T.lines("text"), signed, "\n\n", most - 2, joint=2)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, first_id, keep: the smallest id of a normalised text stays."""
    hashed = docs.select("doc_id", T.content_hash("text").alias("text_hash"))
    first = hashed.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(first, "text_hash").withColumn("keep", F.col("doc_id") == F.col("first_id"))


def with_shingle_key(docs: DataFrame, *columns: str, width: int = 5, smallest: int = 18, least_words: int = 10) -> DataFrame:
    """columns and key, the SHA-1 of the `smallest` first distinct word shingles in order; texts below least_words words are left out.

    The key is never null and the filter is on the number of words, so no filter repeats the work of the key.
    """
    norm = T.normalize_text("text")
    long_enough = docs.where(F.regexp_count(norm, F.lit(" ")) + 1 >= least_words)
    runs = F.slice(F.array_sort(F.array_distinct(T.word_runs(norm, width))), 1, smallest)
    return long_enough.select(*columns, F.coalesce(F.sha1(F.array_join(runs, "|")), F.lit("")).alias("key"))


def key_groups(docs: DataFrame) -> DataFrame:
    """Groups of documents with one shingle key: key, first_id, documents."""
    return with_shingle_key(docs, "doc_id").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("documents")).where("documents > 1")


def key_group_similarity(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """Documents against the first of their shingle key: doc_id, first_id, similarity (Jaccard of 5-word shingles).

    Texts of groups alone are cut into shingles; the others leave by the join on the key.
    """
    grouped_texts = with_shingle_key(docs, "doc_id", "text").join(key_groups(docs).select("key", "first_id"), "key")
    sets = grouped_texts.select("key", "doc_id", "first_id", F.array_distinct(T.word_runs(T.normalize_text("text"), 5)).alias("a"))
    firsts = sets.where("doc_id = first_id").select("key", F.col("a").alias("b"))
    both = sets.where("doc_id <> first_id").join(firsts, "key")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("doc_id", "first_id", F.round(shared / (F.size("a") + F.size("b") - shared), 4).alias("similarity")).where(F.col("similarity") >= least)


def pack_quality(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Score of 0 to 100 of each pack of classified chunks, by shares of classes and mean length."""
    share = lambda *names: F.count_if(F.col("chunk_class").isin(*names)) / F.count("*")
    noise = share("OCR_NOISE", "PAGE_NUMBER", "FORMULA_ONLY", "TABLE_FRAGMENT", "SHORT_FRAGMENT")
    score = 70 * share("EDUCATIONAL_TEXT") + 20 * F.least(F.avg(F.length("cleaned")) / 500, F.lit(1.0)) - 20 * share("DUPLICATE_CONTENT") - 15 * noise - 30 * share("EMPTY_CONTENT")
    return classified.groupBy(*keys).agg(F.count("*").alias("chunks"), F.round(T.clamp(score, 0.0, 100.0), 2).alias("quality_score"))
