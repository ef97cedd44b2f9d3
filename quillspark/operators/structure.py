"""Structure of texts: chapters with nested sections and character offsets, repaired chunks, and chunks of even length."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import content as K
from quillspark.operators import corpus as C
from quillspark.sources.scratch import checkpointed

# Fixed values, which must be as they are for equal results.
CHAPTER_LINE = r"^((chapter|unit|lesson|section|topic|ಅಧ್ಯಾಯ|ಪಾಠ)\s+[0-9]+|exercise|questions)"
SECTION_LINE = r"^(exercise|example|activity|question|questions|solve|practice|ಅಭ್ಯಾಸ|ಉದಾಹರಣೆ|ಚಟುವಟಿಕೆ|ಪ್ರಶ್ನೆ|ಪರಿಹಾರ|[0-9]+([.][0-9]+)*\s)"
NUMBERED = r"^(chapter|unit|lesson|section|exercise|question|topic)\s+[0-9]+:?\s*"
LEAST_WORDS, MOST_WORDS, WISHED_LEAST, WISHED_MOST, SPLIT_WORDS = 200, 400, 250, 350, 450
#: Kinds of chunks that may be merged though they differ, either way round.
MIXED = frozenset(frozenset(p) for p in (("concept", "example"), ("concept", "formula_explanation"), ("concept", "tutor_context"), ("example", "tutor_context"), ("formula_explanation", "tutor_context"), ("worked_example", "tutor_context"), ("worked_example", "example")))


def _titled(line: Column, words: int) -> Column:
    return (F.size(F.split(line, r"\s+")) <= words) & line.rlike(r"^\p{Lu}") & line.endswith(":")


def topics(heading: Column) -> Column:
    """Parts of a heading without its number, in small letters, of more than three characters."""
    bare = F.regexp_replace(F.lower(heading), NUMBERED, "")
    return F.filter(F.transform(F.split(bare, r"[;,/\-]"), T.strip), lambda t: F.length(t) > 3)


def chapters(docs: DataFrame) -> DataFrame:
    """Chapters of every document in order: doc_id, chapter_no (from 0), title, start, end, topics, sections (title, start, topics).

    start and end count characters of the text from 0, end exclusive, so substring(text, start + 1, end - start) is
    the chapter. A chapter begins with the line of its heading and ends where the next begins; the last one ends a
    character beyond the text, where a next line would begin. Section headings before the first chapter count for
    nothing. A document without chapters is one, `Document`, from 0 to its end. Null texts have none; doc_id must be
    unique.

    Of a line only its length is shuffled, and its text if it is a heading; sums of lengths give the offsets.
    """
    placed = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    line = T.strip("raw")
    is_chapter = F.lower(line).rlike(CHAPTER_LINE) | _titled(line, 8)
    is_section = F.lower(line).rlike(SECTION_LINE) | _titled(line, 10)
    level = F.when(line == "", None).when(is_chapter, 0).when(is_section, 1)
    marked = placed.select("doc_id", "no", (F.length("raw") + 1).cast("long").alias("size"), level.alias("level"), F.when(level.isNotNull(), line).alias("title"))
    order = Window.partitionBy("doc_id").orderBy("no")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = marked.withColumns({"start": F.sum("size").over(until) - F.col("size"), "chapter_no": F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).over(until) - 1, "n": F.sum("size").over(Window.partitionBy("doc_id")) - 1})
    numbered = summed.where("level is not null and chapter_no >= 0")
    ends = Window.partitionBy("doc_id").orderBy("chapter_no")
    inner = F.array_sort(F.collect_list(F.when(F.col("level") == 1, F.struct("start", "title"))))
    nested = numbered.groupBy("doc_id", "chapter_no").agg(F.first("n").alias("n"), F.max(F.when(F.col("level") == 0, F.col("title"))).alias("title"), F.min("start").alias("start"), inner.alias("s"))
    found = nested.withColumn("end", F.coalesce(F.lead("start").over(ends), F.col("n") + 1))
    sections = F.transform("s", lambda s: F.struct(s["title"].alias("title"), s["start"].alias("start"), topics(s["title"]).alias("topics")))
    shown = found.select("doc_id", F.col("chapter_no").cast("long").alias("chapter_no"), "title", "start", F.col("end").cast("long").alias("end"), topics(F.col("title")).alias("topics"), sections.alias("sections"))
    bare = docs.where("text is not null").join(shown.select("doc_id").distinct(), "doc_id", "left_anti")
    zero = F.lit(0).cast("long")
    whole = bare.select("doc_id", zero.alias("chapter_no"), F.lit("Document").alias("title"), zero.alias("start"), F.length("text").cast("long").alias("end"), topics(F.substring("text", 1, 120)).alias("topics"), F.array().cast("array<struct<title:string,start:bigint,topics:array<string>>>").alias("sections"))
    return shown.unionByName(whole)


def repaired(chunks: DataFrame, keys: list[str], order: str, least: int = 150, most: int = 400, enough: int = 100, part_rows: int = 10_000) -> DataFrame:
    """Chunks of chunks(keys, order, text) cleaned, merged and held to the class GOOD: keys, part, no, text, n_words, merged.

    Lines are filtered as in filter_lines; empty, repeated (anywhere, the first by keys and order stays), running-head
    and noisy chunks go. Adjacent chunks of equal keys are joined by an empty line while what is joined has fewer
    than `least` words, or has `most` at most with the next one. If all chunks have `enough` words in all, only GOOD
    ones stay. Groups of more than part_rows chunks are taken in parts, so no task holds more. Null texts count as
    empty; keys must not be null.
    """
    cleaned = checkpointed(chunks.select(*keys, order, C.filter_lines(F.coalesce("text", F.lit(""))).alias("text")))  # cleaned once, read twice
    total = chunks.agg(F.sum(T.word_count("text")).alias("all_words"))
    marked = K.facts(cleaned).withColumn("_at", F.struct(*keys, order))
    marked = K.with_first(marked, "_at", K.extraction_class, "class").where(~F.col("class").isin("EMPTY", "DUPLICATE", "HEADER_FOOTER", "OCR_NOISE")).select(*keys, order, "text", "words")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    parts = marked.withColumn("part", F.floor(place / part_rows)).groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct(order, "text", "words"))).alias("c"))
    parts = parts.withColumns({"texts": F.transform("c", lambda x: x["text"]), "starts": C.fold_starts(F.transform("c", lambda x: x["words"].cast("long")), most, least=least)})
    stop = lambda i: F.coalesce(F.get("starts", i + 1), F.size("texts") + 1)
    merged = parts.select(*keys, "part", F.posexplode(F.transform("starts", lambda s, i: F.struct(F.array_join(F.slice("texts", s, stop(i) - s), "\n\n").alias("text"), (stop(i) - s).cast("long").alias("merged")))).alias("no", "m"))
    again = K.facts(merged.select(*keys, "part", F.col("no").cast("long").alias("no"), "m.text", "m.merged")).withColumn("again", F.lit(False))
    return again.join(F.broadcast(total)).where((F.col("all_words") < enough) | (K.extraction_class() == "GOOD")).select(*keys, "part", "no", "text", F.col("words").alias("n_words"), "merged")  # one row


class Piece(NamedTuple):
    text: str
    words: int
    kind: str
    topic: str
    rows: tuple[int, ...]
    action: str = "kept"
    context: tuple[str, ...] = ()


_WORD, _SENTENCE_END = re.compile("[A-Za-z0-9]+"), re.compile(r"(?<=[.!?])\s+")


def _words(text: str) -> int:
    return len(_WORD.findall(text))


def _fits(a: Piece, b: Piece) -> bool:
    """Whether two neighbours are of one topic, as far as known, and of kinds that go together."""
    return (not a.topic or not b.topic or a.topic == b.topic) and (a.kind == b.kind or frozenset((a.kind, b.kind)) in MIXED)


def _join(a: Piece, b: Piece) -> Piece:
    return a._replace(text=f"{a.text}\n\n{b.text}".strip(), words=a.words + b.words, rows=(*a.rows, *b.rows), action="merged")


def _gather(pieces: list[Piece]) -> list[Piece]:
    """Short neighbours together, until what is held has WISHED_LEAST words; a piece that is long enough stays alone."""
    out: list[Piece] = []
    held: list[Piece] = []
    size = 0
    done = lambda group: group[0] if len(group) == 1 else _join(group[0], _together(group[1:]))
    for p in pieces:
        if held and not (_fits(held[-1], p) and size + p.words <= MOST_WORDS):
            out.append(done(held))
            held, size = [], 0
        held.append(p)
        size += p.words
        if size >= WISHED_LEAST or len(held) == 1 and p.words >= LEAST_WORDS:
            out.append(done(held))
            held, size = [], 0
    if held:
        last = _together(held)
        out[-1:] = [_join(out[-1], last)] if out and _fits(out[-1], held[0]) and out[-1].words + size <= MOST_WORDS else [*out[-1:], done(held)]
    return out


def _together(pieces: list[Piece]) -> Piece:
    out = pieces[0]
    for p in pieces[1:]:
        out = _join(out, p)
    return out


def _sentences(p: Piece) -> list[Piece]:
    """A long piece in groups of whole sentences of WISHED_MOST words at most; a short last group goes to the one before if it may."""
    found = [s.strip() for s in _SENTENCE_END.split(p.text) if s.strip()]
    if p.words <= SPLIT_WORDS or len(found) < 2:
        return [p]
    groups: list[tuple[list[str], int]] = []
    for s in found:
        n = _words(s)
        if groups and groups[-1][1] + n <= WISHED_MOST:
            groups[-1] = ([*groups[-1][0], s], groups[-1][1] + n)
        else:
            groups.append(([s], n))
    if len(groups) > 1 and groups[-1][1] < LEAST_WORDS and groups[-2][1] + groups[-1][1] <= MOST_WORDS:
        last, n = groups.pop()
        groups[-1] = ([*groups[-1][0], *last], groups[-1][1] + n)
    return [p] if len(groups) == 1 else [p._replace(text=" ".join(g), words=n, action="split") for g, n in groups]


def _windows(p: Piece) -> list[Piece]:
    """A piece of too many words in equal windows of words."""
    if p.words <= MOST_WORDS:
        return [p]
    found = _WORD.findall(p.text)
    each = math.ceil(len(found) / max(2, math.ceil(len(found) / WISHED_MOST)))
    return [p._replace(text=" ".join(found[i : i + each]), words=len(found[i : i + each]), action="window") for i in range(0, len(found), each)]


def _back(pieces: list[Piece]) -> list[Piece]:
    """Short pieces joined to the one before, where kinds and length allow."""
    out: list[Piece] = []
    for p in pieces:
        if out and p.words < LEAST_WORDS and _fits(out[-1], p) and out[-1].words + p.words <= MOST_WORDS:
            out[-1] = _join(out[-1], p)
        else:
            out.append(p)
    return out


def _with_context(p: Piece) -> Piece:
    """A short piece with what is known about it, as much as fits, if that makes it long enough."""
    text, size = p.text, p.words
    for more in p.context:
        if size < LEAST_WORDS and size + _words(more) <= MOST_WORDS:
            text, size = f"{text}\n\n{more}".strip(), size + _words(more)
    return p._replace(text=text, words=size, action="context") if p.words < LEAST_WORDS <= size else p


def _any_neighbour(pieces: list[Piece]) -> list[Piece]:
    """Short pieces joined to the next, or else to the one before, whatever their kind, again and again until none can be."""
    while True:
        out: list[Piece] = []
        rest = iter(range(len(pieces)))
        for i in rest:
            p, after = pieces[i], pieces[i + 1] if i + 1 < len(pieces) else None
            if p.words < LEAST_WORDS and after is not None and p.words + after.words <= MOST_WORDS:
                out.append(_join(p, after))
                next(rest)
            elif p.words < LEAST_WORDS and out and out[-1].words + p.words <= MOST_WORDS:
                out[-1] = _join(out[-1], p)
            else:
                out.append(p)
        if len(out) == len(pieces):
            return out
        pieces = out


def even(pieces: list[Piece]) -> list[Piece]:
    """Pieces of one group brought to LEAST_WORDS to MOST_WORDS words; what stays shorter goes."""
    out = [w for p in _gather(pieces) for s in _sentences(p) for w in _windows(s)]
    out = _any_neighbour([_with_context(p) for p in _back(out)])
    return [w for p in out for w in _windows(p) if w.words >= LEAST_WORDS]


def even_chunks(chunks: DataFrame, keys: list[str], order: str, part_rows: int = 10_000) -> DataFrame:
    """Chunks of chunks(keys, order, text, kind, topic, context) of 200 to 400 words: keys, part, no, text, n_words, kind, action, merged (the places of its chunks in their part, from 0).

    In a group, short neighbours of one topic and fitting kinds are merged; chunks above 450 words are split between
    sentences, those above 400 in windows of words; what is still short is merged back, filled up from its context
    (an array of strings), merged with any neighbour to a fixed point, and left out if it stays short. Null texts
    count as empty, null kinds and topics as unknown. Groups of more than part_rows chunks are taken in parts.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = chunks.select(*keys, place.alias("_place"), blank("text"), blank("kind"), blank("topic"), F.coalesce("context", F.array().cast("array<string>")).alias("context"))
    parts = rows.withColumn("part", F.floor(F.col("_place") / part_rows)).groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("_place", "text", "kind", "topic", "context"))).alias("c"))
    made = pa.list_(pa.struct([("text", pa.string()), ("n_words", pa.int64()), ("kind", pa.string()), ("action", pa.string()), ("merged", pa.list_(pa.int64()))]))
    n = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                out = []
                for c in one.column(n).to_pylist():
                    pieces = [Piece(x["text"].strip(), _words(x["text"]), x["kind"], x["topic"], (i,), context=tuple(x["context"])) for i, x in enumerate(c)]
                    out.append([{"text": p.text, "n_words": p.words, "kind": p.kind, "action": p.action, "merged": list(p.rows)} for p in even(pieces)])
                yield pa.RecordBatch.from_arrays([*[one.column(i) for i in range(n)], pa.array(out, made)], [*keys, "part", "made"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields[:n])
    done = parts.mapInArrow(run, f"{kept}, made array<struct<text: string, n_words: long, kind: string, action: string, merged: array<long>>>")
    return done.select(*keys, "part", F.posexplode("made").alias("no", "m")).select(*keys, "part", F.col("no").cast("long").alias("no"), "m.*")
