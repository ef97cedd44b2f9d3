"""Looking things up by name: aliases within texts, references by ordered keys, and substrings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.scan import strings_held

#: Characters of all aliases that are sent to every executor as one automaton; larger lists are joined.
AUTOMATON_CHARS = 8_000_000
#: A word or a single other character: what \b lies between.
TOKEN = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]"


def clean_topic(text: Column) -> Column:
    """Small letters, underscores and hyphens as spaces, single spaces, none at the ends."""
    return T.strip(F.regexp_replace(F.translate(T.strip(F.lower(text)), "_-", "  "), r"\s+", " "))


def _by_automaton(texts: DataFrame, known: list[tuple[str, int]]) -> DataFrame:
    """id, priority: the first in order of the aliases that stand in a text between word boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for alias, priority in known:
            automaton.add_word(alias, (len(alias), priority))
        automaton.make_automaton()
        letter = re.compile(r"\w")
        inside = lambda text, at: 0 <= at < len(text) and letter.match(text[at]) is not None
        edge = lambda text, at: inside(text, at - 1) != inside(text, at)
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                best = None
                for end, (size, priority) in automaton.iter(text):
                    if (best is None or priority < best) and edge(text, end + 1 - size) and edge(text, end + 1):
                        best = priority
                if best is not None:
                    ids.append(i)
                    found.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["id", "priority"])

    if not known:
        return texts.select("id", F.lit(None).cast("long").alias("priority")).limit(0)
    return texts.mapInArrow(run, "id long, priority long")


def _by_join(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """The same by a join: runs of as many tokens as some alias has, with a word on one side of each border only."""
    tokens = lambda c: F.regexp_extract_all(c, F.lit(TOKEN), 0)
    sized = aliases.select("alias", "priority", F.size(tokens(F.col("alias"))).alias("n"))
    sizes = sized.groupBy("n").agg(F.count("*").alias("aliases"))  # as many rows as there are lengths of aliases
    word = lambda c: F.coalesce(c.rlike(r"^[\p{L}\p{N}\p{M}_]"), F.lit(False))
    t = texts.select("id", tokens(F.col("text")).alias("t"))
    placed = t.select("id", "t", F.posexplode("t").alias("at", "first")).join(F.broadcast(sizes), F.col("at") + F.col("n") <= F.size("t"))
    run = placed.select("id", F.array_join(F.slice("t", F.col("at") + 1, F.col("n")), "").alias("alias"), (word(F.get("t", F.col("at") - 1)) != word(F.col("first"))).alias("starts"), (word(F.get("t", F.col("at") + F.col("n") - 1)) != word(F.get("t", F.col("at") + F.col("n")))).alias("ends"))
    return run.where("starts and ends").select("id", "alias").distinct().join(sized, "alias").groupBy("id").agg(F.min("priority").alias("priority"))


def normalize_topics(rows: DataFrame, column: str, aliases: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """rows with topic, the canonical topic of a column, and alias, what led to it (null if nothing did).

    aliases: alias, canonical, priority (a whole number; the first in order wins, then the alias). The cleaned text is looked up as a whole;
    else the first alias in order that stands in it between word boundaries counts; else the topic is the cleaned
    text. Null texts have null topics. Rows, repeated ones too, stay as they are; empty aliases are left out.

    All aliases are sought in one pass over the texts, by an automaton on every executor. It is sent only if the
    aliases have automaton_chars characters in all; beyond that runs of words are joined with the aliases.
    """
    keyed = rows.withColumn("_quill_text", clean_topic(F.col(column))).withColumn("_quill_no", F.xxhash64("_quill_text"))
    known = aliases.select(clean_topic(F.col("alias")).alias("alias"), clean_topic(F.col("canonical")).alias("canonical"), F.col("priority").cast("long").alias("priority")).where("alias <> ''")
    known = known.groupBy("alias").agg(F.min_by(F.struct("canonical", "priority"), F.struct("priority", "canonical")).alias("c")).select("alias", "c.canonical", "c.priority")
    ranked = known.groupBy("priority").agg(F.min(F.struct("alias", "canonical")).alias("c")).select("priority", "c.alias", "c.canonical")
    texts = keyed.where("_quill_text <> ''").select(F.col("_quill_no").alias("id"), F.col("_quill_text").alias("text")).distinct()
    chars = ranked.agg(F.sum(F.length("alias") + 8)).first()[0] or 0
    found = _by_automaton(texts, [(r.alias, r.priority) for r in ranked.select("alias", "priority").collect()]) if chars <= automaton_chars else _by_join(texts, ranked)
    inside = found.groupBy(F.col("id").alias("_quill_no")).agg(F.min("priority").alias("priority")).join(ranked, "priority").select("_quill_no", F.col("alias").alias("_quill_in"), F.col("canonical").alias("_quill_topic"))
    whole = known.select(F.col("alias").alias("_quill_text"), F.col("canonical").alias("_quill_whole"))
    out = keyed.join(inside, "_quill_no", "left").join(whole, "_quill_text", "left")
    topic = F.coalesce("_quill_whole", "_quill_topic", "_quill_text")
    return out.select(*[F.col(c) for c in rows.columns if c not in ("topic", "alias")], topic.alias("topic"), F.when(F.col("_quill_whole").isNotNull(), F.col("_quill_text")).otherwise(F.col("_quill_in")).alias("alias"))


def resolve(asked: DataFrame, references: DataFrame, asked_keys: list[Column], reference_keys: list[Column], agree: list[str], order: str) -> DataFrame:
    """asked with the reference that the first of its keys finds: asked's columns, reference (its `order` column) and key_no (from 0), nulls where none does.

    Any of a reference's keys may be hit, but only references that are equal in the columns `agree` count; of several
    the smallest in `order` is taken. Keys are compared as strings; null and empty keys find nothing. Of the references
    that share a key the smallest alone is joined, so no pair is formed but one for each key asked.
    """
    keyed = asked.withColumn("_quill_no", F.xxhash64(*[F.col(c).cast("string") for c in asked.columns]))
    wanted = keyed.select("_quill_no", *agree, F.posexplode(F.array(*[k.cast("string") for k in asked_keys])).alias("key_no", "key")).where("key <> ''")
    held = references.select(F.col(order).alias("reference"), *agree, F.explode(F.array_distinct(F.array(*[k.cast("string") for k in reference_keys]))).alias("key")).where("key <> ''")
    held = held.groupBy("key", *agree).agg(F.min("reference").alias("reference"))
    best = wanted.join(held, ["key", *agree]).groupBy("_quill_no").agg(F.min(F.struct("key_no", "reference")).alias("b"))
    return keyed.join(best, "_quill_no", "left").select(*asked.columns, F.col("b.reference").alias("reference"), F.col("b.key_no").cast("long").alias("key_no"))


def substring_hits(docs: DataFrame, probes: DataFrame, scope: list[str], text: str = "text", result_keys: bool = False) -> DataFrame:
    """Documents of a probe's scope whose text holds the probe: probe_id, doc_id, hit (true).
    With result_keys the scope comes first, for ids that are unique within their scope only.

    docs: scope, doc_id and a text; probes: scope, probe_id and probe. Texts are read once for all probes at once and
    are not shuffled; see strings_held. Case counts. Null texts, probes and scopes find nothing; repeated doc_ids are
    rows of one document.
    """
    own = probes.select(*scope, "probe_id", "probe").where("probe <> ''").distinct()
    held = strings_held(docs.select(*scope, "doc_id", F.col(text).alias("text")), own, scope, [*scope, "doc_id"])
    return held.join(own, [*scope, "probe"]).select(*(scope if result_keys else []), "probe_id", "doc_id").distinct().withColumn("hit", F.lit(True))
