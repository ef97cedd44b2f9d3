"""Extraction of terms, definitions and summaries, and graphs of what occurs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

DEFINITION = r"(?i)^([A-Za-z][A-Za-z0-9\- ]{2,40}?)\s*(?::|\s-\s|\s+is\s+)\s*(.{10,220})$"
FORMULA = r"[=+*/^]"
#: Words that announce an explanation.
CUES = ("because", "therefore", "for example", "means", "is called")


def term_counts(docs: DataFrame, pattern: str = "[a-z0-9]{4,}") -> DataFrame:
    """doc_id, term, n, first_at (place of its first occurrence), without stop words."""
    found = docs.select("doc_id", F.posexplode(T.tokens("text", pattern)).alias("at", "term")).where(~F.col("term").isin(*T.STOP_WORDS))
    return found.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("at").cast("long").alias("first_at"))


def top_terms(docs: DataFrame, k: int = 8) -> DataFrame:
    """The k commonest terms of each document, ties by first occurrence: doc_id, term, n, rank."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_at")
    return term_counts(docs).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("first_at")


def frequent_bigrams(docs: DataFrame, keys: list[str], least: int = 2, k: int = 20) -> DataFrame:
    """The k commonest pairs of adjacent terms of each group, each in `least` places or more."""
    w = F.filter(T.tokens("text", "[a-z0-9]+"), lambda x: (F.length(x) >= 3) & ~x.isin(*T.STOP_WORDS))
    pairs = docs.select(*keys, F.explode(T.shingles(w, 2)).alias("bigram")).groupBy(*keys, "bigram").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "bigram")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def definitions(docs: DataFrame) -> DataFrame:
    """Lines `term: text`, `term - text` or `term is text`: doc_id, line_no, term, definition."""
    rows = docs.select("doc_id", F.posexplode(T.lines("text")).alias("line_no", "line")).where(F.col("line").rlike(DEFINITION))
    part = lambda i: T.strip(F.regexp_extract("line", DEFINITION, i))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), part(1).alias("term"), F.regexp_replace(part(2), r"\.+$", "").alias("definition"))


def formulas(docs: DataFrame, longest: int = 180) -> DataFrame:
    rows = docs.select("doc_id", F.explode(F.array_distinct(T.lines("text"))).alias("formula"))
    return rows.where(F.col("formula").rlike(FORMULA) & (F.length("formula") < longest))


def glossary(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One definition of each lower-cased term of a group, the first by document and line; with the number found."""
    found = docs.select("doc_id", *keys).join(definitions(docs), "doc_id").withColumn("term_key", T.normalize_text("term"))
    first = F.min_by(F.struct("term", "definition"), F.struct("doc_id", "line_no"))
    return found.groupBy(*keys, "term_key").agg(first.alias("d"), F.count("*").alias("found")).select(*keys, "term_key", "d.term", "d.definition", "found")


def summary_sentences(docs: DataFrame, k: int = 5) -> DataFrame:
    """The k best sentences of each document: doc_id, sentence_no, score, rank.

    A sentence scores 1 for each of the document's top terms in it, 2.5 for a formula sign, 1.5 for a cue and
    0.25 for a capital at its start.
    """
    terms = top_terms(docs).groupBy("doc_id").agg(F.collect_list("term").alias("terms"))
    found = docs.select("doc_id", F.posexplode(T.sentences("text")).alias("sentence_no", "sentence")).join(terms, "doc_id", "left")
    words = T.tokens("sentence", "[a-z0-9]{4,}")
    cue = F.lower("sentence").rlike("|".join(CUES))
    score = F.coalesce(F.size(F.array_intersect(words, F.col("terms"))), F.lit(0)) + F.when(F.col("sentence").rlike(FORMULA), 2.5).otherwise(0.0) + F.when(cue, 1.5).otherwise(0.0) + F.when(F.col("sentence").rlike("^[A-Z]"), 0.25).otherwise(0.0)
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "sentence_no")
    scored = found.select("doc_id", F.col("sentence_no").cast("long").alias("sentence_no"), score.cast("double").alias("score"))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def co_occurrence(items: DataFrame, group: str, item: str) -> DataFrame:
    """Edges src, dst, weight between items of a group, both ways; items of a group are few (top terms, topics)."""
    a, b = items.select(group, F.col(item).alias("src")).distinct(), items.select(group, F.col(item).alias("dst")).distinct()
    return a.join(b, group).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def prerequisites(topics: DataFrame, group: str, topic: str, intro: str = r"(?i)\b(intro|introduction|basics)\b") -> DataFrame:
    """Edges from a topic to the one before it in order, and to all earlier introductory ones: group, topic, prerequisite."""
    w = Window.partitionBy(group).orderBy(topic)
    t = topics.select(group, topic).distinct().withColumn("before", F.lag(topic).over(w))
    earlier = F.collect_list(F.when(F.col(topic).rlike(intro), F.col(topic))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("needs", F.array_distinct(F.concat(F.when(F.col("before").isNotNull(), F.array("before")).otherwise(F.array().cast("array<string>")), earlier)))
    return t.select(group, F.col(topic).alias("topic"), F.explode("needs").alias("prerequisite"))


def expand_topics(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """Topics one edge away from each query's: query_id, topics."""
    near = asked.join(edges, asked["topic"] == edges["src"]).select("query_id", F.col("dst").alias("topic"))
    return asked.select("query_id", "topic").unionByName(near).groupBy("query_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(ends, "node", "left_anti")


def neighbours(rows: DataFrame, key: str, order: str, column: str, reach: int = 2) -> DataFrame:
    """rows with `near`: that column of up to `reach` rows before and after, in order."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumn("near", F.collect_list(column).over(w))


def quizzes(glossary_rows: DataFrame, keys: list[str], options: int = 4) -> DataFrame:
    """A question for each glossary entry, with the next terms of its group, in order, as distractors."""
    w = Window.partitionBy(*keys).orderBy("term_key").rowsBetween(1, options - 1)
    other = F.collect_list("term").over(w)
    question = F.concat(F.lit("Which term means: "), F.col("definition"), F.lit("?"))
    return glossary_rows.select(*keys, question.alias("question"), F.array_sort(F.concat(F.array("term"), other)).alias("options"), F.col("term").alias("answer"))


def flashcards(glossary_rows: DataFrame, keys: list[str]) -> DataFrame:
    return glossary_rows.select(*keys, F.concat(F.lit("What is "), F.col("term"), F.lit("?")).alias("front"), F.col("definition").alias("back"))


def first_class(text: Column) -> Column:
    """Simple kind of a chunk: the first rule that holds."""
    t = F.lower(text)
    return F.when(t.rlike(r"\b(is defined as|definition|refers to)\b"), "definition").when(t.rlike(r"formula|[a-z]\s*=\s*[a-z0-9]"), "formula").when(t.rlike(r"\b(for example|example)\b"), "example").when(t.rlike(r"\b(experiment|activity|procedure)\b"), "experiment").when(t.rlike(r"\b(question|answer)\b|\?"), "qa").otherwise("explanation")
