"""Concepts of a group of texts: candidates with evidence, validation by rules, and removal of contained names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.scan import strings_held
from quillspark.sources.scratch import checkpointed

# Fixed values, which must be as they are for equal results: word lists, patterns and limits.
#: Words that are never candidates.
LABELS = ("activity", "chapter", "class", "curiosity", "example", "exercise", "figure", "ganita", "grade", "image", "images", "prakash", "question", "science", "table", "textbook")
#: Names that are no concepts.
NOISE = (
    "a b", "above", "about", "after", "activity", "again", "along", "also", "another", "based", "below", "between", "called", "chapter", "class", "curiosity", "during", "each", "example", "exercise", "every", "fig", "figure", "find", "following", "from", "ganita", "general", "grade",
    "have", "image", "images", "introduction", "let us", "lets explore", "like", "more", "number", "page", "prakash", "question", "questions", "same", "science", "some", "table", "textbook", "that", "their", "there", "these", "they", "this", "three", "what", "where", "which", "while", "will", "with", "would", "your",
)
#: First words of clauses.
OPENERS = ("and", "but", "if", "when", "while", "where", "which", "that", "this", "these", "those", "there")
IMPRINT = ("isbn", "copyright", "ncert", "textbook of", "published by")
DEFINED = r"\b([A-Z]?[A-Za-z][A-Za-z\s-]{2,50}?)\s+(?:is|are|means|refers to|is called|are called)\s+([^.?!]{20,260}[.?!])"
FORMULA = r"([A-Za-z0-9πθ°%,\s]{1,50}(?:=|<|>|≤|≥|≈|∝)[A-Za-z0-9πθ°%+\-*/×÷^().,\s]{1,100})"
OBJECTIVE = r"\b(?:learn|understand|explain|identify|describe|compare|calculate|observe|explore)\b[^.?!]{20,180}[.?!]"
WORKED, SHOWN = r"\b(solution|solved|therefore|hence)\b", r"\b(example|for example)\b"
#: Types in the order in which they are tested, with what their evidence says.
SAID = (("THEOREM", "theorem"), ("LAW", "(^|[^a-z0-9_])law([^a-z0-9_]|$)"), ("PRINCIPLE", "principle|rule|property"), ("PROCESS", "process|cycle|formation|method"))
STRONG_TYPES = ("DEFINITION", "FORMULA", "LAW", "THEOREM", "PROCESS")
PRIORITY, CANDIDATES, EVIDENCE = 35, 20, 5  # words of a group, those that are candidates, and those that gather evidence
LONGEST, LEAST, EVIDENCE_CHARS, ROW_CHARS = 70, 4, 2000, 600
MOST_LISTED, MOST_ROWS, BEST = 5, 30, 35


def clean_term(term: Column) -> Column:
    """ASCII letters, digits and hyphens with single spaces, 60 characters at most; empty for labels and numbers."""
    t = T.strip(F.regexp_replace(F.regexp_replace(term, r"[^A-Za-z0-9\s-]", " "), r"\s+", " "))
    return F.when(F.lower(t).isin(*LABELS) | t.rlike("^[0-9]+$"), "").otherwise(F.substring(t, 1, 60))


def title(name: Column) -> Column:
    """Every run of letters with a capital first, as in X-Ray."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit("[a-z]+|[^a-z]+"), 0), F.initcap), "")


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join in which null keys are equal."""
    other = right.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns])
    return left.join(other, reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[f"_{c}"]) for c in on]), how).drop(*[f"_{c}" for c in on])


def priority_words(rows: DataFrame, keys: list[str], k: int = PRIORITY) -> DataFrame:
    """The k commonest words of each group, ties by first occurrence: keys, term, n, place (from 1)."""
    found = rows.select(*keys, "doc_id", F.posexplode(T.tokens("text", "[a-z0-9]+")).alias("at", "term"))
    found = found.where((F.length("term") >= LEAST) & ~F.col("term").isin(*LABELS) & ~F.col("term").rlike("^[0-9]+$"))
    # places of occurrence are needed of terms that are common enough only
    often = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("n")))
    common = checkpointed(found.groupBy(*keys, "term").agg(F.count("*").alias("n")).withColumn("often", often).where(F.col("often") <= k).drop("often"))
    counts = joined(found, common, [*keys, "term"], "inner").groupBy(*keys, "term", "n").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("first")


def defined_terms(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Terms that a sentence defines: keys, doc_id, no (of the match in its text), term (cleaned), said (the whole match).

    A match ends with its sentence and holds no other end, so a sentence has one at most. Only sentences with a verb
    that defines are searched for it, and the term is cut out of the match.
    """
    sentences = F.filter(F.regexp_extract_all("text", F.lit("[^.?!]++[.?!]?"), F.lit(0)), lambda s: s.rlike(r"(?i)\s(?:is|are|means|refers\s+to)\s"))
    matches = F.filter(F.transform(sentences, lambda s: F.regexp_extract(s, "(?i)" + DEFINED, 0)), lambda m: m != "")
    found = rows.where(F.col("text").rlike(r"(?i)\s(is|are|means|refers)\s")).select(*keys, "doc_id", F.posexplode(matches).alias("no", "m"))
    found = found.select(*keys, "doc_id", "no", clean_term(F.regexp_extract("m", "(?i)" + DEFINED, 1)).alias("term"), T.strip(F.regexp_replace("m", r"\s+", " ")).alias("said"))
    return found.where("term <> ''")


def formulas(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Formulas in texts: keys, formula, a row for each occurrence."""
    marked = rows.where(F.col("text").rlike("[=<>≤≥≈∝]")).select(*keys, F.explode(F.regexp_extract_all("text", F.lit(FORMULA), F.lit(1))).alias("f"))
    return marked.select(*keys, T.strip(F.regexp_replace("f", r"\s+", " ")).alias("formula")).where(F.length("formula").between(3, 120))


def _early_text(rows: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """The first EVIDENCE_CHARS characters or so of a group's rows in order, ROW_CHARS of each: on, evidence."""
    order = Window.partitionBy(*on).orderBy("doc_id")
    some = rows.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= EVIDENCE_CHARS)  # as every row adds a character or more
    before = F.coalesce(F.sum(F.length("start") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumn("_before", before).where(F.col("_before") < EVIDENCE_CHARS)
    return some.groupBy(*on).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "start"))), lambda x: x["start"]), " ").alias("evidence"))


def _words_and_terms(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The commonest words that are candidates, and the terms that sentences define with their key; stored, as both are read often."""
    words = priority_words(rows, keys).where(F.col("place") <= CANDIDATES)
    return checkpointed(words), checkpointed(defined_terms(rows, keys).withColumn("key", F.lower("term")))


def candidate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The names of all candidates in small letters, each once: keys, key."""
    words, defined = _words_and_terms(rows.select(*keys, "doc_id", "text").where(T.strip("text") != ""), keys)
    return words.select(*keys, F.col("term").alias("key")).unionByName(defined.select(*keys, "key")).distinct()


def candidates(rows: DataFrame, keys: list[str], evidence: bool = True) -> DataFrame:
    """Candidate concepts of each group of rows(keys, doc_id, text) with their evidence.

    A group's commonest words are candidates, and so are the terms that its sentences define. Columns: keys, key
    (the name in small letters), name, place (their order: words by rank, then terms by first definition),
    frequency, definition (the first, null if none), n_formulas, n_objectives, n_examples, n_worked, n_chunks and
    evidence (the start of the texts that speak of it). The first EVIDENCE words gather all formulas, objectives and
    examples of their group, each counted to MOST_LISTED. Without evidence there are no columns n_objectives,
    n_examples, n_worked, n_chunks and evidence, which rejection does not ask for. Blank rows have no part; keys may be null; an empty table
    gives no rows.

    Everything is grouped with partial aggregates; windows that order texts take a bounded number of rows a group.
    """
    rows = rows.select(*keys, "doc_id", "text").where(T.strip("text") != "")
    words, defined = _words_and_terms(rows, keys)
    start = F.substring("text", 1, ROW_CHARS).alias("start")
    short = lambda c, n: T.strip(F.regexp_replace(F.substring(c, 1, n), r"\s+", " "))
    objectives = rows.select(*keys, F.explode(F.regexp_extract_all("text", F.lit("(?i)" + OBJECTIVE), F.lit(0))).alias("o"))
    is_worked, is_shown = F.col("text").rlike("(?i)" + WORKED), F.col("text").rlike("(?i)" + SHOWN)
    shown = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(F.when(is_worked, short("text", 1200))).alias("n_worked"), F.count_distinct(F.when(~is_worked & is_shown, short("text", 1000))).alias("n_examples"))

    if not evidence:
        shown = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    facts = joined(shown, formulas(rows, keys).groupBy(*keys).agg(F.count_distinct("formula").alias("n_formulas")), keys)
    if evidence:
        facts = joined(facts, objectives.groupBy(*keys).agg(F.count_distinct(T.strip(F.regexp_replace("o", r"\s+", " "))).alias("n_objectives")), keys)
        facts = joined(facts, _early_text(rows.select(*keys, "doc_id", start), keys, keys), keys)
    by_term = defined.groupBy(*keys, "key").agg(F.count("*").alias("n_defined"), F.min(F.struct("doc_id", "no", "term", "said")).alias("d"))
    word = joined(joined(words.withColumn("key", F.col("term")), facts, keys), by_term, [*keys, "key"])
    first = F.col("place") <= EVIDENCE
    counted = lambda c: F.when(first, F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(MOST_LISTED))).otherwise(0).cast("long").alias(c)
    none = lambda c: F.lit(0).cast("long").alias(c)
    listed = ("n_formulas", "n_objectives", "n_examples", "n_worked") if evidence else ("n_formulas",)
    more = lambda n: [F.least(n, F.lit(MOST_ROWS)).cast("long").alias("n_chunks"), F.col("evidence")] if evidence else []
    order = lambda lead, doc, no: F.struct(F.lit(lead).alias("lead"), doc.cast("long").alias("doc_id"), no.cast("long").alias("no"))
    ranked = word.select(*keys, "key", title(F.col("key")).alias("name"), order(0, F.col("place"), F.lit(0)).alias("place"), (F.col("n_rows") * F.when(first, 2).otherwise(1) + 2 * F.coalesce("n_defined", F.lit(0))).alias("frequency"), F.col("d.said").alias("definition"), *[counted(c) for c in listed], *more(F.col("n_rows")))
    rest = joined(by_term, words.select(*keys, F.col("term").alias("key")), [*keys, "key"], "left_anti")
    if evidence:
        own = joined(defined.select(*keys, "key", "doc_id").distinct(), rest.select(*keys, "key"), [*keys, "key"], "left_semi")
        texts = own.join(rows.select("doc_id", start), "doc_id")
        rest = joined(rest, _early_text(texts, keys, [*keys, "key"]), [*keys, "key"])
    named = rest.select(*keys, "key", title(F.col("d.term")).alias("name"), order(1, F.col("d.doc_id"), F.col("d.no")).alias("place"), (2 * F.col("n_defined") + 1).alias("frequency"), F.col("d.said").alias("definition"), *[none(c) for c in listed], *more(F.lit(1)))
    return ranked.unionByName(named)


def rejection(name: Column, frequency: Column, has_definition: Column, has_formula: Column) -> Column:
    """Why a name is no concept: the first rule that holds, null if none does."""
    low = T.strip(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s-]", " "), r"\s+", " "))

    def rules(n: Column) -> list[tuple[str, Column]]:
        words = F.split(n, " ")
        return [
            ("empty", n == ""),
            ("shorter than threshold", F.length(n) < LEAST),
            ("too long", F.length(n) > LONGEST),
            ("stopword phrase", n.isin(*NOISE)),
            ("chapter label", n.rlike(r"^(chapter|unit|lesson|class|grade)\s*[0-9]+")),
            ("page artifact", n.rlike(r"^(fig|figure|table)\s*[0-9]+")),
            ("page number", n.rlike("^[0-9]+$")),
            ("publisher text", n.rlike("|".join(IMPRINT))),
            ("ocr fragment", name.rlike("[�\\x07\\x08]") | n.rlike(r"([a-z]\s){4,}[a-z]")),
            ("low alphabetic density", F.length(F.regexp_replace(n, "[^a-z]", "")) / F.length(n) < 0.45),
            ("clause opener", F.get(words, F.lit(0)).isin(*OPENERS)),
            ("long phrase", (F.size(words) > 5) & ~has_formula),
            ("weak single-token evidence", (F.size(words) == 1) & (frequency < 2) & ~has_definition),
            ("repeated tokens", F.size(F.array_distinct(words)) < F.size(words) / 2),
        ]

    return T.bound(low, lambda n: F.coalesce(*[F.when(holds, F.lit(why)) for why, holds in rules(n)]))


def concept_type(name: Column, evidence: Column, has_formula: Column, has_example: Column, has_definition: Column) -> Column:
    said = F.lower(F.concat_ws(" ", name, F.coalesce(evidence, F.lit(""))))
    by_word = [F.when(said.rlike(pattern), F.lit(kind)) for kind, pattern in SAID]
    return F.coalesce(F.when(has_formula | said.rlike("[=<>≤≥]"), F.lit("FORMULA")), *by_word, F.when(has_example, F.lit("EXAMPLE")), F.when(has_definition, F.lit("DEFINITION")), F.lit("CONCEPT"))


def valid_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that no rule rejects, without what their type hangs on: keys, key, name, place, frequency, definition, n_formulas."""
    return candidates(rows, keys, evidence=False).where(rejection(F.col("name"), F.col("frequency"), F.col("definition").isNotNull(), F.col("n_formulas") > 0).isNull())


def validated(found: DataFrame) -> DataFrame:
    """Candidates with reason (null for valid ones) and concept_type."""
    formula, example, definition = F.col("n_formulas") > 0, F.col("n_examples") + F.col("n_worked") > 0, F.col("definition").isNotNull()
    return found.withColumns({"reason": rejection(F.col("name"), F.col("frequency"), definition, formula), "concept_type": concept_type(F.col("name"), F.col("evidence"), formula, example, definition)})


def holding_pairs(parts: DataFrame, wholes: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a group of which one name is part of a longer one: keys, part, whole. parts and wholes: keys and key, each once; keys not null.

    Every name is read once, for all parts at once; no pair is formed but those found. Empty names take no part.
    """
    texts = wholes.select(*keys, F.col("key").alias("whole"), F.col("key").alias("text")).repartition(int(wholes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = strings_held(texts, parts.select(*keys, F.col("key").alias("probe")), keys, [*keys, "whole"])
    return held.where("probe <> whole").select(*keys, F.col("probe").alias("part"), "whole")


def contained_pairs(names: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of distinct names of a group of which one is part of the other: keys, part, whole. See holding_pairs."""
    names = checkpointed(names.select(*keys, "key"))
    return holding_pairs(names, names, keys)


def without_contained(found: DataFrame, keys: list[str], strength: str, order: str, max_rounds: int = 100) -> DataFrame:
    """found without names that are part of, or hold, an earlier name that stays and is as strong; keys not null.

    A name goes if one that comes before it in order, is kept, contains it or is contained in it, and is at least as
    strong. Whether it stays thus hangs on earlier decisions: each round decides the names all of whose blockers are
    decided, so there are as many rounds as the longest chain of blockers, and a group is never gathered.
    """
    named = found.select(*keys, "key", F.col(strength).alias("s"), F.col(order).alias("o"))
    pairs = contained_pairs(named, keys)
    both = pairs.select(*keys, F.col("part").alias("key"), F.col("whole").alias("other")).unionByName(pairs.select(*keys, F.col("whole").alias("key"), F.col("part").alias("other")))
    other = named.select(*keys, F.col("key").alias("other"), F.col("s").alias("other_s"), F.col("o").alias("other_o"))
    blocks = both.join(named, [*keys, "key"]).join(other, [*keys, "other"]).where((F.col("other_o") < F.col("o")) & (F.col("other_s") >= F.col("s"))).select(*keys, "key", "other")
    blocks = checkpointed(blocks)
    state = checkpointed(blocks.select(*keys, "key").unionByName(blocks.select(*keys, F.col("other").alias("key"))).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    for _ in range(max_rounds):
        by = blocks.join(state.select(*keys, F.col("key").alias("other"), F.col("kept").alias("other_kept")), [*keys, "other"])
        said = by.groupBy(*keys, "key").agg(F.bool_or(F.coalesce("other_kept", F.lit(False))).alias("blocked"), F.bool_or(F.col("other_kept").isNull()).alias("open"))
        new = F.when(F.coalesce("blocked", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = checkpointed(state.join(said, [*keys, "key"], "left").select(*keys, "key", F.coalesce("kept", new).alias("kept")))
        if state.where("kept is null").isEmpty():
            return found.join(state.where("not kept"), [*keys, "key"], "left_anti")
    raise RuntimeError("containment did not settle")


def concepts(rows: DataFrame, keys: list[str], best: int = BEST) -> DataFrame:
    """The best concepts of each group: valid candidates without contained names, strongest types and most evidence first."""
    valid = validated(candidates(rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])), keys)).where("reason is null").drop("reason")
    valid = checkpointed(valid.withColumn("strength", F.col("n_chunks") + F.col("n_formulas") + F.col("n_examples") + F.col("n_worked")))
    kept = without_contained(valid, keys, "strength", "place")
    order = Window.partitionBy(*keys).orderBy(F.desc(F.when(F.col("concept_type").isin(*STRONG_TYPES), 3).otherwise(1)), F.desc(F.col("n_formulas") + F.col("n_examples") + F.col("n_worked")), F.desc("n_chunks"), "place")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best)
