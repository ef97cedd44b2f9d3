"""What of a source is found in what was published from it: related names, coverage by kind, and concept graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.scan import names_met, strings_held
from quillspark.sources.scratch import checkpointed

# Kinds of items, with the least length of their terms, the terms that count at most, and the share that must be found.
OVERLAPS = {"definition": (5, 12, 0.35), "example": (5, 12, 0.35), "objective": (5, 12, 0.35), "formula": (2, 10, 0.3)}
KINDS = ("concept", *OVERLAPS)
LEAST_SHARE, MOST_MISSING = 0.65, 40


def _tokens(c: Column) -> Column:
    return F.array_distinct(T.tokens(c, "[a-z0-9]{4,}"))


def related_names(texts: DataFrame, names: DataFrame, keys: list[str], least: float = LEAST_SHARE) -> DataFrame:
    """Names of a group that a text is about: keys, text_id, name, contained. texts: keys, text_id, text; names: keys, name.

    A text is about a name that it contains, in small letters, or of whose distinct words of four characters or more
    it has the share `least`. Null and empty names and texts, and rows with null keys, are about nothing; repeats
    count once. Names are sought in one pass over the texts, see names_met: in the bytes, and by n - ceil(least n) + 1
    of their words, those in the fewest texts, one of which every text with enough of them has.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = checkpointed(names.select(*keys, "name").where("name <> ''").distinct().select("*", _tokens(F.col("name")).alias("words")))
    whole = texts.select(*keys, "text_id", "text").where("text <> ''").distinct()
    whole = checkpointed(whole.repartition(parts).select(*keys, "text_id", F.lower("text").alias("text"), _tokens(F.col("text")).alias("words")))
    listed = own.select(*keys, "name", F.explode("words").alias("word"))
    held = whole.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("texts"))
    often = listed.join(held, [*keys, "word"], "left").groupBy(*keys, "name").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "word"))).alias("words"))
    rest = own.where(F.size("words") == 0).select(*keys, "name", F.array().cast("array<string>").alias("words"))
    ranked = often.select(*keys, "name", F.col("words.word").alias("words")).unionByName(rest)
    need = F.greatest(F.ceil(least * F.size("words") - 1e-9), F.lit(1)).alias("need")
    found = names_met(whole, ranked.select(*keys, "name", F.lower("name").alias("low"), "words", need), keys, [*keys, "text_id"])
    if whole.groupBy(*keys, "text_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return found
    return found.groupBy(*keys, "text_id", "name").agg(F.bool_or("contained").alias("contained"))  # of texts that share an id


def coverage(items: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """How much of each kind of items is found in a group's published texts: keys, kind, n, retained, percent, missing.

    items: keys, kind (one of KINDS) and text, each distinct one counted once; published: text, and keys as far as they
    set what belongs to a group (a table without any is held against every group). A concept is retained if a published text contains its normalised name. Other items are retained if enough of their distinct
    normalised words, of some length and up to a number, are among all words published, or if they have none that
    long; formulas also if a text contains them. percent is 100 for kinds without items. missing lists the first
    MOST_MISSING in order. Every group of items has a row a kind; null texts count as empty; keys must not be null.

    Published words are made distinct before they meet the words of items, and texts are read once for all names at once.
    """
    own = checkpointed(items.select(*keys, "kind", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("norm", T.normalize_text("text")))
    scope = [k for k in keys if k in published.columns] or ["_all"]
    own, published = (df if scope != ["_all"] else df.withColumn("_all", F.lit(0)) for df in (own, published))
    out = published.select(*scope, T.normalize_text("text").alias("text"))
    sought = own.where(F.col("kind").isin("concept", "formula")).select(*scope, F.col("norm").alias("probe"))
    inside = strings_held(out, sought, scope, scope, once=True).distinct().select(*scope, F.col("probe").alias("norm"), F.lit(True).alias("inside"))
    vocabulary = out.select(*scope, F.explode(F.array_distinct(F.split("text", " "))).alias("word")).where("word <> ''").distinct()
    of = lambda i: reduce(lambda a, k: F.when(F.col("kind") == k, F.lit(OVERLAPS[k][i])).otherwise(a), OVERLAPS, F.lit(None))
    both = list(dict.fromkeys([*keys, *scope]))
    terms = own.where("kind <> 'concept'").select(*both, "kind", "text", F.array_distinct(F.split("norm", " ")).alias("w"), of(0).alias("least"), of(1).alias("most"), of(2).alias("share"))
    terms = terms.withColumn("w", F.filter("w", lambda x: F.length(x) >= F.col("least"))).withColumn("n", F.size("w"))
    each = terms.select(*both, "kind", "text", F.explode("w").alias("word")).join(vocabulary, [*scope, "word"]).groupBy(*keys, "kind", "text").agg(F.count("*").alias("shared"))
    judged = terms.join(each, [*keys, "kind", "text"], "left").select(*keys, "kind", "text", ((F.col("n") == 0) | (F.coalesce("shared", F.lit(0)) / F.greatest(F.least("n", "most"), F.lit(1)) >= F.col("share"))).alias("enough"))
    every = own.join(inside, [*scope, "norm"], "left").join(judged, [*keys, "kind", "text"], "left")
    kept = F.coalesce("inside", F.lit(False)) & F.col("kind").isin("concept", "formula") | F.coalesce("enough", F.lit(False)) | (F.col("norm") == "")
    every = every.withColumn("kept", kept)
    # the first missing ones alone are gathered
    order = Window.partitionBy(*keys, "kind").orderBy("text")
    first = every.where("not kept").withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_MISSING).groupBy(*keys, "kind").agg(F.array_sort(F.collect_list("text")).alias("missing"))
    counts = every.groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.count_if("kept").alias("retained"))
    rows = own.select(*keys).distinct().select("*", F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"))
    full = rows.join(counts, [*keys, "kind"], "left").join(first, [*keys, "kind"], "left").na.fill(0, ["n", "retained"])
    percent = F.when(F.col("n") == 0, 100.0).otherwise(F.round(100.0 * F.col("retained") / F.col("n"), 2))
    return full.select(*keys, "kind", "n", "retained", percent.alias("percent"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))
