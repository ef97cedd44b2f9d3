"""Quality gates, audits and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Words of boilerplate, and what a term is.
BOILERPLATE = r"(?i)\b(isbn|copyright|all rights reserved|published by|printed at|reprint|contents|table of contents|answer key)\b"
TERM = "[a-z][a-z0-9_-]{3,}"


def readable(text: Column, least_words: int = 60) -> Column:
    """Text of 60 words or more without boilerplate, of at most a fifth page artefacts and over 45 % letters."""
    found = T.lines(text)
    artefact = F.size(F.filter(found, lambda x: x.rlike(r"^\d{1,4}$") | x.rlike(r"(?i)^(fig|table)\.?\s*\d+")))
    paged = (F.size(found) == 0) | (artefact / F.greatest(F.size(found), F.lit(1)) > 0.2) | text.rlike("[\\x07\\x08�]")
    return (T.word_count(text) >= least_words) & ~T.normalize_text(text).rlike(BOILERPLATE) & ~paged & (T.letter_ratio(text) > 0.45)


def binary_scores(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1 (percent, 100 where nothing is to be found)."""
    n = lambda p, a: F.count_if((predicted == p) & (actual == a))
    out = df.agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), n(False, False).alias("tn"))
    out = out.withColumn("precision_pct", T.percent_or_full(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall_pct", T.percent_or_full(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1_pct", T.percent_or_full(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def gate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `failures`, the names of the rules that do not hold, and `passed`."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("failures", F.array_join(failed, ",")).withColumn("passed", F.col("failures") == "")


def answer_scores(turns: DataFrame) -> DataFrame:
    """turns(question, answer, context, ...) with overlap, completeness, risk and issues of each answer."""
    a, c = F.array_distinct(T.tokens("answer", TERM)), F.array_distinct(T.tokens("context", TERM))
    words = F.size(F.filter(F.split("answer", r"\s+"), lambda x: x != ""))
    overlap = F.when((F.size(a) == 0) | (F.size(c) == 0), 0.0).otherwise(F.size(F.array_intersect(a, c)) / F.greatest(F.size(a), F.lit(1)))
    cue = F.lower("answer").rlike("for example|because|therefore|means|is called")
    complete = F.when(words == 0, 0.0).otherwise(F.least(F.lit(1.0), F.least(F.lit(1.0), words / 80) + F.when(cue, 0.15).otherwise(0.0) + F.when(F.col("question").rlike(r"\?\s*$") & (words >= 25), 0.1).otherwise(0.0)))
    out = turns.withColumns({"_overlap": overlap, "_complete": complete, "_words": words})
    risk = F.when((F.col("_overlap") < 0.03) & (F.col("_words") > 40), "high").when(F.col("_overlap") < 0.08, "medium").otherwise("low")
    issues = F.array_join(F.filter(F.array(F.when(F.col("_overlap") < 0.05, "low_context_overlap"), F.when(F.col("_words") == 0, "empty_answer"), F.when(F.col("_complete") < 0.45, "low_completeness")), lambda x: x.isNotNull()), ",")
    return out.withColumns({"context_overlap": F.round("_overlap", 3), "completeness": F.round("_complete", 3), "hallucination_risk": risk, "issues": issues}).drop("_overlap", "_complete", "_words")


def stage_of_loss(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """df with `lost_at`: the first stage whose test fails, or `survived`."""
    out = F.lit("survived")
    for name, holds in reversed(stages.items()):
        out = F.when(~holds, name).otherwise(out)
    return df.withColumn("lost_at", out)


def validation_errors(df: DataFrame, required: list[str], rules: dict[str, Column]) -> DataFrame:
    """df with `errors`: missing fields and rules broken."""
    missing = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing:{c}")) for c in required]
    broken = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]
    return df.withColumn("errors", F.filter(F.array(*missing, *broken), lambda x: x.isNotNull()))


def error_rates(pairs: DataFrame) -> DataFrame:
    """pairs(reference, hypothesis, ...) with cer and wer."""
    return pairs.withColumns({"cer": T.character_error_rate("reference", "hypothesis"), "wer": T.word_error_rate("reference", "hypothesis")})
