"""Types, quality classes and removal reasons of texts: ordered rules over their words and lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import corpus as C

# Words and line forms that the rules look for.
TOC_WORDS = "contents|table of contents|index|answers|answer key"
IMPRINT_WORDS = "isbn|copyright|all rights reserved|published by|printed at|reprint|ncert|national council of educational research|publisher|edition"
SERIES_WORDS = r"ganita prakash|curiosity|exploring society|textbook of science|grade\s+\d+\s*\|\s*part"
GLOSSARY_WORDS = "glossary|key terms|terms to know"
SUMMARY_WORDS = "summary|recap|in brief|points to remember|what you have learnt"
ACTIVITY_WORDS = "activity|try this|do this|project work|observe and record"
EXERCISE_WORDS = "exercise|questions?|problems?|multiple choice|choose the correct|fill in the blanks"
ASSESSMENT_WORDS = "test|assessment|worksheet|exam|marks"
EXAMPLE_WORDS = "example|for example|illustration"
SOLUTION_WORDS = "solution|solved|steps?|therefore|hence"
NAVIGATION_WORDS = "chapter|unit|lesson|section|page"
RUNNING_HEAD = r"^(?:(page\s*)?\d{1,4}|(chapter|unit|lesson)\s+\d+(\s*[:.-].*)?|mathematics|maths|science|social science|(class|grade)\s+\d+)$"
PAGE_LIKE = r"\.{2,}\s*\d+$|(^|[^\pL\pN_])\d{1,3}$"
PAGE_LISTING = r"\.{2,}\s*\d+$|^\d+(\.\d+)*\s+.+\s+\d+$"
CHAPTER_LISTING = r"^(?:chapter|unit|lesson|section)?\s*\d+(?:\.\d+)*\s+.{2,90}(?:\.{2,}|\s{2,})\s*\d{1,4}$|\.{2,}\s*\d{1,4}$"
CHAPTER_LINE = r"^(?:chapter|unit|lesson|section)\s+\d+(?:\.\d+)*$"
SECTION_ON_PAGE = r"(^|[^\pL\pN_])(chapter|section)\s+\d+(?:\.\d+)*($|[^\pL\pN_]).{0,80}page\s+\d+"
NUMBERED = r"(^|\n)\s*\d{1,2}\s*[.)]\s+"
SPACED_LETTERS = r"(?:[A-Za-z]\s){5,}[A-Za-z]"
SYMBOLS = r"[=+\-×÷*/^√∠∆π≤≥<>°]"
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
PLAIN = r"[\p{L}\p{N}\s]"
BOUNDARIES = (
    ("definition", r"^definition\s*[:\-]|^what is\s|(^|[^\pL\pN_])defined as($|[^\pL\pN_])"),
    ("experiment", r"^(experiment|activity|procedure)\s*[:\-]"),
    ("example", r"^example\s*[:\-]|^for example($|[^\pL\pN_])"),
    ("qa", r"^(q\.|question|a\.|answer)\s*[:\-]"),
)
FORMULA_LINE = r"[=+\-*/^]"


def word(words: str) -> str:
    """A pattern for whole words, in the syntax that Java's and RE2's expressions share."""
    return rf"(^|[^\pL\pN_])({words})($|[^\pL\pN_])"


def first_of(rules: list[tuple[str, Column]], otherwise: str | None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def facts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with what the rules look at: t, norm, words, lines, n (lines) and counts of kinds of lines. Null text is empty.

    Each is computed once for a row; all stays in the row's own task, without a shuffle.
    """
    out = df.withColumn(text, F.coalesce(text, F.lit("")))
    out = out.withColumns({"t": T.strip(text), "norm": T.normalize_text(text), "words": T.word_count(text), "lines": T.lines(text)})
    of = lambda test: F.size(F.filter("lines", test))
    like = lambda pattern: of(lambda x: x.rlike(pattern))
    out = out.withColumns({
        "n": F.size("lines"), "page_like": like(PAGE_LIKE), "page_listing": like(PAGE_LISTING), "numeric": like("[0-9]"),
        "short28": of(lambda x: F.length(x) <= 28), "short34": of(lambda x: F.length(x) <= 34),
        "listed": like("(?i)" + CHAPTER_LISTING), "chapter_lines": like("(?i)" + CHAPTER_LINE),
        "short_nav": of(lambda x: (F.length(x) <= 80) & F.lower(x).rlike(word(NAVIGATION_WORDS))),
        "printable": F.length(F.regexp_replace("t", UNPRINTABLE + "+", "")), "plain": F.length("t") - F.length(F.regexp_replace("t", PLAIN + "+", "")),
        "symbols": F.regexp_count("t", F.lit(SYMBOLS)),
    })
    return out


def _share(part: str, limit: float) -> Column:
    return F.col(part) / F.greatest("n", F.lit(1)) > limit


def is_toc() -> Column:
    titled = F.col("norm").rlike(word(TOC_WORDS)) & ((F.col("page_like") >= 2) | (F.col("n") <= 30))
    return titled | ((F.col("n") >= 4) & _share("page_listing", 0.35))


def is_imprint() -> Column:
    low = F.lower("t")
    return (low == "") | low.rlike(RUNNING_HEAD) | low.rlike(word(SERIES_WORDS)) | low.rlike(word(IMPRINT_WORDS))


def is_noise(least: int = 30, share: float = 0.45) -> Column:
    symbols = (F.col("printable") - F.col("plain")) / F.greatest("printable", F.lit(1))
    return F.col("t").rlike("[\x08�]") | F.col("t").rlike(SPACED_LETTERS) | ((F.length("t") >= least) & (symbols > share))


def is_formula(longest: int = 260, most_words: int = 22) -> Column:
    return (F.length("t") <= longest) & (F.col("symbols") >= 2) & (F.col("words") <= most_words)


def is_table(short: str = "short34", short_share: float = 0.58, numeric_share: float = 0.25) -> Column:
    return (F.col("n") >= 4) & _share(short, short_share) & _share("numeric", numeric_share)


def content_type() -> Column:
    """One of eleven types, over facts()."""
    says = lambda words: F.col("norm").rlike(word(words))
    asks = F.regexp_count("text", F.lit(r"\?"))
    rules = [
        ("table_of_contents", is_toc()), ("metadata", is_imprint() | is_noise()), ("glossary", says(GLOSSARY_WORDS)), ("summary", says(SUMMARY_WORDS)),
        ("activity", says(ACTIVITY_WORDS)), ("exercise", says(EXERCISE_WORDS) | (asks >= 2) | ((asks >= 1) & F.col("text").rlike(NUMBERED))),
        ("assessment", says(ASSESSMENT_WORDS)), ("worked_example", says(EXAMPLE_WORDS) & says(SOLUTION_WORDS)), ("example", says(EXAMPLE_WORDS)),
        ("table", is_table()), ("metadata", is_formula() | (F.col("words") < 40)),
    ]
    return first_of(rules, "concept")


def removal_reason(kind: str = "content_type") -> Column:
    """Why a text of this type is left out, null if it stays; over facts()."""
    metadata = first_of([("ocr_noise", is_noise()), ("header_footer", is_imprint()), ("formula_only", is_formula()), ("table_fragment", is_table())], "metadata")
    untouched = F.col(kind).isin("exercise", "assessment", "table")
    return F.when(F.col("text") == "", "empty").when(F.col(kind) == "table_of_contents", "table_of_contents").when(F.col(kind) == "metadata", metadata).when(~untouched & (F.col("words") < 40), "short_fragment")


def navigation_reason() -> Column:
    """Why a page is a page of navigation, null if it is none; over facts()."""
    low, n = F.lower("text"), F.greatest("n", F.lit(1))
    headed = low.rlike(word("contents?|table of contents|index|chapter index|answer key|answers")) & ((F.col("listed") >= 1) | (F.col("n") <= 45))
    return first_of([
        ("empty_navigation", F.col("n") == 0), ("toc_heading", headed), ("page_listing", (F.col("n") >= 3) & (F.col("listed") / n >= 0.25)),
        ("navigation_listing", (F.col("n") >= 5) & ((F.col("listed") + F.col("chapter_lines") + F.col("short_nav")) / n >= 0.5)),
        ("section_page_listing", F.col("norm").rlike(SECTION_ON_PAGE) & (F.col("words") < 120)),
    ], None)


def with_first(df: DataFrame, place: str, rule: Callable[[], Column], name: str) -> DataFrame:
    """df over facts() with `name`: the class that rule gives, which may ask for `again`, whether an equal normalised text stands at a smaller place. `again` stays too.

    The rule is evaluated beside the text for both answers, so the text never leaves its task: a hash and the place
    alone are shuffled, and what comes back for each place that is not the first of its hash is one flag. Empty texts,
    of which there may be many, are never again and take no part.
    """
    both = df.withColumn("again", F.lit(False)).withColumn("_once", rule()).withColumn("again", F.lit(True)).withColumn("_again", rule()).drop("again")
    hashed = df.where("norm <> ''").select(F.xxhash64("norm").alias("_h1"), F.sha2("norm", 256).alias("_h2"), F.col(place).alias("_place"))
    first = hashed.groupBy("_h1", "_h2").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = hashed.join(first, ["_h1", "_h2"]).where("_place <> _first").select("_place").distinct().withColumn("_later", F.lit(True))
    joined = both.join(later, F.col(place).eqNullSafe(F.col("_place")), "left").withColumn("again", F.coalesce("_later", F.lit(False)))
    return joined.withColumn(name, F.when(F.col("again"), F.col("_again")).otherwise(F.col("_once"))).drop("_place", "_later", "_once", "_again")


def quality_class() -> Column:
    """One of nine classes, for with_first over facts()."""
    return first_of([
        ("EMPTY", F.col("norm") == ""), ("DUPLICATE", F.col("again")), ("TABLE_OF_CONTENTS", is_toc()), ("HEADER_FOOTER", is_imprint()), ("OCR_NOISE", is_noise()),
        ("FORMULA_ONLY", is_formula()), ("TABLE_FRAGMENT", is_table()), ("SHORT_FRAGMENT", F.col("words") < 100),
    ], "GOOD")


def extraction_class() -> Column:
    """One of eight classes of extracted text, for with_first over facts()."""
    headed = C.is_page_number(F.col("t")) | C.is_header_footer(F.col("t")) | F.col("text").rlike(C.IMPRINT)
    return first_of([
        ("EMPTY", F.col("norm") == ""), ("DUPLICATE", F.col("again")), ("HEADER_FOOTER", headed), ("OCR_NOISE", is_noise(21, 0.42)),
        ("FORMULA_ONLY", is_formula(220, 18)), ("TABLE_FRAGMENT", is_table("short28", 0.62, 0.30)), ("SHORT_FRAGMENT", F.col("words") < 100),
    ], "GOOD")


def boundary_label(text: Column) -> Column:
    """What kind of block a paragraph opens, null if none."""
    low = F.lower(T.strip(text))
    return first_of([(name, low.rlike(pattern)) for name, pattern in BOUNDARIES], None)


def is_formula_block(text: Column) -> Column:
    """Whether half of a paragraph's lines, or one, hold a formula."""
    found = T.lines(text)
    return (F.size(found) > 0) & (F.size(F.filter(found, lambda x: x.rlike(FORMULA_LINE))) >= F.greatest(F.lit(1), F.floor(F.size(found) / 2)))
