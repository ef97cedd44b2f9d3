"""Scalar text, number and hash functions. Each takes Columns or column names and gives a Column."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOP_WORDS = ("about", "above", "after", "again", "also", "because", "been", "before", "being", "between", "both", "could", "does", "each", "from", "have", "having", "here", "into", "just", "more", "most", "only", "other", "over", "same", "should", "some", "such", "than", "that", "their", "them", "then", "there", "these", "they", "this", "those", "through", "under", "until", "very", "were", "what", "when", "where", "which", "while", "will", "with", "would", "your")
#: Language codes and the names that mean them.
LANGUAGE_NAMES = {"english": "en", "eng": "en", "hindi": "hi", "hin": "hi", "kannada": "kn", "kan": "kn", "tamil": "ta", "telugu": "te", "german": "de", "deutsch": "de", "french": "fr", "spanish": "es"}
#: Subject names and their aliases.
SUBJECT_NAMES = {"math": "mathematics", "maths": "mathematics", "sci": "science", "social": "social_science", "sst": "social_science", "evs": "environmental_studies"}
#: Scripts in the order in which they are tested, by Unicode block.
SCRIPTS = (("kn", "Kannada", r"[\x{0C80}-\x{0CFF}]"), ("hi", "Devanagari", r"[\x{0900}-\x{097F}]"), ("ta", "Tamil", r"[\x{0B80}-\x{0BFF}]"), ("te", "Telugu", r"[\x{0C00}-\x{0C7F}]"))

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Text) -> Column:
    """Without white space at either end."""
    return F.btrim(_c(text), F.lit(" \t\n\x0b\f\r"))


def normalize_text(text: Text) -> Column:
    """Lower case, runs of white space one space, none at the ends; null is empty."""
    return F.regexp_replace(strip(F.lower(F.coalesce(_c(text), F.lit("")))), r"\s+", " ")


def normalize_name(text: Text) -> Column:
    """A curriculum name: lower case, no .pdf, one kind of dash, no trailing ` - N` or separators."""
    t = F.regexp_replace(strip(F.lower(_c(text))), r"\.pdf$", "")
    t = F.regexp_replace(t, "[‐-―]", "-")
    t = F.regexp_replace(t, r"\s*-\s*\d+\s*$", "")
    return F.regexp_replace(F.regexp_replace(t, r"[\s_-]+$", ""), r"\s+", " ")


def word_count(text: Text) -> Column:
    """Runs of ASCII letters and digits."""
    return F.coalesce(F.regexp_count(_c(text), F.lit("[A-Za-z0-9]+")).cast("long"), F.lit(0).cast("long"))


def tokens(text: Text, pattern: str = r"[\p{L}\p{N}_']+") -> Column:
    """All matches of a pattern in the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(pattern), F.lit(0))


def content_terms(text: Text, least: int = 4) -> Column:
    """Distinct words of `least` ASCII letters or digits or more that are no stop words."""
    found = tokens(text, "[a-z0-9]{%d,}" % least)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def sentences(text: Text) -> Column:
    return F.filter(F.split(_c(text), r"(?<=[.!?।])\s+"), lambda s: strip(s) != "")


def lines(text: Text) -> Column:
    """Lines that are not blank, stripped."""
    return F.filter(F.transform(F.split(_c(text), "\n"), strip), lambda s: s != "")


def paragraphs(text: Text) -> Column:
    return F.filter(F.transform(F.split(_c(text), r"\n\s*\n"), strip), lambda s: s != "")


def clean_breaks(text: Text) -> Column:
    """Non-breaking spaces, tabs and control characters one space, words hyphenated over lines joined, at most one empty line."""
    t = F.regexp_replace(F.regexp_replace(_c(text), " |[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", " "), r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(\w)-\n(\w)", "$1$2")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def slug(text: Text, separator: str = "-") -> Column:
    t = F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", separator)
    return F.regexp_replace(t, f"^{separator}+|{separator}+$", "")


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, though `use` has it within a lambda of an array function."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(words: Column, n: int) -> Column:
    """Runs of n items of an array, joined by spaces; none if there are fewer."""
    starts = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return bound(words, lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, n), " ")))


def word_runs(normalized: Text, n: int) -> Column:
    """Runs of n words of a text with single spaces, none if it has fewer: one pass of an expression that looks ahead."""
    run = " ".join([r"\S+"] * n)
    return F.regexp_extract_all(_c(normalized), F.lit(rf"(?<!\S)(?=({run}))\S"), F.lit(1))


def fragments(text: Text, widths: tuple[int, ...] = (3, 2, 1), limit: int = 24) -> Column:
    """Distinct word n-grams, wide ones first, at most `limit`."""
    w = tokens(text, "[a-z0-9]+")
    return F.slice(F.array_distinct(F.concat(*[shingles(w, n) for n in widths])), 1, limit)


def script_language(text: Text) -> Column:
    """struct(language, script) by Unicode block, in the order of SCRIPTS; else English if it has letters."""
    t = _c(text)
    out = F.when(t.rlike("[A-Za-z]"), F.struct(F.lit("en").alias("language"), F.lit("Latin").alias("script"))).otherwise(F.struct(F.lit("unknown").alias("language"), F.lit("unknown").alias("script")))
    for code, name, block in reversed(SCRIPTS):
        out = F.when(t.rlike(block), F.struct(F.lit(code).alias("language"), F.lit(name).alias("script"))).otherwise(out)
    return out


def _alias(text: Text, names: dict[str, str]) -> Column:
    key = normalize_text(text)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in chain(*names.items())]), key), key)


def language_code(text: Text) -> Column:
    return _alias(text, LANGUAGE_NAMES)


def subject_name(text: Text) -> Column:
    """Known aliases, else the name in snake case."""
    return slug(_alias(text, SUBJECT_NAMES), "_")


def grade_of(text: Text) -> Column:
    """The number after `class` or `grade`, else null."""
    return F.regexp_extract(F.lower(_c(text)), r"(?:class|grade)[\s_-]*(\d{1,2})", 1).try_cast("int")


def chapter_title(filename: Text) -> Column:
    t = F.regexp_replace(_c(filename), r"(?i)\.(pdf|txt|md)$", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"(?i)\s*\(part\s*\d+\)\s*$", ""), r"\s*[–-]\s*\d+\s*$", ""))


def character_error_rate(reference: Text, hypothesis: Text) -> Column:
    """Edit distance by the reference's length; 0 for two empty texts, 1 if only the reference is empty."""
    a, b = normalize_text(reference), normalize_text(hypothesis)
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(a, b) / F.length(a))


def word_error_rate(reference: Text, hypothesis: Text) -> Column:
    """As character_error_rate over words: each distinct word of the pair becomes one private character."""
    a, b = tokens(reference, r"\S+"), tokens(hypothesis, r"\S+")
    letter = lambda known, w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xE000), 4, "0")), "UTF-16BE")
    coded = lambda words: bound(F.array_union(a, b), lambda known: F.array_join(F.transform(words, lambda w: letter(known, w)), ""))
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(coded(a), coded(b)) / F.size(a))


def readability(text: Text, places: int = 2) -> Column:
    """0 to 100: sentences near 18 words (65 %) of letters near 5.2 (35 %); 0 without words."""
    found = F.regexp_count(_c(text), F.lit("[A-Za-z0-9]+"))
    letters = F.length(F.regexp_replace(_c(text), "[^A-Za-z0-9]", ""))
    stops = F.greatest(F.lit(1), F.regexp_count(_c(text), F.lit("[.!?]+")))
    sentence = F.greatest(F.lit(0.0), 1 - F.abs(found / stops - 18.0) / 30.0)
    word = F.greatest(F.lit(0.0), 1 - F.abs(letters / found - 5.2) / 5.0)
    return F.when(found > 0, F.round(100 * (0.65 * sentence + 0.35 * word), places)).otherwise(F.lit(0.0))


def letter_ratio(text: Text) -> Column:
    """Share of letters; 0 of an empty text."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(F.length(t), F.lit(1))


def ratio_or_zero(part: Column, total: Column) -> Column:
    """part / total, 0 where total is 0."""
    return part / F.greatest(total, F.lit(1))


def percent_or_full(part: Column, total: Column) -> Column:
    """100 * part / total, 100 where total is 0."""
    return F.when(total == 0, F.lit(100.0)).otherwise(F.round(100.0 * part / total, 2))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def nearest_rank(values: Column, p: float) -> Column:
    """Aggregate: the value at index round-half-even(p * (n - 1)) of the sorted values.

    It holds the group's values, so it is for groups of bounded size; doc_text_profile ranks large ones.
    """
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, (F.rint(F.lit(p) * (F.size(ordered) - 1)) + 1).cast("int"))


def quantize8(vector: Text) -> Column:
    """Components scaled to 0..255 by the vector's least and greatest, cut to integers; a constant vector is 0."""
    v = F.transform(_c(vector), lambda x: x.cast("double"))
    limits = F.struct(F.array_min(v).alias("low"), (F.array_max(v) - F.array_min(v)).alias("span"))
    return bound(limits, lambda s: F.transform(v, lambda x: ((x - s["low"]) / F.when(s["span"] == 0, F.lit(1.0)).otherwise(s["span"]) * 255).cast("int")))


def dot(a: Text, b: Text) -> Column:
    """Inner product; 0 for unequal lengths."""
    product = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(_c(a)) == F.size(_c(b)), product).otherwise(F.lit(0.0))


def hashed_embedding(text: Text, dim: int = 384) -> Column:
    """Token counts in `dim` buckets of xxhash64, of unit length; all zero without tokens."""
    at = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    counts = bound(at, lambda a: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(a, lambda x: x == i)).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda c: bound(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
    return bound(counts, unit)


def content_hash(text: Text) -> Column:
    return F.sha2(normalize_text(text), 256)


def checksum(fields: dict[str, Column]) -> Column:
    """sha256: of the JSON object of the fields in order of name."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256))


def cache_key(query: Text, metadata: Column | None = None) -> Column:
    head = F.concat(F.lit("retrieval:"), F.substring(F.sha2(normalize_text(query), 256), 1, 16))
    return head if metadata is None else F.concat(head, F.lit(":"), F.substring(F.sha2(metadata, 256), 1, 8))


def semver(version: Text) -> Column:
    """struct(major, minor, patch), which compares as versions do; null if it is none."""
    part = lambda i: F.regexp_extract(_c(version), r"^v?(\d+)\.(\d+)\.(\d+)", i).try_cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def difficulty(grade: Column) -> Column:
    return F.when(grade <= 5, "easy").when(grade <= 8, "medium").otherwise("hard")


def failure_class(error: Text) -> Column:
    t = F.lower(_c(error))
    return F.when(t.contains("timeout") | t.contains("timed out"), "TIMEOUT").when(t.contains("not found") | t.contains("404"), "MISSING").when(t.contains("gate"), "QUALITY_GATE").when(t.isNull() | (t == ""), "NONE").otherwise("OTHER")
