"""Catalogs of chapters in books: stable ids, page ranges that are wrong or overlap, repeats, and classes of aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources.scratch import checkpointed

#: The longest range is of fewer than 2 ** LEVELS pages.
LEVELS = 31


def stable_id(grade: Column, subject: Column, title: Column, language: Column) -> Column:
    """chapter_<grade>_<subject>_<title>_<language>, each as a slug; the same for the same chapter in every rebuild."""
    part = lambda c: T.slug(F.coalesce(c.cast("string"), F.lit("")), "_")
    return F.concat_ws("_", F.lit("chapter"), F.coalesce(grade.cast("string"), F.lit("")), part(subject), part(title), part(language))


def range_errors(start: Column, end: Column, pages: Column) -> Column:
    """What is wrong with a range of pages; an unknown number of pages excludes none."""
    tests = {"start_page<1": start < 1, "end_page_before_start_page": end < start, "end_page_exceeds_pdf_pages": end > pages, "no_page_range": start.isNull() | end.isNull()}
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests.items()]), lambda e: e.isNotNull())


def _valid(ranges: DataFrame, keys: list[str]) -> DataFrame:
    return ranges.select(*keys, F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page")).where("start_page <= end_page")


def overlap_counts(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct range of ranges(keys, start_page, end_page) with n, the rows that have it, and n_overlaps, the other rows of its group that it overlaps.

    Both ends belong to a range. Ranges that end before they start, or without an end, are left out; keys must not be null. No pair is made:
    starts and ends are counted by page, and a range overlaps all but those that end before it or start after it.
    """
    own = checkpointed(_valid(ranges, keys).groupBy(*keys, "start_page", "end_page").agg(F.count("*").alias("n")))
    at = own.select(*keys, "n", F.explode(F.array(F.struct(F.col("start_page").alias("page"), F.lit(1).alias("starts")), F.struct(F.col("end_page").alias("page"), F.lit(0).alias("starts")))).alias("p"))
    pages = at.groupBy(*keys, F.col("p.page").alias("page")).agg(F.sum(F.col("n") * F.col("p.starts")).alias("starts"), F.sum(F.col("n") * (1 - F.col("p.starts"))).alias("ends"))
    upto = Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pages = pages.select(*keys, "page", F.sum("starts").over(upto).alias("started"), (F.sum("ends").over(upto) - F.col("ends")).alias("ended"))
    begun = pages.select(*keys, F.col("page").alias("end_page"), "started")
    gone = pages.select(*keys, F.col("page").alias("start_page"), "ended")
    out = own.join(begun, [*keys, "end_page"]).join(gone, [*keys, "start_page"])
    return out.select(*keys, "start_page", "end_page", "n", (F.col("started") - F.col("ended") - 1).alias("n_overlaps"))


def overlapping_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of distinct ranges of a group that overlap: keys, a_start, a_end, b_start, b_end, (a_start, a_end) the smaller.

    A range of 2^l to 2^(l+1)-1 pages stands in the two or three bins of 2^l pages that it touches, and asks in the bins of its own and all
    higher levels that its group has. A pair meets in the bins of the longer one's level and counts in the first that both touch.
    Ranges are as in overlap_counts.
    """
    own = checkpointed(_valid(ranges, keys).distinct().withColumn("level", F.least(F.floor(F.log2(F.col("end_page") - F.col("start_page") + 1) + 1e-12), F.lit(LEVELS)).cast("int")))
    levels = own.select(*keys, F.col("level").alias("at")).distinct()  # LEVELS a group at most
    bins = lambda df, level: df.withColumn("bin", F.explode(F.sequence(F.expr(f"shiftright(start_page, {level})"), F.expr(f"shiftright(end_page, {level})"))))
    held = bins(own.withColumnRenamed("level", "at"), "at").select(*keys, "at", "bin", F.col("start_page").alias("x_start"), F.col("end_page").alias("x_end"))
    asks = bins(own.join(levels, keys).where("at >= level"), "at").select(*keys, "at", "level", "bin", F.col("start_page").alias("y_start"), F.col("end_page").alias("y_end"))
    met = held.join(asks, [*keys, "at", "bin"]).where("x_start <= y_end and y_start <= x_end")
    once = (F.col("level") < F.col("at")) | (F.struct("x_start", "x_end") < F.struct("y_start", "y_end"))
    first = F.expr("bin = shiftright(greatest(x_start, y_start), at)")
    x, y = F.struct(F.col("x_start").alias("s"), F.col("x_end").alias("e")), F.struct(F.col("y_start").alias("s"), F.col("y_end").alias("e"))
    pairs = met.where(once & first).select(*keys, F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return pairs.select(*keys, F.col("a.s").alias("a_start"), F.col("a.e").alias("a_end"), F.col("b.s").alias("b_start"), F.col("b.e").alias("b_end"))


def classes(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected classes of links(src, dst): node, least (the smallest node of its class). Null ends take no part; a link to itself makes a class of one.

    Stars are drawn by turns: every node tells its larger neighbours of its smallest one, then its smaller ones. What a node
    tells is a minimum, so a node with any number of neighbours is one aggregate. Rounds grow with the logarithm of a class's size.
    """
    nodes = links.where("src is not null and dst is not null").select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    pairs = checkpointed(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())

    def mark(p: DataFrame):
        return tuple(p.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = mark(pairs)
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        pairs = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        down = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpointed(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = mark(pairs)
        if now == seen:
            return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("least")), "node", "left").select("node", F.coalesce("least", "node").alias("least"))
        seen = now
    raise RuntimeError(f"classes not found in {max_rounds} rounds")


def alias_classes(names: DataFrame, item: str = "chapter_id", alias: str = "alias") -> DataFrame:
    """Items that share an alias, directly or through others, as classes: item, class_id (its smallest item).

    Aliases are compared trimmed, in small letters and with single white space; items with a null or empty alias alone are classes
    of their own. An alias links its items to its smallest one, so an alias of many items makes no pairs.
    """
    own = names.where(F.col(item).isNotNull()).select(F.col(item).alias("src"), T.normalize_text(alias).alias("alias"))
    heads = own.where("alias <> ''").groupBy("alias").agg(F.min("src").alias("dst"))
    links = own.join(heads, "alias").select("src", "dst").unionByName(own.select("src", F.col("src").alias("dst")))
    return classes(links).select(F.col("node").alias(item), F.col("least").alias("class_id"))


def rebuild(entries: DataFrame) -> DataFrame:
    """The catalog of entries(book_id, grade, subject, title, language, start_page, end_page, page_count), a row for each.

    Adds chapter_id, errors (see range_errors, with missing_pdf where page_count is null), copies (entries of the same grade, subject, language and
    chapter_id; more than one is a repeat) and n_overlaps (other entries of the same book on some of the same pages, null for ranges that are none).
    """
    grade, subject, title, language = (F.col(c) for c in ("grade", "subject", "title", "language"))
    start, end, pages = F.col("start_page").cast("long"), F.col("end_page").cast("long"), F.col("page_count").cast("long")
    missing = F.when(pages.isNull(), F.array(F.lit("missing_pdf"))).otherwise(F.array().cast("array<string>"))
    rows = entries.withColumns({"start_page": start, "end_page": end, "chapter_id": stable_id(grade, subject, title, language)})
    rows = rows.withColumns({"errors": F.concat(missing, range_errors(F.col("start_page"), F.col("end_page"), pages)), "_same": F.xxhash64(grade, T.normalize_text(F.coalesce(subject, F.lit(""))), T.normalize_text(F.coalesce(language, F.lit(""))), "chapter_id")})
    same = rows.groupBy("_same", "chapter_id").agg(F.count("*").alias("copies"))
    met = overlap_counts(rows.where("book_id is not null"), ["book_id"]).drop("n")
    return rows.join(same, ["_same", "chapter_id"]).join(met, ["book_id", "start_page", "end_page"], "left").drop("_same")


def report(catalog: DataFrame) -> DataFrame:
    """One row on a rebuilt catalog: books, chapters, missing, invalid, repeated (distinct chapter ids), overlapping, languages."""
    return catalog.agg(
        F.count_distinct("book_id").alias("books"), F.count("*").alias("chapters"), F.count_if(F.array_contains("errors", "missing_pdf")).alias("missing"),
        F.count_if(F.size(F.array_except("errors", F.array(F.lit("missing_pdf")))) > 0).alias("invalid"), F.count_distinct(F.when(F.col("copies") > 1, F.col("chapter_id"))).alias("repeated"),
        F.count_if(F.col("n_overlaps") > 0).alias("overlapping"), F.count_distinct("language").alias("languages"),
    )
