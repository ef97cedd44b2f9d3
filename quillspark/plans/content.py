"""Registered queries over content types, quality classes and reasons, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import content as K
from quillspark.operators import corpus as C
from quillspark.plans.queries import query, table

_STRIP = r"regexp_replace({},'^\s+|\s+$','','g')"


def _like(pattern: str) -> str:
    return f"len(list_filter(lines, lambda x: regexp_matches(x,'{pattern}')))"


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column},'{pattern}'))"


#: The facts of operators.content in SQL: one row for each document.
FACTS = rf"""a as (select doc_id, source, lang, coalesce(text,'') as text, {_STRIP.format("coalesce(text,'')")} as t from documents),
b as (select *, regexp_replace({_STRIP.format('lower(text)')},'\s+',' ','g') as norm, {_count('text', '[A-Za-z0-9]+')} as words,
 list_filter(list_transform(string_split(text,chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x<>'') as lines from a),
f as (select *, len(lines) as n, {_like(K.PAGE_LIKE)} as page_like, {_like(K.PAGE_LISTING)} as page_listing, {_like('[0-9]')} as numeric_lines,
 len(list_filter(lines, lambda x: length(x)<=28)) as short28, len(list_filter(lines, lambda x: length(x)<=34)) as short34,
 {_like('(?i)' + K.CHAPTER_LISTING)} as listed, {_like('(?i)' + K.CHAPTER_LINE)} as chapter_lines,
 len(list_filter(lines, lambda x: length(x)<=80 and regexp_matches(lower(x),'{K.word(K.NAVIGATION_WORDS)}'))) as short_nav,
 length(regexp_replace(t,'{K.UNPRINTABLE}','','g')) as printable, {_count('t', K.PLAIN)} as plain, {_count('t', K.SYMBOLS)} as symbols,
 row_number() over (partition by norm order by doc_id)>1 and norm<>'' as again from b)"""


def _noise(least: int, share: float) -> str:
    return f"(contains(t,chr(8)) or contains(t,chr(65533)) or regexp_matches(t,'{K.SPACED_LETTERS}') or (length(t)>={least} and (printable-plain)/greatest(printable,1)>{share}))"


def _formula(longest: int, most: int) -> str:
    return f"(length(t)<={longest} and symbols>=2 and words<={most})"


def _table(short: str, a: float, b: float) -> str:
    return f"(n>=4 and {short}/n>{a} and numeric_lines/n>{b})"


def _says(words: str, column: str = "norm") -> str:
    return f"regexp_matches({column},'{K.word(words)}')"


_TOC = f"(({_says(K.TOC_WORDS)} and (page_like>=2 or n<=30)) or (n>=4 and page_listing/n>0.35))"
_IMPRINT = f"(t='' or regexp_matches(lower(t),'{K.RUNNING_HEAD}') or {_says(K.SERIES_WORDS, 'lower(t)')} or {_says(K.IMPRINT_WORDS, 'lower(t)')})"
_NOISE, _FORMULA, _TABLE = _noise(30, 0.45), _formula(260, 22), _table("short34", 0.58, 0.25)
_TYPE = rf"""case when {_TOC} then 'table_of_contents' when {_IMPRINT} or {_NOISE} then 'metadata' when {_says(K.GLOSSARY_WORDS)} then 'glossary' when {_says(K.SUMMARY_WORDS)} then 'summary' when {_says(K.ACTIVITY_WORDS)} then 'activity'
 when {_says(K.EXERCISE_WORDS)} or {_count('text', r'\?')}>=2 or ({_count('text', r'\?')}>=1 and regexp_matches(text,'{K.NUMBERED}')) then 'exercise' when {_says(K.ASSESSMENT_WORDS)} then 'assessment'
 when {_says(K.EXAMPLE_WORDS)} and {_says(K.SOLUTION_WORDS)} then 'worked_example' when {_says(K.EXAMPLE_WORDS)} then 'example' when {_TABLE} then 'table' when {_FORMULA} or words<40 then 'metadata' else 'concept' end"""
_REASON = f"""case when text='' then 'empty' when content_type='table_of_contents' then 'table_of_contents' when content_type='metadata' then case when {_NOISE} then 'ocr_noise' when {_IMPRINT} then 'header_footer' when {_FORMULA} then 'formula_only' when {_TABLE} then 'table_fragment' else 'metadata' end
 when content_type not in ('exercise','assessment','table') and words<40 then 'short_fragment' end"""
_QUALITY = f"""case when norm='' then 'EMPTY' when again then 'DUPLICATE' when {_TOC} then 'TABLE_OF_CONTENTS' when {_IMPRINT} then 'HEADER_FOOTER' when {_NOISE} then 'OCR_NOISE' when {_FORMULA} then 'FORMULA_ONLY' when {_TABLE} then 'TABLE_FRAGMENT' when words<100 then 'SHORT_FRAGMENT' else 'GOOD' end"""


def _facts(spark, d):
    return K.facts(table(spark, d, "documents").select("doc_id", "source", "lang", "text"))


@query(f"with {FACTS}, k as (select *, {_TYPE} as content_type from f) select doc_id, content_type, {_REASON} as reason from k")
def content_types(spark, d):
    """The content type of each document and why cleaning would leave it out."""
    return _facts(spark, d).withColumn("content_type", K.content_type()).select("doc_id", "content_type", K.removal_reason().alias("reason"))


@query(f"""with {FACTS}, k as (select *, {_TYPE} as content_type from f), r as (select *, {_REASON} as reason from k)
select source, content_type, coalesce(reason,'kept') as outcome, count(*) as chunks, cast(sum(words) as bigint) as words from r group by 1,2,3""")
def cleaning_report(spark, d):
    """Chunks and words of each source by content type and outcome of cleaning."""
    typed = _facts(spark, d).withColumn("content_type", K.content_type())
    return typed.groupBy("source", "content_type", F.coalesce(K.removal_reason(), F.lit("kept")).alias("outcome")).agg(F.count("*").alias("chunks"), F.sum("words").alias("words"))


@query(f"with {FACTS} select doc_id, {_QUALITY} as quality_class from f")
def quality_classes(spark, d):
    """The quality class of each document; later copies of a text are DUPLICATE."""
    return K.with_first(_facts(spark, d), "doc_id", K.quality_class, "quality_class").select("doc_id", "quality_class")


@query(rf"""with {FACTS} select doc_id, case when norm='' then 'EMPTY' when again then 'DUPLICATE' when regexp_matches(t,'{C.PAGE_NUMBER}') or regexp_matches(t,'{C.HEADER}') or regexp_matches(text,'{C.IMPRINT}') then 'HEADER_FOOTER' when {_noise(21, 0.42)} then 'OCR_NOISE' when {_formula(220, 18)} then 'FORMULA_ONLY'
 when {_table('short28', 0.62, 0.30)} then 'TABLE_FRAGMENT' when words<100 then 'SHORT_FRAGMENT' else 'GOOD' end as extraction_class from f""")
def extraction_classes(spark, d):
    """The extraction class of each document."""
    return K.with_first(_facts(spark, d), "doc_id", K.extraction_class, "extraction_class").select("doc_id", "extraction_class")


@query(rf"""with {FACTS} select doc_id, case when n=0 then 'empty_navigation' when {_says('contents?|table of contents|index|chapter index|answer key|answers', 'lower(text)')} and (listed>=1 or n<=45) then 'toc_heading' when n>=3 and listed/n>=0.25 then 'page_listing'
 when n>=5 and (listed+chapter_lines+short_nav)/n>=0.5 then 'navigation_listing' when regexp_matches(norm,'{K.SECTION_ON_PAGE}') and words<120 then 'section_page_listing' end as reason from f""")
def navigation_pages(spark, d):
    """Documents that are pages of navigation, with the reason; null for others."""
    return _facts(spark, d).select("doc_id", K.navigation_reason().alias("reason"))


@query(f"""with {FACTS}, q as (select *, {_QUALITY} as c from f)
select source, count(*) as chunks, count(*) filter (c='GOOD') as good, round(greatest(0,least(100,70*count(*) filter (c='GOOD')/count(*)+15*least(avg(words)/220,1)-18*count(*) filter (c='DUPLICATE')/count(*)-10*count(*) filter (c='SHORT_FRAGMENT')/count(*)
-22*count(*) filter (c in ('OCR_NOISE','FORMULA_ONLY','TABLE_FRAGMENT'))/count(*)-12*count(*) filter (c in ('TABLE_OF_CONTENTS','HEADER_FOOTER'))/count(*))),4) as score,
 count(*) filter (c not in ('EMPTY','DUPLICATE','TABLE_OF_CONTENTS','HEADER_FOOTER','OCR_NOISE')) as after_cleaning from q group by 1""")
def pack_quality_projection(spark, d):
    """The second quality score of each source and the chunks that cleaning would leave."""
    c = K.with_first(_facts(spark, d), "doc_id", K.quality_class, "c").select("source", "words", "c")
    n, of = F.count("*"), lambda *names: F.count_if(F.col("c").isin(*names))
    score = 70 * of("GOOD") / n + 15 * F.least(F.avg("words") / 220, F.lit(1.0)) - 18 * of("DUPLICATE") / n - 10 * of("SHORT_FRAGMENT") / n - 22 * of("OCR_NOISE", "FORMULA_ONLY", "TABLE_FRAGMENT") / n - 12 * of("TABLE_OF_CONTENTS", "HEADER_FOOTER") / n
    cleaned = n - of("EMPTY", "DUPLICATE", "TABLE_OF_CONTENTS", "HEADER_FOOTER", "OCR_NOISE")
    return c.groupBy("source").agg(n.alias("chunks"), of("GOOD").alias("good"), F.round(T.clamp(score, 0.0, 100.0), 4).alias("score"), cleaned.alias("after_cleaning"))


@query(f"""with {FACTS}, q as (select *, {_QUALITY} as c from f)
select lang, count(*) as pages, cast(sum(words) as bigint) as words, round(avg(words),6) as mean_words, count(*) filter (words<100) as short_pages, round(count(*) filter (again)/count(*),6) as duplicate_ratio,
 round(count(*) filter (c='OCR_NOISE')/count(*),6) as noise_ratio, cast(ceil(sum(case when c in ('GOOD','SHORT_FRAGMENT') then words else 0 end)/400) as bigint) as repaired_chunks from q group by 1""")
def extraction_audit(spark, d):
    """Pages, words, ratios and the chunks that a repair would make, by language."""
    c = K.with_first(_facts(spark, d), "doc_id", K.quality_class, "c").select("lang", "words", "again", "c")
    n, useful = F.count("*"), F.when(F.col("c").isin("GOOD", "SHORT_FRAGMENT"), F.col("words")).otherwise(0)
    return c.groupBy("lang").agg(n.alias("pages"), F.sum("words").alias("words"), F.round(F.avg("words"), 6).alias("mean_words"), F.count_if(F.col("words") < 100).alias("short_pages"), F.round(F.count_if("again") / n, 6).alias("duplicate_ratio"),
        F.round(F.count_if(F.col("c") == "OCR_NOISE") / n, 6).alias("noise_ratio"), F.ceil(F.sum(useful) / 400).cast("long").alias("repaired_chunks"))


@query(f"""with {FACTS}, q as (select *, {_QUALITY} as c from f), m as (select case when c in ('EMPTY','SHORT_FRAGMENT') then 'extraction' when c in ('OCR_NOISE','TABLE_FRAGMENT','FORMULA_ONLY') then 'parsing' when c='DUPLICATE' then 'deduplication' when c in ('TABLE_OF_CONTENTS','HEADER_FOOTER') then 'cleanup' else 'none' end as cause from q)
select cause, count(*) as chunks, round(100*count(*)/sum(count(*)) over (),6) as percent, row_number() over (order by count(*) desc, cause) as place from m group by 1""")
def root_causes(spark, d):
    """Causes of unusable chunks with their percentage, the commonest first."""
    c = K.with_first(_facts(spark, d), "doc_id", K.quality_class, "c").select("c")
    of = lambda *names: F.col("c").isin(*names)
    cause = K.first_of([("extraction", of("EMPTY", "SHORT_FRAGMENT")), ("parsing", of("OCR_NOISE", "TABLE_FRAGMENT", "FORMULA_ONLY")), ("deduplication", of("DUPLICATE")), ("cleanup", of("TABLE_OF_CONTENTS", "HEADER_FOOTER"))], "none")
    g = c.groupBy(cause.alias("cause")).agg(F.count("*").alias("chunks"))  # five rows at most
    return g.select("cause", "chunks", F.round(100 * F.col("chunks") / F.sum("chunks").over(Window.partitionBy()), 6).alias("percent"), F.row_number().over(Window.orderBy(F.desc("chunks"), "cause")).cast("long").alias("place"))


def _case(pairs, column: str) -> str:
    return "case " + " ".join(f"when regexp_matches({column},'{p}') then '{n}'" for n, p in pairs) + " end"


@query(rf"""with p as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text,'\n\s*\n'), lambda x: {_STRIP.format('x')}), lambda x: x<>'')) as p from documents where text is not null),
l as (select doc_id, p, list_filter(list_transform(string_split(p,chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x<>'') as lines from p)
select coalesce({_case(K.BOUNDARIES, 'lower(p)')},'none') as label, len(list_filter(lines, lambda x: regexp_matches(x,'{K.FORMULA_LINE}')))>=greatest(1,len(lines)//2) as formula, count(*) as paragraphs, cast(sum(length(p)) as bigint) as chars from l group by 1,2""")
def paragraph_labels(spark, d):
    """Paragraphs by the kind of block that they open and whether they are formula blocks."""
    p = table(spark, d, "documents").where("text is not null").select(F.explode(T.paragraphs("text")).alias("p"))
    return p.groupBy(F.coalesce(K.boundary_label(F.col("p")), F.lit("none")).alias("label"), K.is_formula_block(F.col("p")).alias("formula")).agg(F.count("*").alias("paragraphs"), F.sum(F.length("p")).cast("long").alias("chars"))
