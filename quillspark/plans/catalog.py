"""Registered queries over a catalog of chapters, with their SQL: items are chapters of the part's book."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import catalog as C
from quillspark.plans.queries import query, table

_ENTRIES = """e as (select l_partkey as book_id, p_size as grade, p_brand as subject, 'chapter '||l_linenumber||' '||p_name as title, p_type as language, cast(l_quantity as bigint)-2 as start_page,
 cast(l_quantity as bigint)-2+3*l_linenumber-4 as end_page, case when p_size=7 then null else 45 end as page_count from lineitem join part on l_partkey=p_partkey)"""
_SLUG = "trim(regexp_replace(lower({}),'[^a-z0-9]+','_','g'),'_')"
_CATALOG = f"""{_ENTRIES}, i as (select *, row_number() over () as no, 'chapter_'||grade||'_'||{_SLUG.format('subject')}||'_'||{_SLUG.format('title')}||'_'||{_SLUG.format('language')} as chapter_id from e),
b as (select book_id, start_page, end_page, count(*) as n from e where start_page<=end_page group by all),
o as (select x.book_id, x.start_page, x.end_page, cast(sum(y.n)-1 as bigint) as n_overlaps from b x join b y on x.book_id=y.book_id and x.start_page<=y.end_page and y.start_page<=x.end_page group by all),
c as (select i.book_id, i.chapter_id, i.language, i.start_page, i.end_page, array_to_string(list_filter([case when page_count is null then 'missing_pdf' end, case when i.start_page<1 then 'start_page<1' end, case when i.end_page<i.start_page then 'end_page_before_start_page' end, case when i.end_page>page_count then 'end_page_exceeds_pdf_pages' end], lambda x: x is not null),',') as errors,
 count(*) over (partition by chapter_id) as copies, n_overlaps from i left join o on o.book_id=i.book_id and o.start_page=i.start_page and o.end_page=i.end_page)"""


def _entries(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("grade"), F.col("p_brand").alias("subject"), "p_name", F.col("p_type").alias("language"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("book_id"), "l_linenumber", F.col("l_quantity").cast("long").alias("q")).join(part, F.col("book_id") == F.col("p_partkey"))
    start = F.col("q") - 2
    return rows.select("book_id", "grade", "subject", F.concat(F.lit("chapter "), "l_linenumber", F.lit(" "), "p_name").alias("title"), "language", start.alias("start_page"), (start + 3 * F.col("l_linenumber") - 4).alias("end_page"), F.when(F.col("grade") != 7, 45).alias("page_count"))


@query(f"with {_CATALOG} select * from c")
def catalog_rebuild(spark, sf_dir):
    """Every chapter with its stable id, what is wrong with its pages, its repeats and overlaps."""
    out = C.rebuild(_entries(spark, sf_dir))
    return out.select("book_id", "chapter_id", "language", "start_page", "end_page", F.array_join("errors", ",").alias("errors"), "copies", "n_overlaps")


@query(f"with {_CATALOG} select count(distinct book_id) as books, count(*) as chapters, count(*) filter (contains(errors,'missing_pdf')) as missing, count(*) filter (replace(errors,'missing_pdf','')<>'') as invalid, count(distinct case when copies>1 then chapter_id end) as repeated, count(*) filter (n_overlaps>0) as overlapping, count(distinct language) as languages from c")
def catalog_report(spark, sf_dir):
    """The figures of the rebuilt catalog."""
    return C.report(C.rebuild(_entries(spark, sf_dir)))


@query(f"""with {_ENTRIES}, b as (select distinct book_id, start_page, end_page from e where start_page<=end_page)
select x.book_id, x.start_page as a_start, x.end_page as a_end, y.start_page as b_start, y.end_page as b_end from b x join b y on x.book_id=y.book_id and (x.start_page,x.end_page)<(y.start_page,y.end_page) and x.start_page<=y.end_page and y.start_page<=x.end_page""")
def overlapping_chapters(spark, sf_dir):
    """Pairs of distinct page ranges of a book that overlap."""
    return C.overlapping_ranges(_entries(spark, sf_dir), ["book_id"])


@query("""with recursive n as (select p_partkey as k, p_name||' '||p_size as alias from part union all select p_partkey, p_brand||' '||p_type||' '||p_size from part),
l as (select distinct a.k as x, b.k as y from n a join n b using (alias)), r as (select x, y from l union select r.x, l.y from r join l on r.y=l.x)
select x as p_partkey, min(y) as class_id from r group by 1""")
def alias_closure(spark, sf_dir):
    """Parts that share a name and size, or a brand, type and size, directly or through others."""
    part = table(spark, sf_dir, "part")
    both = F.array(F.concat_ws(" ", "p_name", "p_size"), F.concat_ws(" ", "p_brand", "p_type", "p_size"))
    return C.alias_classes(part.select("p_partkey", F.explode(both).alias("alias")), "p_partkey")
