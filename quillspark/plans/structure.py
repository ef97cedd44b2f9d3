"""Registered queries over chapters and chunks, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import knowledge
from quillspark.operators import structure as S
from quillspark.plans.queries import query, table

_STRIP = r"regexp_replace({},'^\s+|\s+$','','g')"
_TOPICS = rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower({{}}),'{S.NUMBERED}',''),'[;,/\-]'), lambda x: {_STRIP.format('x')}), lambda x: length(x)>3)"


def _titled(words: int) -> str:
    return rf"(len(regexp_split_to_array(line,'\s+'))<={words} and regexp_matches(line,'^\p{{Lu}}') and ends_with(line,':'))"


@query(rf"""with l as (select doc_id, length(text) as n, unnest(string_split(text,chr(10))) as raw, unnest(range(len(string_split(text,chr(10))))) as no from documents where text is not null),
m as (select *, {_STRIP.format('raw')} as line, sum(length(raw)+1) over (partition by doc_id order by no)-length(raw)-1 as start from l),
v as (select *, case when line='' then null when regexp_matches(lower(line),'{S.CHAPTER_LINE}') or {_titled(8)} then 0 when regexp_matches(lower(line),'{S.SECTION_LINE}') or {_titled(10)} then 1 end as level from m),
c as (select *, sum(case when level=0 then 1 else 0 end) over (partition by doc_id order by no)-1 as chapter_no from v),
g as (select doc_id, chapter_no, any_value(n) as n, max(case when level=0 then line end) as title, min(start) as start, list({{'s': start, 't': line}} order by start) filter (level=1) as sub from c where level is not null and chapter_no>=0 group by 1,2),
e as (select *, coalesce(lead(start) over (partition by doc_id order by chapter_no), n+1) as stop from g)
select doc_id, cast(chapter_no as bigint) as chapter_no, title, cast(start as bigint) as start, cast(stop as bigint) as "end", array_to_string({_TOPICS.format('title')},'|') as topics, coalesce(array_to_string(list_transform(sub, lambda i: cast(cast(i.s as bigint) as varchar)||':'||i.t),'|'),'') as sections from e
union all select doc_id, 0, 'Document', 0, length(text), array_to_string({_TOPICS.format('substr(text,1,120)')},'|'), '' from documents where text is not null and doc_id not in (select doc_id from g)""")
def chapter_tree(spark, sf_dir):
    """Chapters of every document with character offsets and nested sections, arrays as strings."""
    shown = F.transform("sections", lambda s: F.concat_ws(":", s["start"].cast("string"), s["title"]))
    return S.chapters(table(spark, sf_dir, "documents")).withColumns({"topics": F.array_join("topics", "|"), "sections": F.array_join(shown, "|")})


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines("text")).alias("line_no", "text"))


@query()
def repaired_chunks(spark, sf_dir):
    """Paragraphs of documents cleaned, merged within their document and held to the class GOOD. Filters of lines and regular expressions with look-behind make SQL unwieldy; tests hold it against a loop."""
    paragraphs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.paragraphs("text")).alias("paragraph_no", "text"))
    return S.repaired(paragraphs, ["doc_id"], "paragraph_no")


@query()
def even_chunks(spark, sf_dir):
    """Lines of documents as chunks of 200 to 400 words. Folds to a fixed point; tests hold it against cases and what must hold for any chunks."""
    lines = _lines(spark, sf_dir).withColumns({"kind": knowledge.first_class(F.col("text")), "topic": F.lit(None).cast("string"), "context": F.lit(None).cast("array<string>")})
    return S.even_chunks(lines, ["doc_id"], "line_no")
