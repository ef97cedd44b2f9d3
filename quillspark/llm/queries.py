"""The queries of this subpackage, each over the whole of its table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import arc_convert, cross_tokenizer, decontaminate, fair_mix, html_blocks, langid, line_dedup, near_dup, periodic_runs, personal_data, rabitq, separator_scan, toxicity
from quillspark.llm.common import drop_scratch, materialize, scratch_path, table


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rabitq.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch_path(spark, "tokens")
    separator_scan.write_token_files(table(spark, sf_dir, "documents"), at)
    out = materialize(separator_scan.with_ids(separator_scan.scan(spark, at, head=separator_scan.ID_TOKENS)).select("doc_id", "n_tokens"), "token-counts")
    drop_scratch(spark, at)
    return out


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch_path(spark, "archives")
    arc_convert.write_arc(table(spark, sf_dir, "pages"), f"{at}/arc")
    arc_convert.arc_to_warc(spark, f"{at}/arc", f"{at}/warc")
    out = materialize(arc_convert.read_warc(spark, f"{at}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-rows")
    drop_scratch(spark, at)
    return out


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, repeats=2)


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(personal_data.find(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.find(periodic_runs.with_planted_periods(table(spark, sf_dir, "documents")), min_exponent=4, min_length=6))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_blocks, op2_langid, op3_rabitq, op4_separator_scan, op5_line_dedup, op6_toxicity, op7_decontaminate, op8_arc_to_warc, op9_fair_mix, op10_near_dup, op11_personal_data, op12_periodic_runs, op13_cross_tokenizer)}

#: The others learn a model, search approximately, tokenise, search for runs or offsets, or depend on a hash that SQL doesn't have; tests
#: hold them against brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op8_arc_to_warc": """with p as (select page_id, cast(strlen(coalesce(html,'')) as bigint) as payload_bytes, sha1(coalesce(html,'')) as payload_digest from pages),
w as (select *, max(page_id) over (partition by payload_digest) as top from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes>=1000 and page_id<top then 'revisit' else 'response' end as record_type,
 case when payload_bytes>=1000 and page_id<top then top end as refers_to from w""",
    "op9_fair_mix": r"""with s as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+')) as bigint) as size from documents),
p as (select *, cast('0x'||substr(md5(concat_ws(':',cast(doc_id as varchar),cast(size as varchar),'17')),1,15) as bigint) as place from s),
b as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as source_no from s group by 1),
c as (select *, cast([5,2,1][(source_no-1)%3+1] as double) as weight, 2*cast(source_size as double) as cap, cast(sum(source_size) over () as double)*cast(1.5 as double) as budget from b),
l as (select *, (budget-coalesce(sum(cap) over (order by cap/weight, source_no rows between unbounded preceding and 1 preceding),0))/sum(weight) over (order by cap/weight, source_no rows between current row and unbounded following) as level,
 row_number() over (order by cap/weight, source_no) as i from c),
t as (select source, source_size, coalesce(least(cap, weight*(select min_by(level, i) from l where level<=cap/weight)), cap) as target from l),
q as (select p.doc_id, p.source, p.size, t.source_size, t.target, cast(sum(p.size) over (partition by p.source order by p.place, p.doc_id nulls first rows unbounded preceding) as bigint) as stop from p join t on p.source is not distinct from t.source)
select doc_id, source, size, source_size, target, case when target>0 then (stop-size)/target end as virtual_start, case when target>0 then stop/target end as virtual_finish,
 cast(greatest(0,least(size,round(target)-(stop-size)))+greatest(0,least(size,round(target)-(stop-size)-source_size)) as bigint) as taken from q""",
    "op10_near_dup": r"""with recursive d as (select doc_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x20\x09-\x0D]+') as w from documents),
u as (select doc_id, unnest(w) as w, unnest(range(len(w))) as i, len(w) as n from d),
g as (select doc_id, n, w||' '||lead(w,1) over o||' '||lead(w,2) over o||' '||lead(w,3) over o||' '||lead(w,4) over o as s from u window o as (partition by doc_id order by i)),
s as (select distinct doc_id, s from (select doc_id, s from g where n>=5 and s is not null union all select doc_id, array_to_string(w,' ') from d where len(w) between 1 and 4)),
c as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.s=b.s and a.doc_id<>b.doc_id group by 1,2),
e as (select x, y from p join c cx on cx.doc_id=x join c cy on cy.doc_id=y where 100*k>=75*(cx.n+cy.n-k)),
r(doc_id, root) as (select doc_id, doc_id from documents union select e.y, r.root from r join e on e.x=r.doc_id),
m as (select doc_id, min(root) as component_id from r group by 1)
select d.doc_id, coalesce(c.n,0) as n_shingles, component_id, d.doc_id=component_id as kept from d join m on m.doc_id=d.doc_id left join c on c.doc_id=d.doc_id""",
}
