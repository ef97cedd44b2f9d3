"""Registered queries over concepts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import concepts as K
from quillspark.plans.queries import query, table


def _list(words: tuple[str, ...]) -> str:
    return ",".join(f"'{w}'" for w in words)


def _strip(x: str) -> str:
    return rf"regexp_replace({x},'^\s+|\s+$','','g')"


def _flat(x: str) -> str:
    return _strip(rf"regexp_replace({x},'\s+',' ','g')")


_ASCII = r"regexp_replace(text,'[^\x00-\x7F]','_','g')"  # an underscore is a letter to \b, as other letters are to Spark
_LOW = _strip(r"regexp_replace(regexp_replace(lower(name),'[^a-z0-9\s-]',' ','g'),'\s+',' ','g')")
_PLACE = "(lead, o, no)"
#: Candidates in SQL, up to `c`: one row for each candidate of a source.
CANDIDATES = rf"""with r as (select source, doc_id, text, {_ASCII} as t from documents where {_strip('text')}<>'' and source is not null),
w as (select source, doc_id, unnest(regexp_extract_all(lower(text),'[a-z0-9]+')) as term, unnest(range(len(regexp_extract_all(lower(text),'[a-z0-9]+')))) as i from r),
p as (select source, term, count(*) as n, min((doc_id,i)) as f from w where length(term)>=4 and term not in ({_list(K.LABELS)}) and not regexp_full_match(term,'[0-9]+') group by all),
p2 as (select *, row_number() over (partition by source order by n desc, f) as place from p qualify place<=20),
d0 as (select source, doc_id, unnest(regexp_extract_all(t,'(?i){K.DEFINED}',1)) as a, unnest(regexp_extract_all(t,'(?i){K.DEFINED}',0)) as said, unnest(range(len(regexp_extract_all(t,'(?i){K.DEFINED}',0)))) as no from r),
d1 as (select source, doc_id, no, {_flat(r"regexp_replace(a,'[^A-Za-z0-9\s-]',' ','g')")} as term, {_flat('said')} as said from d0),
d as (select source, doc_id, no, substr(term,1,60) as term, lower(substr(term,1,60)) as key, said from d1 where term<>'' and lower(term) not in ({_list(K.LABELS)}) and not regexp_full_match(term,'[0-9]+')),
g as (select source, count(*) as n_rows, count(distinct case when regexp_matches(t,'(?i){K.WORKED}') then {_flat('substr(text,1,1200)')} end) as n_worked,
 count(distinct case when not regexp_matches(t,'(?i){K.WORKED}') and regexp_matches(t,'(?i){K.SHOWN}') then {_flat('substr(text,1,1000)')} end) as n_examples from r group by 1),
fo as (select source, count(distinct f) as n_formulas from (select source, {_flat('f')} as f from (select source, unnest(regexp_extract_all(text,'{K.FORMULA}',1)) as f from r)) where length(f) between 3 and 120 group by 1),
ob as (select source, count(distinct o) as n_objectives from (select source, {_flat('o')} as o from (select source, unnest(regexp_extract_all(t,'(?i){K.OBJECTIVE}',0)) as o from r)) group by 1),
e0 as (select source, doc_id, substr(text,1,600) as start, coalesce(sum(length(substr(text,1,600))+1) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding),0) as before from r),
e as (select source, string_agg(start,' ' order by doc_id) as evidence from e0 where before<2000 group by 1),
bt as (select source, key, count(*) as n_defined, min((doc_id,no,term,said)) as d from d group by all),
k0 as (select distinct source, key, doc_id from d where (source,key) not in (select (source,term) from p2)),
k1 as (select source, key, doc_id, substr(text,1,600) as start, coalesce(sum(length(substr(text,1,600))+1) over (partition by source, key order by doc_id rows between unbounded preceding and 1 preceding),0) as before from k0 join (select doc_id, text from r) using (doc_id)),
ke as (select source, key, string_agg(start,' ' order by doc_id) as evidence from k1 where before<2000 group by all),
c0 as (select p2.source, term as key, term as name0, 0 as lead, place as o, 0 as no, n_rows*(case when place<=5 then 2 else 1 end)+2*coalesce(n_defined,0) as frequency, d[4] as definition,
 case when place<=5 then least(coalesce(n_formulas,0),5) else 0 end as n_formulas, case when place<=5 then least(coalesce(n_objectives,0),5) else 0 end as n_objectives,
 case when place<=5 then least(n_examples,5) else 0 end as n_examples, case when place<=5 then least(n_worked,5) else 0 end as n_worked, least(n_rows,30) as n_chunks, evidence
 from p2 join g using (source) left join fo using (source) left join ob using (source) left join e using (source) left join bt on bt.source=p2.source and bt.key=p2.term
 union all select bt.source, bt.key, d[3], 1, d[1], d[2], 2*n_defined+1, d[4], 0, 0, 0, 0, 1, evidence from bt join ke on ke.source=bt.source and ke.key=bt.key),
c1 as (select * exclude (name0), array_to_string(list_transform(regexp_extract_all(lower(name0),'[a-z]+|[^a-z]+'), lambda x: upper(x[1])||x[2:]),'') as name from c0),
c2 as (select *, {_LOW} as low, string_split({_LOW},' ') as ws from c1),
c as (select *, case when low='' then 'empty' when length(low)<4 then 'shorter than threshold' when length(low)>70 then 'too long' when low in ({_list(K.NOISE)}) then 'stopword phrase'
 when regexp_matches(low,'^(chapter|unit|lesson|class|grade)\s*[0-9]+') then 'chapter label' when regexp_matches(low,'^(fig|figure|table)\s*[0-9]+') then 'page artifact' when regexp_full_match(low,'[0-9]+') then 'page number'
 when regexp_matches(low,'{"|".join(K.IMPRINT)}') then 'publisher text' when regexp_matches(low,'([a-z]\s){{4,}}[a-z]') then 'ocr fragment' when length(regexp_replace(low,'[^a-z]','','g'))/length(low)<0.45 then 'low alphabetic density'
 when ws[1] in ({_list(K.OPENERS)}) then 'clause opener' when len(ws)>5 and n_formulas=0 then 'long phrase' when len(ws)=1 and frequency<2 and definition is null then 'weak single-token evidence' when len(list_distinct(ws))<len(ws)/2 then 'repeated tokens' end as reason,
 case when n_formulas>0 or regexp_matches(lower(name||' '||evidence),'[=<>≤≥]') then 'FORMULA' {" ".join(f"when regexp_matches(lower(name||' '||evidence),'{p}') then '{k}'" for k, p in K.SAID)} when n_examples+n_worked>0 then 'EXAMPLE' when definition is not null then 'DEFINITION' else 'CONCEPT' end as concept_type from c2)"""
_SHOWN = "source, key, name, frequency, definition, n_formulas, n_objectives, n_examples, n_worked, n_chunks"


def _plain(df):
    """The definition with characters beyond ASCII as underscores, as SQL sees it."""
    return df.withColumn("definition", F.regexp_replace("definition", r"[^\x00-\x7F]", "_"))


@query(CANDIDATES + f" select {_SHOWN}, reason, concept_type from c")
def concept_validation(spark, sf_dir):
    """Candidate concepts of each source with the reason why they are none, and their type."""
    found = K.validated(K.candidates(table(spark, sf_dir, "documents").where("source is not null"), ["source"]))
    return _plain(found).select(*_SHOWN.split(", "), "reason", "concept_type")


@query(f"""{CANDIDATES.replace("with r as", "with recursive r as", 1)},
v as (select *, n_chunks+n_formulas+n_examples+n_worked as strength, row_number() over (partition by source order by {_PLACE}) as step from c where reason is null),
z as (select source, max(step) as steps from v group by 1),
fold(source, step, kept) as (select source, cast(0 as bigint), cast([] as struct(key varchar, s bigint, step bigint)[]) from z
 union all select f.source, v.step, case when len(list_filter(f.kept, lambda x: (contains(x.key,v.key) or contains(v.key,x.key)) and x.s>=v.strength))>0 then f.kept else list_append(f.kept, {{'key': v.key, 's': cast(v.strength as bigint), 'step': v.step}}) end
 from fold f join v on v.source=f.source and v.step=f.step+1),
kept as (select f.source, unnest(f.kept).step as step from fold f join z on z.source=f.source and z.steps=f.step),
b as (select v.*, row_number() over (partition by source order by case when concept_type in ({_list(K.STRONG_TYPES)}) then 3 else 1 end desc, n_formulas+n_examples+n_worked desc, n_chunks desc, {_PLACE}) as rank from v join kept using (source, step))
select {_SHOWN}, concept_type, strength, rank from b where rank<=35""")
def concept_extraction(spark, sf_dir):
    """The best concepts of each source, without names that stronger ones contain."""
    return _plain(K.concepts(table(spark, sf_dir, "documents"), ["source"])).select(*_SHOWN.split(", "), "concept_type", "strength", "rank")


@query(f"""{CANDIDATES} select a.source, a.key as part, b.key as whole from c a join c b on a.source=b.source and length(a.key)<length(b.key) and contains(b.key,a.key)""")
def contained_names(spark, sf_dir):
    """Candidate names of a source that are part of another one."""
    return K.contained_pairs(K.candidate_keys(table(spark, sf_dir, "documents").where("source is not null"), ["source"]), ["source"])
