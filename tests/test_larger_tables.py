"""Queries on small tables that have what larger ones have: many rows of a group, nulls, repeated names."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import concepts as K
from quillspark.operators import coverage as V
from quillspark.operators import lookup as L
from quillspark.operators import scan
from quillspark.operators import similarity as S
from quillspark.plans import audits
from quillspark.plans.queries import ORACLE_SQL, table
from tests import compare


def against_sql(spark, folder, query, **tables):
    """How a query differs from its SQL on tables made by a SELECT each."""
    con = duckdb.connect()
    for name, made in tables.items():
        con.execute(f"copy ({made}) to '{folder}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return compare.difference(query(spark, str(folder)), con, ORACLE_SQL[query.__name__])


def test_chapter_sequence_beyond_three_digits(spark, tmp_path):
    part = "select i as p_partkey, case when i%50<>7 then 'name '||(i%9) end as p_name, case when i%100<>3 then 'Brand#'||(i%2) end as p_brand from range(2400) t(i)"
    assert against_sql(spark, tmp_path, audits.chapter_sequence, part=part) == ""


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd_strings(r):
    some = lambda n: "".join(r.choice("abé\nθ ") for _ in range(n))
    strings = list({(r.randint(0, 1), some(r.randint(1, 9)) if r.random() < 0.9 else some(3) * r.randint(1, 20)) for _ in range(300)})
    return strings, [(r.randint(0, 1), some(r.randint(0, 200)) + r.choice(strings)[1] * r.randint(0, 1)) for _ in range(300)]


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_scan_against_contains(monkeypatch, piece):
    monkeypatch.setattr(scan, "PIECE", piece)
    strings, texts = odd_strings(random.Random(piece))
    of = lambda rows: np.array([g * 12345 + 7 for g, _ in rows], np.uint64)
    rows, said = scan.Sought(pa.array([p for _, p in strings]), of(strings)).held(*scan._bytes(pa.array([t for _, t in texts])), of(texts))
    got = list(zip(rows.tolist(), said.tolist(), strict=True))
    assert set(got) == {(i, j) for i, (g, t) in enumerate(texts) for j, (h, p) in enumerate(strings) if g == h and p in t} and len(set(got)) == len(got)


def test_strings_in_several_blocks(spark):
    strings, texts = odd_strings(random.Random(1))
    df = spark.createDataFrame([(g, i, t) for i, (g, t) in enumerate(texts)] + [(None, 900, "ab"), (1, 901, None)], "g int, i int, text string").repartition(3)
    probes = spark.createDataFrame([*strings, (None, "a"), (0, ""), (1, None), strings[0]], "g long, probe string")
    want = {(i, p) for i, (g, t) in enumerate(texts) for h, p in strings if g == h and p in t}
    for block in (2000, 10**7):
        got = [tuple(x) for x in scan.strings_held(df, probes, ["g"], ["i"], block_bytes=block).collect()]
        assert set(got) == want and len(got) == len(want)
        assert {tuple(x) for x in scan.strings_held(df, probes, ["g"], ["g"], once=True, block_bytes=block).collect()} == {(texts[i][0], p) for i, p in want}


def test_substrings_are_not_cut_into_trigrams(spark):
    df = spark.createDataFrame([(1, "x", "abcabc")], "doc_id long, s string, text string")
    assert "Generate" not in plan(L.substring_hits(df, df.select(F.col("doc_id").alias("probe_id"), "s", F.lit("cab").alias("probe")), ["s"]))


def test_contained_pairs_come_without_a_join(spark):
    df = spark.createDataFrame([("x", "wave"), ("x", "light wave"), ("y", "light"), ("x", "")], "g string, key string")
    got = K.contained_pairs(df, ["g"])
    assert [tuple(x) for x in got.collect()] == [("x", "wave", "light wave")] and "Join" not in plan(got)


def test_candidates_by_either_way(spark, sf):
    docs = table(spark, sf, "documents").where("source is not null")
    docs = docs.unionByName(docs.limit(1).select(*[F.lit("Light is " + "so bright a wave " * 3000).alias(c) if c == "text" else F.col(c) for c in docs.columns]))  # a sentence without end
    found = K.candidates(docs, ["source"])
    assert sorted(map(tuple, K.candidate_keys(docs, ["source"]).collect())) == sorted(map(tuple, found.select("source", "key").collect()))
    shown = ["source", "key", "name", "frequency", "definition", "n_formulas"]
    want = K.validated(found).where("reason is null").select(*shown).collect()
    bare = K.valid_names(docs, ["source"])
    assert sorted(bare.select(*shown).collect(), key=repr) == sorted(want, key=repr) and "evidence" not in bare.columns
    plain = docs.where(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    pattern = re.compile(K.DEFINED, re.I | re.A)
    whole = [(d.doc_id, no, m[1], " ".join(m[0].split())) for d in plain.collect() for no, m in enumerate(pattern.finditer(d.text))]
    dropped = lambda term: term.lower().strip("- \n") in K.LABELS
    want = sorted((i, no, said) for i, no, term, said in whole if not dropped(term))
    assert sorted((x.doc_id, x.no, x.said) for x in K.defined_terms(plain, ["source"]).collect()) == want and len(want) > 50


def test_coverage_looks_for_names_without_pairs(spark):
    items = spark.createDataFrame([("x", "concept", "light"), ("x", "concept", "dark")], "g string, kind string, text string")
    got = V.coverage(items, spark.createDataFrame([("light here",), ("light there",)], "text string"), ["g"])
    assert [tuple(x) for x in got.where("kind = 'concept'").select("n", "retained", "missing").collect()] == [(2, 1, ["dark"])]
    assert "contains(" not in plan(got).lower()


def test_related_names_come_without_a_join(spark):
    r = random.Random(3)
    word = lambda: r.choice(["light", "Wave", "mirror", "lens", "of", "energy"])
    names = [(r.choice("xy"), " ".join(word() for _ in range(r.randint(1, 5)))) for _ in range(60)]
    texts = [(r.choice("xy"), i // 2, " ".join(word() for _ in range(r.randint(0, 6)))) for i in range(80)]  # two of an id
    df, asked = spark.createDataFrame(texts, "g string, text_id int, text string"), spark.createDataFrame(names, "g string, name string")
    want = {}
    of = lambda t: {w for w in t.lower().split() if len(w) > 3}
    for g, i, t in texts:
        for h, n in names:
            inside = n.lower() in t.lower()
            if g == h and t and (inside or of(n) and len(of(n) & of(t)) >= 0.65 * len(of(n))):
                want[g, i, n] = want.get((g, i, n), False) or inside
    assert {(x.g, x.text_id, x.name): x.contained for x in V.related_names(df, asked, ["g"]).collect()} == want
    assert "Join" not in plan(V.related_names(df.where("text_id < 0 or text = ''").unionByName(df.dropDuplicates(["g", "text_id"])), asked, ["g"]))


def test_references_that_share_keys_are_joined_once(spark):
    same = spark.range(300).select(F.col("id").alias("reference"), F.lit("b").alias("brand"), F.when(F.col("id") % 3 > 0, "big ring").otherwise("old ring").alias("name"))
    asked = same.select(F.col("reference").alias("asked"), "brand", F.col("name").alias("said"))
    got = L.resolve(asked, same, [F.col("said"), F.lower("said"), T.slug("said")], [F.col("reference"), F.col("name"), T.slug("name")], ["brand"], "reference")
    assert {tuple(x) for x in got.select("said", "reference", "key_no").collect()} == {("old ring", 0, 0), ("big ring", 1, 0)} and got.count() == 300
    assert "min(reference" in plan(got)


def test_ratios_are_bounded_by_longer_runs(monkeypatch):
    r, tried = random.Random(4), []
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    texts = [" ".join(r.choice(words) for _ in range(600)) for _ in range(30)]
    texts += [t[:400] + "x" + t[401:] for t in texts[:5]]
    plain = S.matching_ratio
    monkeypatch.setattr(S, "matching_ratio", lambda a, b: tried.append(1) or plain(a, b))
    recent, kept, want = S.Recent([], 40, 0.95), [], []
    for t in texts:
        kept.append(not recent.repeats(t))
        want.append(not any(plain(t, texts[i]) >= 0.95 for i in range(len(want)) if want[i]))
        if kept[-1]:
            recent.add(t)
    assert kept == want and len(tried) <= 5  # of copies alone
    for _ in range(2000):
        a = "".join(r.choice("abcd") for _ in range(r.randint(0, 120)))
        i, j = sorted((r.randint(0, len(a)), r.randint(0, len(a))))
        b = a[:i] + r.choice(["", "a", "bc"]) + a[i + r.randint(0, 2) : j] + a[j + r.randint(0, 1) :]
        assert plain(a, b) < 0.95 or all(S.still_possible(a, b, S.long_grams(a, n), S.long_grams(b, n), n, 0.95) for n in S.LONG_GRAMS)
