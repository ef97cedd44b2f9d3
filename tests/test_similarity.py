"""Concepts and similar names and texts against brute force, and on odd input."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import concepts as K
from quillspark.operators import similarity as S
from quillspark.plans import similarity as plans


def words(r, n, k=12):
    return " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(n))


def changed(r, text, edits):
    out = list(text)
    for _ in range(edits):
        at = r.randrange(len(out) + 1)
        out[at : at + r.randint(0, 1)] = r.choice(["", "x", "y"])
    return "".join(out)


def test_containment_against_all_pairs(spark):
    r = random.Random(1)
    names = sorted({words(r, r.randint(1, 3)) for _ in range(300)} | {"", "a", "ab"})
    df = spark.createDataFrame([(g, n) for g in ("x", "y") for n in names[: 200 if g == "y" else None]], "g string, key string")
    want = sorted((g, a, b) for g in ("x", "y") for a in names[: 200 if g == "y" else None] for b in names[: 200 if g == "y" else None] if a and len(a) < len(b) and a in b)
    assert sorted(map(tuple, K.contained_pairs(df, ["g"]).collect())) == want


def test_keep_the_stronger(spark):
    r = random.Random(2)
    rows = [(i, "g", words(r, r.randint(1, 2)) + "abcd"[: r.randint(2, 4)], r.randint(0, 3)) for i in range(200)]
    rows = list({k: (i, g, k, s) for i, g, k, s in rows if len(k) >= 4}.values())
    rows += [(1000 + i, "g", "abcd" + "x" * i, 1) for i in range(12)]  # a long chain of blockers
    kept = []
    for i, _, k, s in sorted(rows):
        if not any((k in k2 or k2 in k) and s2 >= s for _, _, k2, s2 in kept):
            kept.append((i, "g", k, s))
    df = spark.createDataFrame(rows, "o int, g string, key string, s int")
    assert sorted(map(tuple, K.without_contained(df, ["g"], "s", "o").select("o", "g", "key", "s").collect())) == sorted(kept)


def test_concept_rules(spark):
    cases = [("", "empty"), ("abc", "shorter than threshold"), ("x" * 71, "too long"), ("Let Us", "stopword phrase"), ("Chapter 4 Light", "chapter label"), ("Fig. 3", "page artifact"), ("12345", "page number"), ("Isbn Code", "publisher text"), ("O p t i c s", "ocr fragment"), ("12 34 56 ab", "low alphabetic density"), ("When Light Falls", "clause opener"), ("One Of The Many Long Names", "long phrase"), ("Optics", "weak single-token evidence"), ("aa aa aa aa bb", "repeated tokens"), ("Plant Cells", None)]
    df = spark.createDataFrame([(n, w) for n, w in cases], "name string, want string").withColumn("got", K.rejection(F.col("name"), F.lit(1), F.lit(False), F.lit(False)))
    assert [(r.name, r.got) for r in df.collect()] == cases


def test_concepts_odd(spark):
    rows = [(1, None, "Osmosis is the movement of water through a membrane of cells."), (2, "s", None), (3, "s", "  "), (4, "s", "Osmosis is the movement of water through a membrane of cells."), (4, "s", "Osmosis is the movement of water through a membrane of cells.")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("key", F.lit(1))
    got = K.concepts(df, ["source"]).collect()
    assert {r.source for r in got} == {"s"} and "Osmosis" in {r.name for r in got}
    assert {r.source for r in K.candidates(df, ["source"]).collect()} == {None, "s"}
    assert K.concepts(df.limit(0), ["source"]).count() == 0


def test_bounds_never_reject_a_match():
    r = random.Random(3)
    for _ in range(3000):
        a = words(r, r.randint(0, 30))
        b = changed(r, a, r.randint(0, 12)) if r.random() < 0.8 else words(r, r.randint(0, 30))
        ratio = S.matching_ratio(a, b)
        for least in (0.7, 0.82, 0.95):
            may = S.possible(np.array([len(b)]), S.trigrams(b)[None], len(a), S.trigrams(a), least)[0]
            assert may or ratio < least


def test_fuzzy_names_against_all_pairs(spark):
    r = random.Random(4)
    base = [words(r, r.randint(1, 4)) for _ in range(120)]
    names = sorted({*base, *[changed(r, b, r.randint(1, 3)) for b in base], "a", "ab", "abc", "b", "aaaa", "aaaaa", "éé ü"} - {""})
    asked = names[::3]
    want = {}
    for x in asked:
        for y in names:
            ratio = SequenceMatcher(None, y, x).ratio()
            how = "equal" if x == y else "contained" if x in y or y in x else "similar" if ratio >= 0.82 else None
            if how:
                want[x, y] = (how, ratio if how == "similar" else None)
    frame = lambda n: spark.createDataFrame([(x,) for x in [*n, *n[:3], None, ""]], "name string")
    got = {(r.asked, r.name): (r.how, r.ratio) for r in S.fuzzy_names(frame(asked), frame(names)).collect()}
    assert got == want and sum(h == "similar" for h, _ in want.values()) > 30


def loop(rows, last=40, least=0.95):
    """The fold as one loop."""
    seen, kept, out = set(), defaultdict(list), {}
    for doc_id, key, text in rows:
        t = " ".join((text or "").lower().split())
        if t in seen:
            out[doc_id] = "exact"
            continue
        seen.add(t)
        if any(SequenceMatcher(None, t, p).ratio() >= least for p in kept[key][-last:]):
            out[doc_id] = "near"
            continue
        kept[key].append(t)
        out[doc_id] = "kept"
    return out


@pytest.mark.parametrize("last, ranges", [(1, 7), (3, 1), (3, 9), (40, 6)])
def test_near_repeats_against_a_loop(spark, last, ranges):
    r = random.Random(last)
    base = [words(r, 25) for _ in range(12)]
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, ""]) if r.random() < 0.02 else changed(r, r.choice(base), r.choice([0, 1, 2, 4, 8]))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {x.doc_id: x.status for x in S.near_repeats(df, ["source"], last=last, ranges=ranges).collect()}
    assert got == loop(rows, last) and len(set(got.values())) == 3


def test_near_repeats_odd(spark):
    df = spark.createDataFrame([(None, "s", "one two three"), (1, "s", "one two three"), (1, "s", "one two three"), (1, "s", "something else")], "doc_id long, source string, text string").withColumn("status", F.lit(1))
    assert sorted((x.doc_id or 0, x.status) for x in S.near_repeats(df, ["source"]).collect()) == [(0, "kept"), (1, "exact"), (1, "kept")]
    assert S.near_repeats(df.limit(0), ["source"]).count() == 0


def test_near_repeats_query(spark, sf):
    rows = [(r.doc_id, (r.source, r.lang), r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    short = [x for x in rows if len(x[2] or "") <= 3000]  # the loop is slow on long texts
    df = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") <= 3000)
    assert {x.doc_id: x.status for x in S.near_repeats(df, ["source", "lang"]).collect()} == loop(short)
    assert plans.near_repeats(spark, sf).count() == len(rows)
