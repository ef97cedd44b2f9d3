"""Aliases, references and substrings against plain loops, and on odd input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lookup as L


def clean(t):
    return re.sub(r"\s+", " ", t.strip().lower().replace("_", " ").replace("-", " ")).strip()


@pytest.mark.parametrize("chars", [0, 10**9])
def test_aliases_against_regular_expressions(spark, chars):
    r = random.Random(1)
    word = lambda: r.choice(["sin", "theta", "θ", "pi", "c++", "a", "élan", "ab", "x_y", "π2"])
    aliases = [(" ".join(word() for _ in range(r.randint(1, 3))), f"topic {i % 7}", i) for i in range(60)] + [("", "nothing", -1)]
    texts = [r.choice(["", " "]) + r.choice([" ", ", ", "-", "", "  "]).join(word() for _ in range(r.randint(0, 6))) for _ in range(300)] + [None]
    known = {}
    for a, c, _ in aliases:
        if clean(a):
            known.setdefault(clean(a), c)
    want = []
    for t in texts:
        c = clean(t) if t is not None else None
        hit = None if not c else c if c in known else next((a for a in known if re.search(rf"\b{re.escape(a)}\b", c)), None)
        want.append((known[hit] if hit else c, hit))
    df = spark.createDataFrame(list(enumerate(texts)), "n long, said string").withColumn("alias", F.lit("clash"))
    known_df = spark.createDataFrame(aliases, "alias string, canonical string, priority int")
    got = {r.n: (r.topic, r.alias) for r in L.normalize_topics(df, "said", known_df, automaton_chars=chars).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(h is not None for _, h in want) > 100
    assert L.normalize_topics(df, "said", known_df.limit(0), automaton_chars=chars).count() == len(texts)


def test_resolve(spark):
    refs = spark.createDataFrame([(1, "a", "Light"), (2, "a", "light"), (3, "b", "Sound")], "id int, g string, title string")
    asked = spark.createDataFrame([("1", "a"), ("LIGHT", "a"), ("Sound", "a"), ("Sound", "b"), ("", "a"), (None, "b"), ("1", "b"), ("1", "a")], "said string, g string")
    got = L.resolve(asked, refs, [F.col("said"), F.lower("said")], [F.col("id"), F.col("title"), F.lower("title")], ["g"], "id").collect()
    assert {(r.said, r.g): (r.reference, r.key_no) for r in got} == {("1", "a"): (1, 0), ("LIGHT", "a"): (1, 1), ("Sound", "a"): (None, None), ("Sound", "b"): (3, 0), ("", "a"): (None, None), (None, "b"): (None, None), ("1", "b"): (None, None)}
    assert len(got) == 8


def test_substrings_against_contains(spark):
    r = random.Random(2)
    docs = [(i, r.choice(["x", "y", None]), "".join(r.choice("abc \n") for _ in range(r.randint(0, 60)))) for i in range(200)] + [(900, "x", None), (1, "x", "cab cab")]
    probes = [(i, r.choice(["x", "y"]), "".join(r.choice("abc \n") for _ in range(r.randint(0, 8)))) for i in range(80)] + [(99, "x", None)]
    df, asked = spark.createDataFrame(docs, "doc_id long, s string, text string"), spark.createDataFrame(probes, "probe_id long, s string, probe string")
    got = L.substring_hits(df, asked, ["s"]).collect()
    want = {(p, d) for p, s, t in probes if t for d, s2, text in docs if s == s2 and text and t in text}
    assert {(r.probe_id, r.doc_id) for r in got if r.hit} == want
    tried = sum(1 for p, s, t in probes if t and len(t) > 2 for d, s2, text in docs if s == s2 and text)
    long = {p for p, _, t in probes if t and len(t) > 2}
    assert sum(r.probe_id in long for r in got) < 0.2 * tried  # few texts are verified
