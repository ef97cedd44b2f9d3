"""Related names, coverage, dense search and running sums against plain loops."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import analytics as A
from quillspark.operators import coverage as V
from quillspark.operators import retrieval as R


def said(r, n):
    return " ".join(r.choice(["light", "Wave", "waves", "of", "a", "mirror", "lens", "lenses", "energy"]) for _ in range(n))


def test_related_names_against_all_pairs(spark):
    r = random.Random(1)
    names = [(r.choice("xy"), said(r, r.randint(1, 4))) for _ in range(80)] + [("x", ""), (None, "light"), ("x", None)]
    texts = [(r.choice("xy"), i, said(r, r.randint(0, 6))) for i in range(100)] + [("x", 900, None), (None, 901, "light")]
    words = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) >= 4}
    want = set()
    for g, i, t in texts:
        for h, n in names:
            if g and g == h and n and t:
                inside, w = n.lower() in t.lower(), words(n)
                if inside or w and len(w & words(t)) / len(w) >= 0.65:
                    want.add((g, i, n, inside))
    got = V.related_names(spark.createDataFrame(texts, "g string, text_id long, text string"), spark.createDataFrame(names, "g string, name string"), ["g"])
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)


def test_coverage_against_a_loop(spark):
    r = random.Random(2)
    items = [(r.choice("xy"), r.choice(V.KINDS), said(r, r.randint(0, 5)) + r.choice(["", " = x + y"])) for _ in range(120)] + [("x", "definition", None), ("z", "concept", "light")]
    out = [(r.choice("xy"), said(r, r.randint(0, 3))) for _ in range(6)] + [("x", None)]
    norm = lambda t: " ".join((t or "").lower().split())
    for keyed in (True, False):
        want = {}
        for g in "xyz":
            texts = [norm(t) for h, t in out if t is not None and (h == g or not keyed)]
            words = {w for t in texts for w in t.split()}
            for kind in V.KINDS:
                own, missing = sorted({t or "" for h, k, t in items if (h, k) == (g, kind)}), []
                for t in own:
                    kept = norm(t) == "" or kind in ("concept", "formula") and any(norm(t) in x for x in texts)
                    if kind != "concept":
                        least, most, share = V.OVERLAPS[kind]
                        w = {x for x in norm(t).split() if len(x) >= least}
                        kept = kept or not w or len(w & words) / min(len(w), most) >= share
                    if not kept:
                        missing.append(t)
                want[g, kind] = (len(own), len(own) - len(missing), 100.0 if not own else round(100 * (len(own) - len(missing)) / len(own), 2), missing[:40])
        published = spark.createDataFrame(out, "g string, text string")
        got = V.coverage(spark.createDataFrame(items, "g string, kind string, text string"), published if keyed else published.select("text"), ["g"])
        assert {(x.g, x.kind): (x.n, x.retained, x.percent, x.missing) for x in got.collect()} == want


def test_dense_against_all_pairs(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).round(3).tolist()) for i in range(300)] + [(500 + i, [0.5] * 8) for i in range(20)] + [(600, [1.0, 2.0]), (601, None), (602, []), (0, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    got = {}
    for x in R.dense(df, asked, 7, block_rows=5).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    for q in {i for i, v in rows if i % 20 == 0 and v is not None}:
        best = {}
        for i, v in rows:
            if i != q and v is not None:
                score = max(round(float(np.dot(u, v)), 6) if len(u) == len(v) else 0.0 for j, u in rows if j == q and u is not None)
                best[i] = max(score, best.get(i, score))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [i for i, _ in got[q]] == [i for i, _ in want] and np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-6)
    assert R.dense(df, asked.limit(0), 7).count() == 0


def test_running_sum(spark):
    r = random.Random(4)
    rows = [(i, r.randint(0, 9), r.randint(0, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "item int, size int, at int")
    got = {x.item: x.held for x in A.running_sum(df, [F.desc("at"), F.asc("item")], "size", "held").collect()}
    total = 0
    for i, size, _ in sorted(rows, key=lambda x: (-x[2], x[0])):
        total += size
        assert got[i] == total
