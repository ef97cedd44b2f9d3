"""Catalogs and graphs against plain loops, and on odd input."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalog as C
from quillspark.operators import graph as G

RANGE = "book string, start_page int, end_page int, n int"


@pytest.mark.parametrize("longest", [3, 400])
def test_overlaps_against_all_pairs(spark, longest):
    r = random.Random(longest)
    rows = [(r.choice("ab"), s, s + r.randint(-1, longest)) for s in (r.randint(-40, 300) for _ in range(250))] + [("c", 5, 5)] * 40 + [("c", 1, 9), ("a", None, 3), ("a", 3, None)]
    df = spark.createDataFrame([(*x, 0) for x in rows], RANGE)
    fine = [x for x in rows if None not in x and x[1] <= x[2]]
    meet = lambda x, y: x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]
    got = {(x.book, x.start_page, x.end_page): (x.n, x.n_overlaps) for x in C.overlap_counts(df, ["book"]).collect()}
    assert got == {x: (fine.count(x), sum(meet(x, y) for y in fine) - 1) for x in set(fine)}
    pairs = [tuple(x) for x in C.overlapping_ranges(df, ["book"]).collect()]
    assert sorted(pairs) == sorted((*x, *y[1:]) for x in set(fine) for y in set(fine) if x < y and meet(x, y))


def test_classes_against_union(spark):
    r = random.Random(1)
    for nodes, links in ((300, 250), (300, 100), (200, 199)):
        pairs = [(i, i + 1) for i in range(links)] if links == 199 else [(r.randrange(nodes), r.randrange(nodes)) for _ in range(links)]
        group = {n: n for n in range(nodes)}
        for a, b in pairs:
            a, b = sorted((group[a], group[b]))
            group = {n: a if g == b else g for n, g in group.items()}
        df = spark.createDataFrame([*pairs, (None, 4), (5, None)], "src long, dst long")
        got = [tuple(x) for x in C.classes(df).collect()]
        assert sorted(got) == sorted((n, group[n]) for n in {x for p in pairs for x in p})
    assert C.classes(df.limit(0)).count() == 0


def test_alias_classes(spark):
    rows = [("x", "Light and  Shadow"), ("w", "light and shadow "), ("w", "optics"), ("v", "optics"), ("u", ""), ("t", None), (None, "optics"), ("s", "s"), ("s", "s")]
    got = C.alias_classes(spark.createDataFrame(rows, "chapter_id string, alias string"))
    assert dict(got.collect()) == {"x": "v", "w": "v", "v": "v", "u": "u", "t": "t", "s": "s"} and got.count() == 6


def test_rebuild(spark):
    rows = [("b", 7, "Social Science", "Chapter 1: Maps", "english", 1, 9, 20), ("b", 7, "Social Science", "chapter 1 maps", "English ", 9, 30, 20), ("b", 7, "Social Science", "Two", None, 5, 2, 20), ("c", None, None, None, "hindi", 0, None, None), (None, 7, "Social Science", "Two", None, 5, 6, 20)]
    df = spark.createDataFrame(rows, "book_id string, grade int, subject string, title string, language string, start_page int, end_page int, page_count int").withColumn("n", F.lit("clash"))
    out = C.rebuild(df)
    got = sorted(((x.book_id or "", x.chapter_id, x.errors, x.copies, x.n_overlaps) for x in out.collect()), key=repr)
    maps = "chapter_7_social_science_chapter_1_maps_english"
    assert got == sorted([("b", maps, [], 2, 1), ("b", maps, ["end_page_exceeds_pdf_pages"], 2, 1), ("b", "chapter_7_social_science_two_", ["end_page_before_start_page"], 2, None), ("c", "chapter____hindi", ["missing_pdf", "start_page<1", "no_page_range"], 1, None), ("", "chapter_7_social_science_two_", [], 2, None)], key=repr)
    assert tuple(C.report(out).first()) == (2, 5, 1, 3, 2, 2, 3)
    assert C.rebuild(df.limit(0)).count() == 0 and C.report(C.rebuild(df.limit(0))).first().chapters == 0


CONCEPT = "g string, no int, name string, related array<string>, prerequisites array<string>, n_chunks int, n_formulas int, definition string, removed_by string"


def test_concept_graph(spark):
    rows = [("s", 1, "Light", ["Shadow", "Sound", "Shadow", None], ["Eye"], 1, 0, "", "x"), ("s", 2, " light ", [], None, 5, 0, "d", "x"), ("s", 3, "Shadow", None, ["Light", None], 2, 0, None, "x"), ("s", 4, "Sound", [], [], 1, 0, "", "x"), ("t", 1, "Sound", ["Light"], [], None, 1, None, "x"), ("s", 5, None, ["Light"], [], 9, 9, "d", "x"), ("s", 0, "Chapter 1", ["Light"], [], 9, 9, "d", "x")]
    df = spark.createDataFrame(rows, CONCEPT)
    marked = G.cleaned(df, ["g"], "no", ~F.col("name").startswith("Chapter"))
    assert {(x.g, x.no): x.removed for x in marked.collect()} == {("s", 1): None, ("s", 2): "repeat", ("s", 3): None, ("s", 4): "no_evidence", ("t", 1): None, ("s", 5): "invalid", ("s", 0): "invalid"}
    assert sorted(tuple(x) for x in G.concept_edges(marked, ["g"]).collect()) == [("s", "Eye", "Light", "prerequisite"), ("s", "Light", "Shadow", "prerequisite"), ("s", "Light", "Shadow", "related"), ("s", "Light", "Shadow", "related")]
    assert {tuple(x) for x in G.clean_up(marked, ["g"]).collect()} == {("s", 6, 2, 4, 2, 1, 1), ("t", 1, 1, 0, 0, 0, 0)}


def test_graph_merge(spark, tmp_path):
    at, edge = str(tmp_path / "graph"), "source string, target string, weight int"
    topic = spark.createDataFrame([("a", "b", 2), ("a", "b", 1), ("b", "c", None), (None, "c", 1)], edge)
    need = spark.createDataFrame([("a", "c", 1)], edge).drop("weight")
    merge = lambda **given: {x.relation: tuple(x)[1:] for x in G.merge_graph(spark, at, given).collect()}
    rows = lambda: sorted((x.relation, x.source, x.target, x.weight) for x in G.read_graph(spark, at).collect())
    assert rows() == []
    assert merge(topic=topic, need=need) == {"topic": (0, 2, 2, 0, 0, 1), "need": (0, 1, 1, 0, 0, 0)}
    first = [("need", "a", "c", 1), ("topic", "a", "b", 3), ("topic", "b", "c", 1)]
    assert rows() == first
    assert merge(topic=topic) == {"topic": (2, 2, 0, 0, 0, 1)} and rows() == first
    other = spark.createDataFrame([("a", "b", 5), ("x", "y", 1)], edge)
    assert merge(topic=other) == {"topic": (2, 2, 1, 1, 1, 0)}
    assert rows() == [("need", "a", "c", 1), ("topic", "a", "b", 5), ("topic", "x", "y", 1)]
    assert merge(topic=other.limit(0)) == {"topic": (2, 0, 0, 2, 0, 0)} and rows() == first[:1]
    broken = other.withColumn("weight", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        merge(need=broken)
    assert rows() == first[:1]
