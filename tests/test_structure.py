"""Chapters, repaired chunks and chunks of even length against loops and cases."""

import random
import re

from pyspark.sql import functions as F

from quillspark.operators import content as K
from quillspark.operators import corpus as C
from quillspark.operators import structure as S


def test_chapter_offsets_cut_the_text(spark):
    texts = ["intro\nExample 0\nChapter 1: Light, mirrors - lenses\n\nActivity one\nbody\nUnit 2\n2.1 Waves\nNotes:\nend", "", "no heading here at all", "Chapter 1", "Chapter 1\n", None, "ಅಧ್ಯಾಯ 3\nಉದಾಹರಣೆ x"]
    got = S.chapters(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "chapter_no").collect()
    assert [(r.doc_id, r.title) for r in got] == [(0, "Chapter 1: Light, mirrors - lenses"), (0, "Unit 2"), (0, "Notes:"), (1, "Document"), (2, "Document"), (3, "Chapter 1"), (4, "Chapter 1"), (6, "ಅಧ್ಯಾಯ 3")]
    for r in got:
        text = texts[r.doc_id]
        part = text[r.start : r.end]
        assert r.title == "Document" or part.startswith(r.title)
        for s in r.sections:
            assert text[s.start : s.start + len(s.title)] == s.title and r.start <= s.start < r.end
    assert "".join(texts[0][r.start : r.end] for r in got[:3]) == texts[0][got[0].start :]
    assert got[0].topics == ["light", "mirrors", "lenses"] and [s.title for s in got[0].sections] == ["Activity one"] and [s.title for s in got[1].sections] == ["2.1 Waves"]
    assert S.chapters(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def said(n, r=None):
    r = r or random
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_repaired_chunks_against_a_loop(spark):
    r = random.Random(1)
    rows = []
    for doc in range(30):
        for no in range(r.randint(1, 12)):
            rows.append((doc, no, r.choice(["", "12", "= + -", None, "same text again " * 30, said(r.randint(1, 260), r), said(r.randint(50, 160), r)])))
    df = spark.createDataFrame(rows, "doc_id long, no int, text string")
    classes = {(x.doc_id, x.no): (x.text, x.c, x.words) for x in K.facts(df.select("doc_id", "no", C.filter_lines(F.coalesce("text", F.lit(""))).alias("text"))).withColumn("again", F.lit(False)).withColumn("c", K.extraction_class()).collect()}
    seen, kept = set(), {}
    for doc, no, _ in rows:
        text, kind, words = classes[doc, no]
        norm = " ".join(text.lower().split())
        if norm and norm in seen:
            kind = "DUPLICATE"
        seen.add(norm)
        if kind not in ("EMPTY", "DUPLICATE", "HEADER_FOOTER", "OCR_NOISE"):
            kept.setdefault(doc, []).append((text, words))
    want = []
    for doc, chunks in kept.items():
        groups = []
        for text, words in chunks:
            if groups and (groups[-1][1] < 150 or groups[-1][1] + words <= 400):
                groups[-1] = (f"{groups[-1][0]}\n\n{text}", groups[-1][1] + words, groups[-1][2] + 1)
            else:
                groups.append((text, words, 1))
        want += [(doc, t, w, m) for t, w, m in groups if w >= 100]
    got = [(x.doc_id, x.text, x.n_words, x.merged) for x in S.repaired(df, ["doc_id"], "no").collect()]
    assert sorted(got) == sorted(want) and len(want) > 10
    assert S.repaired(df.limit(0), ["doc_id"], "no").count() == 0


def piece(n, kind="concept", topic="", at=0, context=()):
    return S.Piece(" ".join(f"w{i}." if i % 20 == 19 else f"w{i}" for i in range(n)), n, kind, topic, (at,), context=context)


def test_even_chunks_cases():
    sizes = lambda *pieces: [(p.words, p.action) for p in S.even(list(pieces))]
    assert sizes(piece(100), piece(120), piece(90)) == [(310, "merged")]
    assert sizes(piece(300), piece(50)) == [(350, "merged")]
    assert sizes(piece(230), piece(390)) == [(230, "kept"), (390, "kept")]
    assert sizes(piece(900)) == [(340, "split"), (340, "split"), (220, "split")]
    assert sizes(piece(420)) == [(210, "window"), (210, "window")]
    assert sizes(piece(60)) == []
    assert sizes(piece(150, "concept", "a"), piece(150, "concept", "b")) == [(300, "merged")]  # of any kind, at the end
    assert sizes(piece(150, "concept", "a"), piece(390, "summary", "b")) == [(390, "kept")]
    assert sizes(piece(150, context=("one two " * 20, "x " * 300, "three " * 30))) == [(220, "context")]
    assert S.even([]) == []


def test_even_chunks_always(spark):
    r = random.Random(7)
    for _ in range(400):
        pieces = [piece(r.choice([0, 5, 80, 150, 199, 200, 260, 399, 401, 455, 1300]), r.choice(["concept", "example", "summary"]), r.choice(["", "a", "b"]), i) for i in range(r.randint(0, 12))]
        out = S.even(pieces)
        assert all(200 <= p.words <= 400 and p.words == len(re.findall("[A-Za-z0-9]+", p.text)) for p in out)
        total, kept = sum(p.words for p in pieces), sum(p.words for p in out)
        assert kept <= total and (kept >= total - 199 * len(pieces))
    rows = spark.createDataFrame([(1, i, "word " * 90, None, None, None) for i in range(10)] + [(2, 0, None, None, None, None)], "doc_id long, no int, text string, kind string, topic string, context array<string>")
    got = S.even_chunks(rows, ["doc_id"], "no").orderBy("no").collect()
    assert [(x.doc_id, x.n_words, x.merged) for x in got] == [(1, 270, [0, 1, 2]), (1, 270, [3, 4, 5]), (1, 360, [6, 7, 8, 9])]
    assert [x.n_words for x in S.even_chunks(rows, ["doc_id"], "no", part_rows=3).orderBy("part", "no").collect()] == [270, 270, 270]
    assert S.even_chunks(rows.limit(0), ["doc_id"], "no").count() == 0
