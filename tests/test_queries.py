"""Registered queries against their SQL, and operators on small hand-made input."""

import datetime as dt
import importlib
import pkgutil

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import analytics as A
from quillspark.operators import corpus as C
from quillspark.operators import knowledge as K
from quillspark.operators import quality as Q
from quillspark.operators import retrieval as R
from quillspark import plans
from quillspark.plans import queries as P
from quillspark.sources import files as S
from quillspark.streaming import metrics as M
from tests import compare

for _module in pkgutil.iter_modules(plans.__path__):  # every module of queries registers its own
    importlib.import_module(f"quillspark.plans.{_module.name}")


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(P.ORACLE_SQL))
def test_query_matches_sql(spark, sf, con, name):
    assert compare.difference(P.QUERIES[name](spark, sf), con, P.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(P.QUERIES) - set(P.ORACLE_SQL)))
def test_other_queries_have_rows(spark, sf, name):
    assert P.QUERIES[name](spark, sf).count() > 0


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_scalars(spark):
    assert one(spark, T.normalize_text("t"), t="  A\n B ") == "a b"
    assert one(spark, T.normalize_name("t"), t="Plant  Life – 2.pdf") == "plant life"
    assert one(spark, T.shingles(F.split("t", " "), 2), t="a b c") == ["a b", "b c"]
    assert one(spark, T.shingles(F.split("t", " "), 4), t="a b c") == []
    assert one(spark, T.word_error_rate("a", "b"), a="the cat sat", b="the dog sat down") == pytest.approx(2 / 3)
    assert one(spark, T.word_error_rate("a", "b"), a="", b="") == 0.0
    assert one(spark, T.character_error_rate("a", "b"), a="", b="x") == 1.0
    assert one(spark, T.script_language("t"), t="ಕನ್ನಡ") == ("kn", "Kannada")
    assert one(spark, T.subject_name("t"), t="Maths") == "mathematics"
    assert one(spark, T.grade_of("t"), t="x/Class 7/science") == 7
    assert one(spark, T.grade_of("t"), t="no number") is None
    assert one(spark, T.chapter_title("t"), t="Light – 3.pdf") == "Light"
    assert tuple(one(spark, T.semver("t"), t="1.10.2")) == (1, 10, 2)
    assert one(spark, T.semver("a") < T.semver("b"), a="1.9.0", b="1.10.0")
    assert one(spark, T.quantize8("t"), t=[1.0, 1.0]) == [0, 0]
    assert sum(x * x for x in one(spark, T.hashed_embedding("t", 16), t="a b a")) == pytest.approx(1)
    assert one(spark, T.percent_or_full(F.lit(0), F.lit(0)), t=1) == 100.0
    assert one(spark, T.ratio_or_zero(F.lit(0), F.lit(0)), t=1) == 0.0
    assert one(spark, T.clean_breaks("t"), t="exam-\nple\n\n\n\nx\ty") == "example\n\nx y"
    assert one(spark, C.filter_lines(F.col("t")), t="Chapter 1\nA b\nx\nChapter 1\nA b\n12\nA b\nISBN 3") == "x"
    values = spark.createDataFrame([(i,) for i in range(1, 11)], "x int")
    assert values.agg(T.nearest_rank(F.col("x"), 0.9)).first()[0] == 9


def test_chunk_classes(spark):
    rows = ["", "page 12", "Chapter 4", "a b c d e f g h", "E = mc^2", "short line of words", "word " * 30, "word " * 30]
    df = spark.createDataFrame(list(enumerate(rows)), "n int, text string")
    got = [r.chunk_class for r in C.classify_chunks(df, ["n"]).orderBy("n").collect()]
    assert got == ["EMPTY_CONTENT", "PAGE_NUMBER", "HEADER_FOOTER", "OCR_NOISE", "FORMULA_ONLY", "SHORT_FRAGMENT", "EDUCATIONAL_TEXT", "DUPLICATE_CONTENT"]
    table = "\n".join(["a 1", "b 2", "c 3", "d"])
    assert one(spark, C.is_table_fragment(F.col("t")), t=table)


def test_sections_and_chunks(spark):
    df = spark.createDataFrame([(1, "intro line\n# First\nbody\n\nSECOND PART\nmore\nChapter 3\n"), (2, "")], "doc_id long, text string")
    assert [(r.title, r.content) for r in C.sections(df).orderBy("section_no").collect()] == [("Introduction", "intro line"), ("First", "body"), ("SECOND PART", "more")]
    df = spark.createDataFrame([(1, "abcdefghij")], "doc_id long, text string")
    assert [r.text for r in C.char_windows(df, 4, 1).orderBy("start").collect()] == ["abcd", "defg", "ghij"]
    lines = spark.createDataFrame([(1, "\n".join("x" * n for n in (700, 700, 900, 5000, 10)))], "doc_id long, text string")
    assert [r.n_chars for r in C.merge_paragraphs(lines).orderBy("chunk_no").collect()] == [1402, 900, 5000, 10]
    words = spark.createDataFrame([(1, " ".join(["a b c d."] * 120))], "doc_id long, text string")
    chunks = C.semantic_chunks(words).orderBy("chunk_no").collect()
    assert [r.n_words for r in chunks] == [200, 200, 80]
    pieces = C.word_windows(spark.createDataFrame([(1, "w " * 1000), (2, "w " * 450)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words) for r in pieces) == [(1, 332), (1, 334), (1, 334), (2, 450)]


def test_rerank_prefers_exact_topics(spark):
    rows = [("q", "exact", "What is photosynthesis?", "photosynthesis makes food", 0.55, "definition", 1.0, False, False, False), ("q", "related", "What is photosynthesis?", "leaf structure", 0.60, "explanation", 0.6, False, False, False)]
    hits = spark.createDataFrame(rows, "query_id string, doc_id string, query string, text string, score double, chunk_type string, topic_score double, chapter_match boolean, subject_match boolean, local boolean")
    assert R.rerank(hits, 5).where("rank = 1").first().doc_id == "exact"
    a = spark.createDataFrame([("q", 1, 0.5, "dense")], "query_id string, doc_id long, score double, source string")
    b = spark.createDataFrame([("q", 1, 0.7, "lexical"), ("q", 2, 0.1, "lexical")], a.schema)
    assert {(r.doc_id, r.score, r.sources) for r in R.merge_hits(a, b).collect()} == {(1, 0.7, "dense|lexical"), (2, 0.1, "lexical")}


def test_graph(spark):
    t = spark.createDataFrame([("c", "chlorophyll"), ("c", "photosynthesis"), ("c", "plant cells")], "chapter string, topic string")
    assert K.co_occurrence(t, "chapter", "topic").count() == 6
    assert {(r.topic, r.prerequisite) for r in K.prerequisites(t, "chapter", "topic").collect()} == {("photosynthesis", "chlorophyll"), ("plant cells", "photosynthesis")}
    intro = spark.createDataFrame([("c", "a introduction"), ("c", "b"), ("c", "d")], "chapter string, topic string")
    assert ("d", "a introduction") in {(r.topic, r.prerequisite) for r in K.prerequisites(intro, "chapter", "topic").collect()}
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert [r.node for r in K.isolated_nodes(spark.createDataFrame([("a",), ("z",)], "node string"), edges).collect()] == ["z"]


def test_glossary_quiz(spark):
    df = spark.createDataFrame([(1, "s", "Osmosis is the movement of water through a membrane.\nCell: the smallest unit of life"), (2, "s", "osmosis: something else that is longer")], "doc_id long, source string, text string")
    rows = {r.term_key: r for r in K.glossary(df, ["source"]).collect()}
    assert rows["osmosis"].definition == "the movement of water through a membrane" and rows["osmosis"].found == 2
    assert K.quizzes(K.glossary(df, ["source"]), ["source"]).count() == 2


def test_sync(spark):
    host = spark.createDataFrame([("a", 2, 10), ("b", 1, 5), ("d", 1, 7)], "pack_id string, version int, bytes long")
    client = spark.createDataFrame([("a", 1), ("b", 1), ("c", 3)], "pack_id string, version int")
    assert {r.pack_id: (r.action, r.download_bytes) for r in A.catalog_delta(host, client).collect()} == {"a": ("update", 10), "b": ("keep", 0), "c": ("remove", 0), "d": ("add", 7)}
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, A.upsert(old, new, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, A.insert_or_ignore(old, new, ["k"]).collect())) == [(1, "x"), (2, "y"), (3, "w")]


def test_validation(spark):
    df = spark.createDataFrame([("a", "1.0.0", None), ("b", "x", "s")], "pack_id string, version string, subject string")
    got = {r.pack_id: r.errors for r in Q.validation_errors(df, ["subject"], {"bad version": T.semver("version").isNotNull()}).collect()}
    assert got == {"a": ["missing:subject"], "b": ["bad version"]}


def test_sources(spark, tmp_path):
    (tmp_path / "class 7" / "science").mkdir(parents=True)
    (tmp_path / "class 7" / "science" / "Light – 3.txt").write_text("light travels")
    (tmp_path / "class 7" / "science" / "bad.txt").write_bytes(b"\xff\xfe")
    files = S.read_texts(spark, str(tmp_path))
    assert {(r.text, r.error) for r in files.collect()} == {("light travels", None), (None, "not UTF-8")}
    cache = files.where("error is null").select("path", "checksum")
    assert S.changed_files(files, cache).count() == 1
    meta = files.where("error is null").select(S.path_metadata("path").alias("m")).first().m
    assert (meta.grade, meta.subject) == (7, "science")
    S.write_artifacts(spark.createDataFrame([("p", "x")], "pack_id string, term string"), str(tmp_path / "out"))
    assert S.read_artifacts(spark, str(tmp_path / "out"), "term string, pack_id string").first().term == "x"


def test_streams_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select("event_id", "ts", "user_id", "event_type", "value", "props").orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))

    def run(frame, name, mode):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert q.awaitTermination(120)
        return spark.table(name)

    stream = M.read_events(spark, str(tmp_path / "in"))
    batch = {tuple(r) for r in M.tumbling(events, "1 hour").select("window.start", "event_type", "events").collect()}
    assert {tuple(r) for r in run(M.tumbling(stream, "1 hour"), "tumbling", "complete").select("window.start", "event_type", "events").collect()} == batch
    assert run(M.latest(stream), "latest", "complete").count() == M.latest(events).count()
    assert run(M.without_repeats(stream), "distinct_events", "append").count() == events.count()
    total = run(M.progress(stream), "progress", "update").groupBy("user_id").agg(F.max("answered").alias("n")).agg(F.sum("n")).first()[0]
    assert total == events.count()
    late = M.liveness(events, "300 seconds")
    assert late.agg(F.sum("events")).first()[0] == events.count()
    assert M.rolling_success(events).count() > 0
    assert isinstance(events.agg(F.max("ts")).first()[0], dt.datetime)


def test_type_score(spark):
    long = "word " * 60
    cases = [("What is light?", "definition", "x", 1.0), ("tell", "definition", "x", 0.6), ("the equation", "formula", "x", 1.0), ("tell", "formula", long, 0.55), ("tell", "formula", "x", 0.15), ("an example", "example", "x", 0.9), ("tell", "example", "x", 0.3), ("procedure", "experiment", "x", 0.9), ("what is", "ocr_noise", "x", 0.0), ("what is", "", "x", 0.0), ("what is", None, "x", 0.0), ("tell", "qa", "x", 0.6), ("tell", "table", "x", 0.3), ("define", "formula", None, 0.15)]
    df = spark.createDataFrame(cases, "q string, kind string, t string, want double").withColumn("got", R.type_score(F.col("q"), F.col("kind"), F.col("t")))
    assert all(r.got == r.want for r in df.collect())
