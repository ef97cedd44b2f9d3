"""The ten operators against brute force, exact round trips and held-out labels, and on odd input."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import arc_convert, decontaminate, fair_mix, html_blocks, langid, line_dedup, near_dup, rabitq, separator_scan, toxicity
from quillspark.llm.common import SHUFFLE_CLEANUP, shared_dir, stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def odd_docs(spark):
    """Nulls in every column, empty and white-space texts, repeated rows, and columns of clashing names."""
    rows = [(1, "one two three four five six seven", "en", "a", 1), (1, "one two three four five six seven", "en", "a", 1), (2, None, None, None, None), (None, "one two three four five six seven", "en", None, 3), (3, "", "en", "a", 0), (4, " \n\t ", "de", "b", 4), (5, "word " * 3000 + "\n" + "long " * 700, "en", "b", 9)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'x' as label", "1 as score", "2 as taken", "3 as rank", "4 as bucket", "5 as component", "6 as features", "7 as word", "8 as line")


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda x: (x is None, x))


ODD_IDS = [1, 1, 2, 3, 4, 5, None]


# 1

PAGES = [
    ("<html><body><nav><a href='/'>Home page and much more</a></nav><article><h1>Title &amp; more</h1><p>First\n  paragraph<br>goes&nbsp;on.<p>Second <b>bold</b>ly.</article><footer>Copyright words here</footer></body></html>", "Title & more\n\nFirst paragraph goes on.\n\nSecond boldly."),
    ("<body><div class='menu'><a>One</a><a>Two</a></div><div><p>A paragraph of the text that is long enough to be the main text of the page.</p><p>Short.</p></div><div id=comments><p>A reader says that this is a very good text about something.</p></div><aside>Beside it there is a box with words</aside>", "A paragraph of the text that is long enough to be the main text of the page.\n\nShort."),
    ("<article>Before<script>var a='<p>no</p>';</script><div class=\"ad box\">Buy <div>this</div> now</div> after<!-- a <b>comment --><form><input>Name</form></article>", "Before\n\nafter"),
    ("plain text without any markup that stands alone", "plain text without any markup that stands alone"),
    ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<div class=ad>never closed<article><p>The article is here.</p></article>", "The article is here."),
    ("<script>only script", ""), ("", ""), (None, ""), ("<p>1 < 2 &lt; 3 &bogus; &#233;</p>" + "<p>More text that makes the stretch a heavy one.</p>", "1 < 2 < 3 &bogus; é\n\nMore text that makes the stretch a heavy one."),
]


def test_html_blocks_cases():
    for page, text in PAGES:
        assert html_blocks.main_text(page) == text


def test_html_blocks_articles_beside_the_text():
    text = "The main text of this page stands in an element of no special kind. " * 4
    main = f"<div><p>{text}</p></div>"
    want = text.strip()
    said = "<p>A reader says that this is a very good text about something.</p>"
    pages = [f"{main}<section id=comments><article>{said}</article><article>{said}</article></section>", f"{main}<article class='comment'>{said}</article>", f"{main}<aside><article>{said}</article></aside>", f"<main class='site-main no-sidebar'><p>{text}</p></main>", f"<div class='content has-sidebar'><p>{text}</p></div>", f"{main}<div class='post-comments'>{said}</div>"]
    assert [html_blocks.main_text(p) for p in pages] == [want] * len(pages)
    teaser = f"{main}<article><p>Read on elsewhere.</p></article>"
    assert html_blocks.main_text(teaser) == want + "\n\nRead on elsewhere."


def test_html_blocks_on_pages(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r.page_id: r for r in html_blocks.extract(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        import html

        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_blocks.extract(odd.selectExpr("*", "1 as text")).collect()) == ["", "", ""]
    assert html_blocks.extract(odd.limit(0)).count() == 0


# 2


def test_langid(spark, sf):
    docs = table(spark, sf, "documents")
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in out.items() if r.held_out} == set(held)
    assert sum(out[i].lang_pred == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    odd = langid.identify(odd_docs(spark))
    assert ids(odd) == ODD_IDS
    assert {(r.doc_id, r.lang_pred, r.score) for r in odd.collect() if r.doc_id in (2, 3, 4)} == {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0)}
    assert langid.identify(docs.limit(0)).count() == 0
    nothing = langid.identify(docs.limit(3).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


# 3


def test_rabitq(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((1500, 70)).astype(np.float32)
    v[700:760] = v[5]
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)]
    bad = [(2000, None), (2100, [0.0] * 70), (2200, [float("nan")] * 70), (2300, [1.0, None] * 35), (None, [1.0] * 70), (2400, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    out = rabitq.search(df, df.where("vec_id % 100 = 0"), k=10, block_rows=400, query_rows=6).collect()
    by = defaultdict(dict)
    for x in out:
        by[x.query_id][x["rank"]] = x
    assert sorted(by) == list(range(0, 1500, 100))
    hits = 0
    for q, got in by.items():
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        assert sorted(got) == list(range(1, 11))
        hits += len({got[i].vec_id for i in got} & set(best.tolist()))
        for x in got.values():
            assert x.score == pytest.approx(d[x.vec_id], abs=1e-12)
        assert [(got[i].score, got[i].vec_id) for i in range(1, 11)] == sorted((x.score, x.vec_id) for x in got.values())
    assert hits / (10 * len(by)) >= 0.97
    twice = df.unionByName(df.where("vec_id % 100 = 0 or vec_id < 50"))
    again = rabitq.search(twice, twice.where("vec_id % 100 = 0"), k=10, block_rows=400, query_rows=6).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id) for x in again) == sorted((x.query_id, x["rank"], x.vec_id) for x in out)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert rabitq.search(few, few.where("vec_id = 0")).count() == 2
    assert rabitq.search(few.limit(0), few).count() == 0
    assert rabitq.search(few, few.limit(0)).count() == 0


def test_rabitq_lengths_and_ties(spark):
    """Vectors of several lengths, equal distances and columns with other operators' names, against all pairs of one length."""
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-2, 3, (1, 2, 3, 9)[i % 4])]) for i in range(0, 400)]
    rows = [(i, v) for i, v in rows if any(v)] + [(999, [1.0] * 5), (1000, [1.0] * 6), (1001, [2.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    named = df.selectExpr("vec_id", "embedding", "'x' as dim", "1 as rows", "2 as q", "3 as v", "4 as score")
    got = rabitq.search(named, named.where("vec_id % 10 = 0 or vec_id in (1, 3, 999)"), k=10, block_rows=30, query_rows=7).collect()
    want, known = {}, dict(rows)
    for q, x in rows:
        if q % 10 == 0 or q in (1, 3, 999):
            found = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in rows if i != q and len(y) == len(x))[:10]
            want |= {(q, n + 1): f for n, f in enumerate(found)}
    assert {(x.query_id, x["rank"]): x.score for x in got} == pytest.approx({key: d for key, (d, _) in want.items()}, abs=1e-12)
    assert all(len(known[x.query_id]) == len(known[x.vec_id]) for x in got) and (999, 1) not in want and want[(1000, 1)][1] == 1001
    hits = sum(x.vec_id == want[(x.query_id, x["rank"])][1] for x in got)
    assert hits / len(want) >= 0.97  # ties go to the smaller id


@pytest.mark.parametrize("dim", [64, 70, 128, 384])
def test_rabitq_aligned_rows(spark, dim):
    """Near vectors share most bits with a query: clusters, copies, two far groups, rows of two ranks, lengths of many scales."""
    r = np.random.default_rng(3)
    g, n = r.standard_normal, 1000
    kinds = (g((n // 20, dim)).repeat(20, 0) + 0.1 * g((n, dim)), g((n // 40, dim)).repeat(40, 0), np.where(np.arange(n)[:, None] % 2, 1e4, -1e4) + g((n, dim)), g((n, 2)) @ g((2, dim)), g((n, dim)) * np.exp(3 * g((n, 1))))
    for v in (x.astype(np.float32).astype(float) for x in kinds):
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
        by = defaultdict(list)
        for x in rabitq.search(df, df.where("vec_id % 100 = 0"), block_rows=400).collect():
            by[x.query_id].append(x.vec_id)
        hits = 0
        for q in range(0, n, 100):
            d = np.sqrt(((v - v[q]) ** 2).sum(1))
            d[q] = np.inf
            hits += len(set(by[q]) & set(np.lexsort((np.arange(n), d))[:10].tolist()))
        assert hits / (10 * len(range(0, n, 100))) >= 0.97


def test_rabitq_repeated_ids_and_wide_numbers(spark):
    """Ids with many vectors don't crowd out others, squares may overflow, and whole numbers keep all their figures."""
    r = np.random.default_rng(4)
    rows = [(0, [1.0] * 8)] + [(1, (1 + 0.01 * r.standard_normal(8)).tolist()) for _ in range(50)] + [(i, (1 + i * r.random(8)).tolist()) for i in range(2, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best = defaultdict(lambda: np.inf)
    for i, x in rows[1:]:
        best[i] = min(best[i], float(np.sqrt(((np.array(x) - 1) ** 2).sum())))
    got = rabitq.search(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [x.vec_id for x in got] == sorted(best, key=best.get)[:10]
    huge = spark.createDataFrame([(i, [1e200 * (i + 1), 1.0]) for i in range(5)] + [(i, [float(i), 2.0]) for i in range(5, 20)], "vec_id long, embedding array<double>")
    assert [x.vec_id for x in rabitq.search(huge, huge.where("vec_id = 10"), k=4).orderBy("rank").collect()] == [9, 11, 8, 12]
    whole = spark.createDataFrame([(i, [2**40 + i, 1]) for i in range(5)], "vec_id long, embedding array<long>")
    assert [(x.vec_id, x.score) for x in rabitq.search(whole, whole.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]


# 4


def test_separator_scan(spark, sf, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(separator_scan.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    encoder = tiktoken.Encoding("own", pat_str=separator_scan.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, sf, "documents")
    separator_scan.write_token_files(docs, str(tmp_path / "a"), file_records=70)
    for block in (17, 1000, 1 << 18):
        found = separator_scan.with_ids(separator_scan.scan(spark, str(tmp_path / "a"), head=6, block_tokens=block)).collect()
        assert {r.doc_id: r.n_tokens for r in found} == {r.doc_id: len(encoder.encode_ordinary(r.text)) for r in docs.collect()}
    separator_scan.write_token_files(odd_docs(spark), str(tmp_path / "b"))
    odd = separator_scan.with_ids(separator_scan.scan(spark, str(tmp_path / "b"), head=6)).collect()
    assert sorted(r.doc_id for r in odd) == [1, 1, 2, 3, 4, 5]
    assert {r.n_tokens for r in odd if r.doc_id in (2, 3)} == {0}
    separator_scan.write_token_files(spark.createDataFrame([(-(10**18), "x"), (2**62, "y")], "doc_id long, text string"), str(tmp_path / "c"))
    assert sorted(r.doc_id for r in separator_scan.with_ids(separator_scan.scan(spark, str(tmp_path / "c"), head=6)).collect()) == [-(10**18), 2**62]


def test_segments_prefix():
    tokens = np.array([1, 2, 9, 9, 3, 9, 4, 5], np.uint16)
    for block in range(1, 10):
        pieces = [x for _, n, closed, _, _ in separator_scan.segments(tokens, 9, 0, block) for x in zip(n.tolist(), closed.tolist(), strict=True)]
        done, current = [], 0
        for n, closed in pieces:
            current += n
            if closed:
                done.append(current)
                current = 0
        assert [*done, current] == [2, 0, 1, 2]


# 5


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(docs):
    occurrences = defaultdict(list)
    for i, text in docs:
        for no, line in enumerate((text or "").split("\n")):
            norm = " ".join(x for x in re.split("[\\x00-/:-@\\[-`{-\\x7f]+", line.lower()) if x)
            if len(norm.split()) >= 5:
                occurrences[norm].append((i, no))
    lines = sorted(occurrences)
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(lines)):
        for y in range(x):
            most = int(0.1 * max(len(lines[x]), len(lines[y])) + 1e-9)
            shared = sum((Counter(lines[x]) & Counter(lines[y])).values())
            if max(len(lines[x]), len(lines[y])) - shared <= most and edit(lines[x], lines[y]) <= most:
                parent[find(x)] = find(y)
    groups = defaultdict(list)
    for k, x in enumerate(lines):
        groups[find(k)] += occurrences[x]
    return {o for g in groups.values() for o in set(g) - {min(g)}}


def test_stored_leaves_no_shuffle_files(spark):
    """The shuffle files of what is stored go with its query, not with the driver's next collection; the setting is as before."""
    def shuffled():
        tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for top in tops for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    was, before = spark.conf.get(SHUFFLE_CLEANUP), shuffled()
    counts = spark.range(100000).groupBy((F.col("id") % 1000).alias("k")).count()
    out, _ = stored(counts, "counts")
    deadline = time.time() + 30  # they go in the background
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(SHUFFLE_CLEANUP) == was
    assert out.count() == 1000


def test_line_dedup_leaves_no_scratch(spark):
    """What only one step reads is deleted after it; what is returned can still be read."""
    base = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    text = "many words of this line come again in another document of the table with a few edits"
    docs = spark.createDataFrame([(1, text), (2, text.replace("many", "most")), (3, "a line that is nowhere else in all of these documents")], "doc_id long, text string")
    rows = {r.doc_id: r.n_dropped for r in line_dedup.report(docs).collect()}
    assert rows == {1: 0, 2: 1, 3: 0}
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before if x.startswith("line-")}
    assert left <= {"line-groups", "line-drops", "line-repeated"}


def test_line_dedup_pairs_meet_once(spark):
    """Lines that share several buckets make one pair, not one a bucket, and none if the bounds of one bucket rule it out."""
    rows = []
    for y, part, buckets in ((1, 1, (10, 20, 30)), (2, 2, (10, 20, 30)), (3, 3, (20, 30)), (4, 4, (40,)), (5, 5, (40,))):
        rows += [(k, part, 2 if k < 40 else 4, 90 if y == 5 else 0, 1 << 30 if y != 4 else 0, y, None, 100, list(buckets)) for k in buckets]
    known = spark.createDataFrame(rows, "bucket long, part long, main long, least int, upmost int, y long, y_code long, y_chars int, y_in array<long>")
    assert sorted((r.a, r.b) for r in line_dedup.pairs_across(known, 0.9).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_line_dedup_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(20, 60))) for _ in range(60)]

    def change(line):
        w = line.split()
        if r.random() < 0.6:
            w[r.randrange(len(w))] = r.choice(vocabulary)
        return " ".join(w).capitalize() + r.choice(["", ".", "!"])

    docs = [(i, "\n".join([change(r.choice(lines)) for _ in range(4)] + ["Short one", "", "ok"])) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x.doc_id, n) for x in line_dedup.report(df).collect() for n in x.dropped}
    want = brute_lines(docs)
    assert want and got == want
    cleaned = {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()}
    for i, text in docs:
        kept = [x for n, x in enumerate(text.split("\n")) if (i, n) not in want]
        if any(len(x.split()) >= 5 for x in kept):
            assert cleaned[i] == "\n".join(kept)
        else:
            assert i not in cleaned


def edited(r, words, vocabulary, changes):
    """A line with words replaced, put in or left out, of edit similarity 0.9 or more; None if that fails."""
    out = list(words)
    for _ in range(changes):
        at = r.randrange(len(out))
        out[at : at + 1] = r.choice(([r.choice(vocabulary)], [out[at], r.choice(vocabulary)], []))
    a, b = " ".join(words), " ".join(out)
    return b if a != b and edit(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9) else None


@pytest.mark.parametrize(("changes", "sizes"), [(1, (5, 8, 12, 16, 25, 40, 60, 100)), (2, (16, 25, 40, 60, 100)), (4, (60, 100, 300))])
def test_line_dedup_recall(spark, changes, sizes):
    """Lines of edit similarity 0.9 or more are linked, whatever their length: each size at least 0.9."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    docs, pairs = [], defaultdict(list)
    for size in sizes:
        while len(pairs[size]) < 30:
            words = r.choices(vocabulary, [1 / (i + 5) for i in range(3000)], k=size)
            if other := edited(r, words, vocabulary, changes):
                pairs[size].append(len(docs))
                docs += [(len(docs), " ".join(words)), (len(docs) + 1, other)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lines = line_dedup.sketches(df, 2).cache()
    part = {x.line: x.part for x in line_dedup.line_groups(df, lines).collect()}
    line = {x.doc_id: x.line for x in lines.collect()}
    for size, firsts in pairs.items():
        found = sum(line[i] == line[i + 1] or part.get(line[i], -1) == part.get(line[i + 1], -2) for i in firsts)
        assert found >= 0.9 * len(firsts), (size, found)


def test_line_edits(spark):
    """Edits are bound by the length alone; words that both lines share at the ends do not change them."""
    r = random.Random(1)
    texts, pairs = {}, []
    for k in range(0, 300, 2):
        a = [r.choice(["ab", "abc", "a", "bcd", "xyz", "q"]) for _ in range(r.randint(1, 30))]
        b = [*a]
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(b))
            b[at : at + 1] = r.choice((["zz"], [b[at], "k"], [b[at]]))
        texts[k], texts[k + 1] = " ".join(a), " ".join(b)
        pairs.append((k, k + 1))
    base = " ".join(f"w{i % 97}x{i % 89}" for i in range(480))
    texts[1000], texts[1001] = base, base[:-1600] + base[-1600:].replace("x", "y").replace("w1", "u1")
    pairs.append((1000, 1001))
    got = {(x.a, x.b): x.edits for x in line_dedup.edits(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(list(texts.items()), "line long, norm string"), 0.9).collect()}
    for a, b in pairs:
        most, n = int(0.1 * max(len(texts[a]), len(texts[b])) + 1e-9), edit(texts[a], texts[b])
        assert got.get((a, b)) == (n if n <= most else None)
    assert got[1000, 1001] > 200


def test_line_dedup_repeated_ids(spark):
    """Rows of one doc_id and different texts are documents of their own; of equal rows one stays."""
    once, more = "another totally different line of seven words", "keep this line as it stands alone here"
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (7, f"alpha beta gamma delta epsilon zeta\n{more}"), (7, f"{once}\nmore"), (9, "a row that is there two times over"), (9, "a row that is there two times over")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in line_dedup.dedup_lines(df).collect()) == sorted([rows[0], (7, more), (7, f"{once}\nmore"), rows[3]])
    assert sorted((x.doc_id, x.n_dropped, x.gone) for x in line_dedup.report(df).collect()) == [(1, 0, False), (7, 0, False), (7, 1, False), (9, 0, False), (9, 1, True)]


def test_line_dedup_odd(spark):
    odd = line_dedup.dedup_lines(odd_docs(spark))
    assert odd.columns == odd_docs(spark).columns
    assert ids(odd) == [1, 2, 3, 4, 5, None]
    assert line_dedup.dedup_lines(odd_docs(spark).limit(0)).count() == 0
    two = spark.createDataFrame([(7, "a b c d e f\nunique words stand here alone now"), (3, "A b, c d e f!"), (9, "a b c d e f")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(two).collect()} == {3: "A b, c d e f!", 7: "unique words stand here alone now"}


# 6


def test_toxicity(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r.held_out} == set(held)
    good = [out[i].score for i in held if truth.get(i) == 1]
    rest = [out[i].score for i in held if truth.get(i) == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in rest) / (len(good) * len(rest))
    assert auc > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    odd = toxicity.score(odd_docs(spark), labels.limit(0))
    assert ids(odd) == ODD_IDS and {r.score for r in odd.collect()} == {0.0}
    model = toxicity.train(docs, labels)
    assert ids(toxicity.scored(odd_docs(spark), model)) == ODD_IDS
    assert toxicity.scored(odd_docs(spark).limit(0), model).count() == 0


# 7


def test_decontaminate(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    out = {r.doc_id: r for r in decontaminate.matches(docs, items).collect()}
    texts = {r.item_id: " ".join(r.text.lower().split()) for r in items.collect()}
    for r in docs.collect():
        flat = " ".join(r.text.lower().split())
        assert {i for i, t in texts.items() if t in flat} <= set(out[r.doc_id].item_ids)
    odd = decontaminate.matches(odd_docs(spark), items)
    assert ids(odd) == ODD_IDS and not any(r.contaminated for r in odd.collect())
    assert decontaminate.matches(docs.limit(0), items).count() == 0
    assert decontaminate.matches(docs.limit(5), items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(odd_docs(spark), items).columns == odd_docs(spark).columns


def test_retrieval_finds_all_above_threshold(spark, sf, monkeypatch):
    items = table(spark, sf, "benchmark")
    index = next(decontaminate._shards(items, 0.3))
    half = index.width // 2
    for r in table(spark, sf, "documents").limit(60).collect():
        w = decontaminate.words(r.text)
        want = set()
        for p in range(1 + max(0, -(-(len(w) - index.width) // half))):
            seen = set(w[p * half : p * half + index.width])
            want |= {(p, i) for i, item in enumerate(index.items) if sum(x for t, x in item.items() if t in seen) >= 0.3}
        assert {(p, i) for p, i, _ in decontaminate.retrieve(w, index)} == want
    monkeypatch.setattr(decontaminate, "SHARD_POSTINGS", 300)
    whole = {r.doc_id: r.item_ids for r in decontaminate.matches(table(spark, sf, "documents"), items).collect()}
    assert len(list(decontaminate._shards(items, 0.5))) > 2
    assert sum(map(bool, whole.values())) > 0


# 8


def test_arc_round_trip(spark, sf, tmp_path):
    pages = table(spark, sf, "pages").select("page_id", "url", "html").collect()
    long = "<p>" + "é text " * 300
    rows = [tuple(r) for r in pages] + [(1000, "http://a b/ü", long), (1005, None, long), (1003, "http://c/\n", long), (1006, "x", None), (1007, "x", ""), (1008, "x", "short"), (1009, "y", "short"), (None, "z", long), (1010, "w", "WARC/1.1\r\n\r\nfiledesc://x\n" + long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    arc_convert.write_arc(df, str(tmp_path / "arc"), file_records=20)
    back = arc_convert.read_arc(spark, str(tmp_path / "arc")).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in back) == Counter((i, (h or "").encode()) for i, _, h in rows)
    arc_convert.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), file_records=30)
    got = {r.page_id: r for r in arc_convert.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        assert got[i].payload_bytes == len((h or "").encode()) and got[i].payload_digest == hashlib.sha1((h or "").encode()).hexdigest()
    assert {i: (got[i].record_type, got[i].refers_to) for i in (1000, 1003, 1005, 1006, 1007, 1008, 1009, None)} == {1000: ("revisit", 1005), 1003: ("revisit", 1005), 1005: ("response", None), 1006: ("response", None), 1007: ("response", None), 1008: ("response", None), 1009: ("response", None), None: ("response", None)}


def test_arc_errors():
    with pytest.raises(ValueError, match="cut off"):
        list(arc_convert.arc_records(b"http://a 1.1.1.1 20240101000000 text/html 50\nshort"))
    v2 = b"filedesc://a 0.0.0.0 20240101000000 text/plain 200 - - 0 a 76\n" + b"2 0 x\nURL IP-address Archive-date Content-type Result-code Checksum Loc\n".ljust(76, b" ")
    assert list(arc_convert.arc_records(v2 + b"\nu 1.1.1.1 20240101000000 text/html 200 - - 0 a 3\nabc\n"))[0][1] == b"abc"


# 9


def test_fair_mix(spark, sf):
    docs = table(spark, sf, "documents")
    out = fair_mix.mix(docs, bucket_rows=7).collect()
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in out} == sizes
    by = defaultdict(list)
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source].append(r)
    total = sum(sizes.values())
    names, weights = sorted(by), {}
    for i, s in enumerate(names):
        weights[s] = (5, 2, 1)[i % 3]
    cap = {s: 2 * sum(r["size"] for r in by[s]) for s in names}
    target, budget, left = {}, 1.5 * total, set(names)
    while left:
        share = budget / sum(weights[s] for s in left)
        full = {s for s in left if weights[s] * share > cap[s]}
        if not full:
            target |= {s: weights[s] * share for s in left}
            break
        target |= {s: cap[s] for s in full}
        budget -= sum(cap[s] for s in full)
        left -= full
    for s in names:
        assert by[s][0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= 1
    assert sorted(map(tuple, fair_mix.mix(docs, bucket_rows=500).select("doc_id", "target").collect())) == sorted((r.doc_id, r.target) for r in out)
    assert sorted(map(tuple, fair_mix.mix(docs.repartition(3), bucket_rows=7).collect())) == sorted(map(tuple, out))


def test_fair_mix_odd(spark):
    out = fair_mix.mix(odd_docs(spark)).collect()
    assert len(out) == 7
    assert {(r.source, r.source_size) for r in out} == {("a", 14), ("b", 3700), (None, 7)}
    assert fair_mix.mix(odd_docs(spark).limit(0)).count() == 0


# 10


def brute_components(docs, percent=75):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for a in names:
        for b in names:
            if b < a and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)]
    docs, base = [], []
    for _ in range(12):
        base.append([r.choice(vocabulary) for _ in range(r.randint(3, 150))])
    for i in range(240):
        w = list(base[0] if i < 120 else r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append((i * 7 % 1000, " ".join(w).upper() if i % 3 else "\t".join(w)))
    out = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_components(docs)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)
    kept = near_dup.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert ids(kept) == sorted({c for _, c in want.values()})


def test_possible_with_repeated_rows(spark):
    """Every similar pair is possible, however often the rows of a document are repeated, and whatever their case."""
    r = random.Random(8)
    docs = []
    for i in range(0, 40, 2):
        w = [f"w{i}x{k}" for k in range(100)]
        x = [*w]
        x[20], x[70] = "other", "another"
        docs += [(i, " ".join(w)), (i + 1, " ".join(x))]
    want = {(i, i + 1) for i in range(0, 40, 2)}
    assert {(i, c) for i, (_, c) in brute_components(docs).items() if i != c} == {(b, a) for a, b in want}
    rows = [(i, t.upper() if k % 2 and i % 4 else t) for i, t in docs for k in range(r.randint(3, 6) if i % 2 == 0 else 1)]
    members = spark.createDataFrame([(i, i, True) for i, _ in docs], "rep long, part long, outside boolean")
    got = {(x.a, x.b) for x in near_dup.possible(members, spark.createDataFrame(rows, "doc_id long, text string"), 75).collect()}
    assert got == want


def test_near_duplicates_odd(spark):
    out = near_dup.near_duplicates(odd_docs(spark)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True)]
    assert near_dup.near_duplicates(odd_docs(spark).limit(0)).count() == 0
    again = spark.createDataFrame([(5, "a b c d e f"), (2, "p q r s t u"), (5, "p q r s t u"), (9, "a b c d e f")], "doc_id long, text string")
    assert {r.component_id for r in near_dup.near_duplicates(again).collect()} == {2}


def test_row_kept_of_a_shared_id(spark):
    """Of rows that share an id the same one stays, however the rows are dealt; null ids stay."""
    rows = [(1, "a b c d e f g", "x"), (1, "quite another text of seven words here", "y"), (1, "a b c d e f g", "z"), (None, "a b c d e f g", "n"), (2, None, "q")]
    kept = [sorted(map(str, near_dup.drop_near_duplicates(spark.createDataFrame(r, "doc_id long, text string, source string").repartition(n)).collect())) for r, n in ((rows, 1), (rows[::-1], 4))]
    assert kept[0] == kept[1] and len(kept[0]) == 3


def test_least_matches():
    assert near_dup.least_matches(128, 0.75, 1e-6) < 96 < near_dup.least_matches(128, 0.75, 0.6)
    assert near_dup.least_matches(16, 0.75, 1e-9) == 1


# the pipeline


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        out = stage(spark, docs.limit(60), sf)
        assert i == 3 or out.columns == columns
    assert corpus_pipeline.run(spark, sf).where("taken > 0").count() > 50


def test_html_blocks_time_is_linear():
    import time

    began = time.process_time()
    for part in ("<aside><article>", "<svg>", "<div class=ad><article>", "<nav>x", "<select>", "<!--", "<a b='"):
        html_blocks.main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 20


def test_langid_fits_a_bounded_sample(spark, monkeypatch):
    rows = [(i, f"das ist ein Satz mit der Nummer {i} und mehr", "de") for i in range(9)] + [(77, f"this is a sentence and that is number {i}", "en") for i in range(150)] + [(78, "the same row again and again", "en")] * 150
    fitted = []
    fit = langid._ftrl
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 2)
    monkeypatch.setattr(langid, "_ftrl", lambda some, *a: fitted.append(len(some)) or fit(some, *a))
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"] and fitted[0] <= 4
