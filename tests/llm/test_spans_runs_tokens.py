"""Personal data, periodic runs and cross-tokenizer alignment against brute force, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest

from quillspark.llm import cross_tokenizer, periodic_runs, personal_data, queries
from tests.llm.test_operators import ODD_IDS, ids, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def texts_of(spark, sf, n=None):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()][:n]


# 11


def base_spans(text):
    """The contract's rules by plain regular expressions."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(map(int, str(2 * x))) for i, x in enumerate(d[::-1]))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_plain_spans_on_random_texts():
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice("aB1.@+-_%() 0245,é\n") for _ in range(r.randint(0, 60)))
        assert personal_data.detect(text) == base_spans(text), text
    for text in ("4111 1111 1111 1111", "x4111-1111-1111-11112", "300.1.1.1 1.2.3.4.5.6.7.8", "+1 (743) 555-3824, +1 ((", "a@b.c@d.e", "a@@b.c x@y.z.", "0000.1.1.0001"):
        assert personal_data.detect(text) == base_spans(text)


DISGUISED = [
    ("write to bob.smith [at] mail3 [dot] example [dot] com now", "email", "bob.smith [at] mail3 [dot] example [dot] com"), ("bob at example dot com", "email", "bob at example dot com"), ("bob (at) example.com", "email", "bob (at) example.com"),
    ("say John dot Doe at mail dot example dot org.", "email", "John dot Doe at mail dot example dot org"), ("bob @ example . com", "email", "bob @ example . com"), ("x bоb@exаmple.com is here", "email", "bоb@exаmple.com"), ("ｂｏｂ＠example．com", "email", "ｂｏｂ＠example．com"),
    ("b​ob@exa\xadmple.com", "email", "b​ob@exa\xadmple.com"), ("bob&#64;example&#46;com", "email", "bob&#64;example&#46;com"), ("schreib bob at example punkt de", "email", "bob at example punkt de"),
    ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"), ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"), ("quatre un un un un un un un un un un un un un un un", "card", "quatre un un un un un un un un un un un un un un un"),
    ("call plus one five five five zero one nine nine one two three", "phone", "plus one five five five zero one nine nine one two three"), ("call + 1 (five five five) 555-0199 please", "phone", "+ 1 (five five five) 555-0199"), ("+1-8OO-555-Ol99 x", "phone", "+1-8OO-555-Ol99"), ("plus four four seven seven double zero nine zero zero one two three", "phone", "plus four four seven seven double zero nine zero zero one two three"),
    ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"), ("at 192[.]168[.]0[.]1 now", "ip", "192[.]168[.]0[.]1"), ("10 dot 0 dot 0 dot 7", "ip", "10 dot 0 dot 0 dot 7"),
]


@pytest.mark.parametrize("text, kind, found", DISGUISED)
def test_disguised_spans_map_back(text, kind, found):
    base, added = personal_data.spans(text)
    assert (base, [(k, text[a:b]) for k, a, b in added]) == ([], [(kind, found)])
    long = "Ünrelated prose, one of many. " * 20 + text + " and a@b.example too"
    base, added = personal_data.spans(long)
    assert [(k, long[a:b]) for k, a, b in base] == [("email", "a@b.example")]
    assert [(k, long[a:b]) for k, a, b in added] == [(kind, found)]


@pytest.mark.parametrize("text", ["meet me at noon.Then go", "look at example.com or at foo dot", "one two three four apples", "the dot product at the point of rest", "Номер сот, а не адрес", "он пришёл в 10.15 и ушёл", "version 1 dot 2 dot 3", "1O2 and 10l", "one in ten, two in five", "a, b [at] c", "@ home . com"])
def test_clean_texts_have_no_added_spans(text):
    assert personal_data.spans(text)[1] == []


def test_transducers_compose():
    t = personal_data.Transduced("abcdef")
    t.rewrite([(1, 2, "XX"), (3, 4, "")])  # aXXcef
    t.rewrite([(2, 3, "y"), (5, 6, "zz")])  # aXycezz
    assert t.text == "aXycezz"
    assert [t.source(i, i + 1) for i in range(7)] == [(0, 1, False), (1, 2, True), (1, 2, True), (2, 3, False), (4, 5, False), (5, 6, True), (5, 6, True)]
    assert t.source(3, 5) == (2, 5, True)


def test_personal_data_time_is_linear():
    import time

    began = time.process_time()
    for part in ("a", "1", "1 ", "a@", "+1 (", "a at a ", "a dot ", " ", "1.", "a at b dot ", "l1", "[ ", "а"):
        personal_data.spans(part * (300_000 // len(part)))
    assert time.process_time() - began < 30


def test_personal_data_query(spark, sf):
    got = {r.doc_id: r for r in queries.op11_personal_data(spark, sf).collect()}
    texts = texts_of(spark, sf)
    assert len(got) == len(texts)
    for i, text in texts:
        want = base_spans(text or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        assert set(said.split(",")) <= set(got[i].spans.split(","))


def test_personal_data_odd(spark):
    assert ids(personal_data.find(odd_docs(spark))) == ODD_IDS
    assert personal_data.report(personal_data.find(odd_docs(spark).limit(0))).count() == 0
    df = docs_of(spark, [None, "", "mail bob [at] example.com or a@b.example"])
    rows = {r.doc_id: r for r in personal_data.report(personal_data.find(df)).collect()}
    assert (rows[0].spans, rows[0].n_email, rows[0].base_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert (rows[2].spans, rows[2].n_email, rows[2].n_added) == ("email:5:25,email:29:40", 1, 1)
    assert {r.doc_id: r.text for r in personal_data.mask(df).collect()} == {0: None, 1: "", 2: "mail <email> or <email>"}


# 12


def smallest_period(s):
    f, k = [0] * len(s), 0
    for i in range(1, len(s)):
        while k and s[i] != s[k]:
            k = f[k - 1]
        k += s[i] == s[k]
        f[i] = k
    return len(s) - f[-1]


def brute_runs(s, exponent, least):
    out, n = set(), len(s)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and smallest_period(s[i : j + q]) == q:
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_with_repeats(r):
    n, k = r.randint(0, 60), r.randint(1, 5)
    s = [r.randrange(k) for _ in range(n)]
    if n and r.random() < 0.6:
        p = r.randint(1, 7)
        s = [s[i % p] if r.random() < 0.98 else s[i] for i in range(n)]
    return s


def test_lyndon_groups():
    r = random.Random(1)
    for _ in range(400):
        s = words_with_repeats(r)[:40]
        length, group = periodic_runs.lyndon_groups(s)
        want = [max(k for k in range(1, len(s) - i + 1) if all(s[i : i + k] < s[i + j : i + k] for j in range(1, k))) for i in range(len(s))]
        assert length == want
        words = [tuple(s[i : i + n]) for i, n in enumerate(length)]
        assert len(set(zip(words, group, strict=True))) == len(set(words)) == len(set(group))


def test_runs_against_brute_force():
    r = random.Random(2)
    for _ in range(1500):
        s = words_with_repeats(r)
        for exponent, least in ((2, 2), (3, 2), (4, 6), (5, 1)):
            assert periodic_runs.runs_of(np.array(s, np.int64), exponent, least) == brute_runs(s, exponent, least)


def test_stretches_hold_all_runs():
    r = random.Random(4)
    for _ in range(500):
        parts = [words_with_repeats(r) for _ in range(3)]
        owner = np.repeat(np.arange(3), [len(p) for p in parts])
        held = periodic_runs.stretches(np.array(sum(parts, []), np.int64), owner, 4, 6)
        begin = [0, len(parts[0]), len(parts[0]) + len(parts[1])]
        for no, part in enumerate(parts):
            for start, length, _ in brute_runs(part, 4, 6):
                assert any(a <= begin[no] + start and begin[no] + start + length <= b and owner[a] == owner[b - 1] for a, b in held)


def test_periodic_runs_query(spark, sf):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    texts = texts_of(spark, sf)
    assert len(got) == len(texts)
    for i, text in texts:
        words, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        elif n > 700:
            continue  # the brute force is quadratic
        runs = brute_runs(words, 4, 6) if n <= 700 else [(int(x), int(y), int(z)) for x, y, z in periodic_runs.runs_of(np.array([words.index(w) for w in words]), 4, 6)]
        kept = [w for j, w in enumerate(words) if not any(s + q <= j < s + length for s, length, q in runs)]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_periodic_runs_odd(spark):
    assert ids(periodic_runs.find(periodic_runs.with_planted_periods(odd_docs(spark)))) == ODD_IDS
    assert periodic_runs.report(periodic_runs.find(odd_docs(spark).limit(0))).count() == 0
    rows = {r.doc_id: r for r in periodic_runs.find(docs_of(spark, [None, "", "a b " * 50_000, "x y\x0bx y\tx\ny x y z", "no break " * 7])).collect()}
    assert [(rows[i].n_words, rows[i].runs, rows[i].collapsed) for i in (0, 1)] == [(0, [], "")] * 2
    assert [tuple(x) for x in rows[2].runs] == [(0, 100_000, 2)] and rows[2].collapsed == "a b"
    assert [tuple(x) for x in rows[3].runs] == [(0, 8, 2)] and rows[3].collapsed == "x y z"
    assert rows[4].n_words == 7 and rows[4].collapsed == "no break"


# 13


def brute_alignment(texts):
    """The contract by the libraries themselves, with no shortcut: one entry for every link."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(cross_tokenizer.BYTE_VOCABULARY)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=cross_tokenizer.PIECE_VOCABULARY)
    letters = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in letters)}
    groups_of, held = [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            ba = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
            bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                both = sorted(set(accumulate(map(len, ba))) & set(accumulate(map(len, bb))))
                ends = [list(accumulate(map(len, x))) for x in (ba, bb)]
                groups = [([i for i, e in zip(a, ends[0], strict=True) if lo < e <= hi], [i for i, e in zip(b, ends[1], strict=True) if lo < e <= hi]) for lo, hi in zip([0, *both], both)]  # noqa: B905
        groups_of.append(groups)
        held.update({(x, y) for xs, ys in groups for x in xs for y in ys})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for groups in groups_of:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        rows.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD_TEXTS = [None, "", " ", "a", " a  b ", "naïve café 日本語 🙂🙂🙂 मानक", "▁piece ▁ sign", "<s> </s> <unk> <|endoftext|> <0x41>", "tab\tnew\n\nline\r\n", "x" * 3000, "=-" * 1500, "🙂" * 500, "a\0b", " 　​﻿z", "don't we'll 12345678901", "ﬁ ﬀ ① Å Å é", "same text", "same text"]


def test_alignment_of_odd_texts(spark):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in cross_tokenizer.align(docs_of(spark, ODD_TEXTS)).collect()}
    assert [got[i] for i in range(len(ODD_TEXTS))] == brute_alignment(ODD_TEXTS)


def test_alignment_query(spark, sf, monkeypatch):
    monkeypatch.setattr(cross_tokenizer, "BLOCK_LINKS", 30_000)  # several blocks
    monkeypatch.setattr(cross_tokenizer, "EXPANDED", 200)
    texts = texts_of(spark, sf)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_cross_tokenizer(spark, sf).collect()}
    assert [got[i] for i, _ in texts] == brute_alignment([t for _, t in texts])


def test_linked_pairs_in_parts(monkeypatch):
    r = np.random.default_rng(1)
    a, b = r.integers(0, 9, 60), r.integers(0, 7, 80)
    stops_a, stops_b = np.array([1, 31, 60]), np.array([40, 41, 80])
    want = Counter(int(x) * cross_tokenizer.PAIR + int(y) for k in range(3) for x in a[[0, 1, 31][k] : stops_a[k]] for y in b[[0, 40, 41][k] : stops_b[k]])
    for most in (1, 50, 1000, 1 << 20):
        monkeypatch.setattr(cross_tokenizer, "EXPANDED", most)
        keys, times = cross_tokenizer.linked_pairs(a, b, stops_a, stops_b)
        assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == want and keys.tolist() == sorted(want)


def test_alignment_groups(spark):
    rows = {r.doc_id: r for r in cross_tokenizer.groups(docs_of(spark, ["plain words here", None])).collect()}
    t = cross_tokenizer.Tokenizers(cross_tokenizer.BYTE_VOCABULARY, cross_tokenizer.PIECE_VOCABULARY)
    r, i, j = rows[0], 0, 0
    for k, m in zip(r.stops_a, r.stops_b, strict=True):
        assert b"".join(t.bytes_a[x] for x in r.a[i:k]) == b"".join(t.bytes_b[y] for y in r.b[j:m])
        i, j = k, m
    assert (i, j) == (len(r.a), len(r.b)) and rows[1].a == []


def test_alignment_odd(spark):
    assert ids(cross_tokenizer.align(odd_docs(spark))) == ODD_IDS
    assert ids(cross_tokenizer.groups(odd_docs(spark))) == ODD_IDS
    assert cross_tokenizer.align(odd_docs(spark).limit(0)).count() == 0
