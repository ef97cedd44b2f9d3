"""Periodic runs of words: Lyndon arrays under both orders from suffix grouping, roots extended into runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of cutting at rare words; more rounds would only save time, as what is left is searched in full.
CUTS = 8
#: Documents that are cut at rare words together.
TOGETHER = 500


def lyndon_groups(codes: Sequence[int]) -> tuple[list[int], list[int]]:
    """For each place the length of the longest Lyndon word that begins there, and the number of its group.

    codes: small whole numbers; the smaller is the lower letter, and the end is lower than all. Places are in one
    group exactly if their longest Lyndon words are equal.

    This is phase one of the suffix sorter that groups suffixes. They start grouped by first letter, and groups are
    taken from the highest down. Each suffix of the group points to the nearest suffix to its left that no group
    taken so far holds. A suffix pointed to has one copy of the group's word after its own for each pointer. Those
    that gain equally many copies leave their group for a new one right above it, more copies higher, and their word
    grows by them. A suffix points once, so the work is linear.
    """
    n, top = len(codes), max(codes, default=0)
    members: list[list[int]] = [[] for _ in range(top + 1)]
    for place, code in enumerate(codes):
        members[code].append(place)
    below, above = list(range(-1, top)), list(range(1, top + 2))
    group, length = list(codes), [1] * n
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))  # neighbours among the suffixes not taken yet
    now = top
    while now >= 0:
        points: list[int] = []
        word = 0
        for s in members[now]:  # in order of place, so equal pointers follow one another
            if group[s] == now:
                before, after = left[s], right[s]
                if after < n:
                    left[after] = before
                if before >= 0:
                    right[before] = after
                    points.append(before)
                word = length[s]
        copies: dict[int, list[int]] = {}
        at = 0
        while at < len(points):
            p, stop = points[at], at + 1
            while stop < len(points) and points[stop] == p:
                stop += 1
            copies.setdefault(stop - at, []).append(p)
            at = stop
        for times in sorted(copies, reverse=True):
            fresh: dict[int, int] = {}  # a group, and the new one above it
            for p in copies[times]:
                old = group[p]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(members)
                    members.append([])
                    below.append(old)
                    above.append(above[old])
                    below[above[old]] = new
                    above[old] = new
                members[new].append(p)
                group[p] = new
                length[p] += times * word
        now = below[now]
    return length, group


def common_prefix(x: np.ndarray, y: np.ndarray) -> int:
    """How many letters x and y have in common from their start; blocks that double are compared at once."""
    n, at, step = min(len(x), len(y)), 0, 16
    while at < n:
        odd = np.flatnonzero(x[at : min(at + step, n)] != y[at : min(at + step, n)])
        if len(odd):
            return at + int(odd[0])
        at, step = at + step, 2 * step
    return n


def runs_of(codes: np.ndarray, min_exponent: int = 2, min_length: int = 2) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a sequence, in order of start and period.

    A run has a smallest period, is at least min_exponent (2 or more) periods and min_length letters long, and can't
    be extended with its period. Under one of the two orders of the alphabet, every Lyndon root in a run is the
    longest Lyndon word at its place, so the first root of each chain of equal groups, a word's length apart,
    stands for the run. The common extensions to the left and to the right of the chain give its borders.
    """
    codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    n, found = len(codes), set()
    for order in (codes, codes.max(initial=0) - codes):
        length, group = (np.array(x, np.int64) for x in lyndon_groups(order.tolist()))
        after = np.arange(n) + length
        linked = np.zeros(n, bool)
        inside = np.flatnonzero(after < n)
        linked[inside] = group[after[inside]] == group[inside]
        first = np.ones(n, bool)
        first[after[linked]] = False
        roots = np.flatnonzero(first)
        ahead = roots
        for _ in range(min_exponent - 2):  # a run holds at least min_exponent - 1 roots in full
            roots, ahead = roots[linked[ahead]], after[ahead[linked[ahead]]]
        for start in roots.tolist():
            period, stop = int(length[start]), int(after[start])
            while linked[stop - period]:
                stop += period
            stop += common_prefix(codes[stop:], codes[stop - period :])
            begin = start - common_prefix(codes[:start][::-1], codes[: start + period][::-1])
            if stop - begin >= max(min_length, min_exponent * period):
                found.add((begin, stop - begin, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, owner: np.ndarray, copies: int, least: int) -> list[tuple[int, int]]:
    """(start, stop) of the stretches of one owner that can hold a run of `copies` periods and `least` letters.

    A letter of such a run occurs `copies` times or more between any two letters that no run holds. So letters that
    are rarer in their stretch cut it, as often as that shortens any, CUTS times at most.
    """
    place, part = np.arange(len(codes)), owner
    for _ in range(CUTS):
        key = pd.factorize(part.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes[place])[0]
        keep = np.bincount(key)[key] >= copies if len(key) else np.zeros(0, bool)
        kept, of = place[keep], part[keep]
        if not len(kept):
            return []
        new = np.concatenate([[True], (np.diff(kept) != 1) | (np.diff(of) != 0)])
        part = np.cumsum(new) - 1
        size = np.bincount(part)
        long_enough = size[part] >= least
        before, place, part = len(place), kept[long_enough], part[long_enough]
        if len(place) == before or not len(place):
            break
    if not len(place):
        return []
    new = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(part) != 0)])
    starts = np.flatnonzero(new)
    stops = np.concatenate([starts[1:], [len(place)]]) - 1
    return [(int(place[a]), int(place[b]) + 1) for a, b in zip(starts, stops, strict=True)]


def find(docs: DataFrame, min_exponent: int = 4, min_length: int = 6) -> DataFrame:
    """Runs of words of every row of docs(doc_id, text): doc_id, n_words, runs (start, length, period, by start and period), collapsed.

    Words are runs of characters other than the six ASCII white-space characters, numbered from 0. A run repeats its
    first `period` words, at least min_exponent periods and min_length words in all, and no neighbour extends it.
    collapsed has the text's words joined by one space, without those that a run holds after its first period.

    Whole texts are searched, of any length, each in the task that reads it. Null and empty texts have no words, no
    runs and an empty collapsed text. Rows with null or repeated doc_id are rows of their own; other columns are
    ignored; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def of_some(texts: list[str | None]) -> tuple[list, list, list]:
        words = [(t or "").encode().split() for t in texts]  # bytes split at the six ASCII characters alone
        sizes = np.array([len(w) for w in words])
        begin = np.cumsum(sizes) - sizes
        number: dict[bytes, int] = {}
        codes = np.array([number.setdefault(w, len(number)) for part in words for w in part], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        runs: list[list[dict]] = [[] for _ in texts]
        for start, stop in stretches(codes, owner, min_exponent, max(min_length, min_exponent)):
            no = int(owner[start])
            runs[no] += [{"start": start - int(begin[no]) + s, "length": n, "period": p} for s, n, p in runs_of(codes[start:stop], min_exponent, min_length)]
        kept = []
        for part, found in zip(words, runs, strict=True):
            if found:
                change = np.zeros(len(part) + 1, np.int64)
                for r in found:
                    change[r["start"] + r["period"]] += 1
                    change[r["start"] + r["length"]] -= 1
                part = [part[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
            kept.append(b" ".join(part).decode())
        return sizes.tolist(), runs, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, TOGETHER) for at in range(0, batch.num_rows, TOGETHER)):
                sizes, runs, kept = of_some(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.string())], names)

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """Numbers and digests of what `find` returns: doc_id, n_runs, start, length, period, exponent_milli of the longest run (ties: smallest start, then period; nulls without runs), runs_sha256 (of `start,length,period` and a line feed for each run), collapsed_sha256."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    shown = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return shown.select("doc_id", "n_runs", (-F.col("r.start")).alias("start"), F.col("r.length").alias("length"), (-F.col("r.period")).alias("period"), F.expr("(1000 * r.length) div -r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_periods(docs: DataFrame, share: int = 10) -> DataFrame:
    """doc_id and text of docs; one of `share` documents, by the CRC-32 h of its doc_id, ends in a periodic stretch.

    With n words, g = floor(h / share), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), word i from a on becomes
    word a + (i - a) % p. Other texts, and those with null doc_id or without words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    marked = docs.select("doc_id", "text", F.floor(h / share).alias("g"), F.when(h % share == 0, words).alias("w"))
    marked = marked.select("doc_id", "text", "g", "w", F.size("w").cast("long").alias("n")).withColumn("a", F.expr("case when n > 0 then g % n end"))
    place = "transform(sequence(0L, n - 1), i -> get(w, cast(if(i < a, i, a + (i - a) % (1 + (n - a) div (3 + g % 8))) as int)))"
    return marked.select("doc_id", F.expr(f"case when n > 0 then array_join({place}, ' ') else text end").alias("text"))
