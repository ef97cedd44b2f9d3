"""Streams with state against plain loops, with rows out of order, late files and restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillspark.streaming import metrics as M
from quillspark.streaming import state as S

START = dt.datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event(i, seconds, kind="a", value=1.0, user=1):
    return (i, None if seconds is None else START + dt.timedelta(seconds=seconds), user, kind, value, None)


def arrive(spark, folder, no, rows):
    """A file of events that arrives after those of smaller numbers."""
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/new-{no}")
    part = next(p for p in (folder / f"new-{no}").iterdir() if p.suffix == ".parquet")
    (folder / "in").mkdir(exist_ok=True)
    part.rename(folder / "in" / f"{no:03}.parquet")


def source(spark, folder):
    return S.events_of(spark, str(folder / "in"), M.EVENTS, files=1)


def test_minute_ring_with_restart(spark, tmp_path):
    r = random.Random(3)
    files, n = [], 0
    for f in range(4):
        files.append([event(n + i, 60 * (120 * f + r.randrange(130)), r.choice(["a", "b", None]), r.choice([None, 0.1, 2.5])) for i in range(60)] + [event(n + 60, None)])
        n += 61
    late = event(n, 60)  # a day's start, after its watermark
    files.append([late, event(n + 1, 60 * 700)])
    for no, rows in enumerate(files[:2]):
        arrive(spark, tmp_path, no, rows)
    first = S.run(S.minute_ring(source(spark, tmp_path), size=30), str(tmp_path / "out")).count()
    for no, rows in enumerate(files[2:]):
        arrive(spark, tmp_path, no + 2, rows)
    got = [tuple(x) for x in S.run(S.minute_ring(source(spark, tmp_path), size=30), str(tmp_path / "out")).collect()]  # a new query with the old state
    assert 0 < first < len(got)
    minutes, last = {}, (START + dt.timedelta(minutes=700)) - dt.timedelta(minutes=10)
    high = None
    for rows in files:  # a minute takes rows until the watermark has passed its end
        bound = None if high is None else high - dt.timedelta(minutes=10)
        for x in rows:
            if x[1] is None:
                continue
            at = int((x[1] - dt.datetime(1970, 1, 1)).total_seconds()) // 60
            if bound is None or dt.datetime(1970, 1, 1) + dt.timedelta(minutes=at + 1) > bound:
                m = minutes.setdefault((x[3], at), [0, 0])
                m[0] += 1
                m[1] += round((x[4] or 0) * 1_000_000)
        high = max([x[1] for x in rows if x[1]] + ([high] if high else []))
    want = []
    for (kind, at), (events, total) in minutes.items():
        if dt.datetime(1970, 1, 1) + dt.timedelta(minutes=at + 1) <= last:
            near = [v for (k, a), v in minutes.items() if k == kind and at - 30 < a <= at]
            want.append((kind, at, events, total, len(near), sum(v[0] for v in near), sum(v[1] for v in near)))
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 50


def test_ring_state_is_bounded(spark, tmp_path):
    for no in range(3):
        arrive(spark, tmp_path, no, [event(100 * no + i, 60 * (100 * no + i)) for i in range(100)])
    S.run(S.minute_ring(source(spark, tmp_path), size=20), str(tmp_path / "out"))
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "slots").load(str(tmp_path / "out" / "state"))
    found = state.count()
    op = {r.operatorId: r.operatorName for r in spark.read.format("state-metadata").load(str(tmp_path / "out" / "state")).select("operatorId", "operatorName").distinct().collect()}
    assert found == 20, (found, op)


def test_cache_seconds_with_restart(spark, tmp_path):
    r = random.Random(4)
    ttl, files = 300, []
    for f in range(4):
        files.append([event(100 * f + i, 600 * f + r.randrange(900), r.choice("xyz"), user=1) for i in range(80)])
    files.append([event(900, 60_000, "w")])
    for no, rows in enumerate(files):
        arrive(spark, tmp_path, no, rows)
        if no == 1:
            S.run(S.cache_seconds(source(spark, tmp_path).select(F.col("event_type").alias("cache_key"), "ts"), ttl), str(tmp_path / "out"))
    got = S.run(S.cache_seconds(source(spark, tmp_path).select(F.col("event_type").alias("cache_key"), "ts"), ttl), str(tmp_path / "out")).collect()
    taken, high = [], None
    for rows in files:  # a second takes rows until the watermark has passed its end
        bound = None if high is None else high - dt.timedelta(seconds=600)
        taken += [x for x in rows if bound is None or x[1] + dt.timedelta(seconds=1) > bound]
        high = max([x[1] for x in rows] + ([high] if high else []))
    want, last = {}, {}
    for x in sorted(taken, key=lambda x: x[1]):
        if x[3] == "w":
            continue
        second = int((x[1] - dt.datetime(1970, 1, 1)).total_seconds())
        n, hits = want.get((x[3], second), (0, 0))
        want[(x[3], second)] = (n + 1, hits + (x[3] in last and second - last[x[3]] <= ttl))
        last[x[3]] = second
    assert {(x.cache_key, x.second): (x.requests, x.hits) for x in got} == want and len(got) == len(want)
    assert 0 < sum(h for _, h in want.values()) < sum(n for n, _ in want.values())
    held = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "last").load(str(tmp_path / "out" / "state"))
    assert held.count() == 0  # timers took all keys out


def test_recent_events_with_restart(spark, tmp_path):
    r = random.Random(5)
    files = [[event(50 * f + i, r.randrange(100_000), r.choice(["a", "a", "b", None]), user=r.choice([None, 1, 2])) for i in range(50)] for f in range(4)]
    files[3] += files[0][:5] + [event(None, 5), event(999, None)]
    for no, rows in enumerate(files):
        arrive(spark, tmp_path, no, rows)
        if no == 2:
            S.run(S.recent_events(source(spark, tmp_path), n=7), str(tmp_path / "out"))
    lists = S.run(S.recent_events(source(spark, tmp_path), n=7), str(tmp_path / "out"))
    got = sorted((x.event_type or "", x.place, x.event_id) for x in S.last_version(lists).collect())
    rows = {x for f in files for x in f if x[0] is not None and x[1] is not None}
    want = []
    for kind in ("a", "b", None):
        best = sorted((x for x in rows if x[3] == kind), key=lambda x: (x[1], x[0]), reverse=True)[:7]
        want += [(kind or "", i + 1, x[0]) for i, x in enumerate(best)]
    assert got == sorted(want)
    newest = max(x[1] for x in rows)
    assert {x.event_id for x in S.last_version(lists, hours=1).collect()} == {x[0] for x in rows if newest - x[1] <= dt.timedelta(hours=1)} & {w[2] for w in want}
    kept = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "kept").option("flattenCollectionTypes", True).load(str(tmp_path / "out" / "state"))
    assert kept.count() <= 3 * S.SALT * 7


def test_late_rows_are_kept_aside(spark, tmp_path):
    files = [[event(1, 0), event(2, 3000)], [event(3, 2399), event(4, 2400), event(5, None), event(6, 9000)], [event(7, 2500), event(8, 8400)]]
    for no, rows in enumerate(files[:2]):
        arrive(spark, tmp_path, no, rows)
    in_time, late = S.split_late(source(spark, tmp_path), str(tmp_path / "out"))
    assert {x.event_id for x in late.collect()} == {3} and in_time.count() == 5
    arrive(spark, tmp_path, 2, files[2])
    in_time, late = S.split_late(source(spark, tmp_path), str(tmp_path / "out"))
    assert sorted(x.event_id for x in late.collect()) == [3, 7]
    assert sorted(x.event_id for x in in_time.collect()) == [1, 2, 4, 5, 6, 8] and in_time.columns == late.columns


def test_no_rows(spark, tmp_path):
    arrive(spark, tmp_path, 0, [])
    assert S.run(S.minute_ring(source(spark, tmp_path)), str(tmp_path / "a")).count() == 0
    assert S.last_version(S.run(S.recent_events(source(spark, tmp_path)), str(tmp_path / "b")), 1).count() == 0
    in_time, late = S.split_late(source(spark, tmp_path), str(tmp_path / "c"))
    assert in_time.count() == late.count() == 0
