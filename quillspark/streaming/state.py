"""Streams with state of their own: a ring of minutes, caches with a time to live, recent events, late rows.

All state is bounded: by the ring, by the time to live, by the number of recent events. Rows are reduced by window
aggregates, or under salted keys, before they meet the state of a key, so a key that holds most rows costs no more
than its minutes, seconds or recent events.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.streaming.metrics import LATE

#: Snapshots that are kept of a key: the minutes of a day.
RING = 1440
#: Parts that the events of a type are dealt in before they meet.
SALT = 64
#: Values are summed in millionths, so sums are exact and their order doesn't matter.
UNIT = 1_000_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run(frame: DataFrame, folder: str) -> DataFrame:
    """Processes what has arrived in the input of a stream, once: its rows go to folder/rows, its place and state to folder/state.

    Returns all rows in folder/rows. A later call with the same folder goes on where the last ended, or failed.
    """
    spark = frame.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # what states of many keys ask for
    try:
        q = frame.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start(f"{folder}/rows")
        q.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(frame.schema).parquet(f"{folder}/rows")


class _Ring(StatefulProcessor):
    """The last `size` minutes of a key: slot (minute modulo size) to minute, events and total."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot long", "minute long, events long, total long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        ring = {slot[0]: tuple(held) for slot, held in self.slots.iterator()}
        oldest = sorted(held[0] for held in ring.values())
        events, total = sum(h[1] for h in ring.values()), sum(h[2] for h in ring.values())
        first, changed = 0, set()
        for row in sorted(rows, key=lambda r: r.minute):
            while first < len(oldest) and oldest[first] <= row.minute - self.size:
                gone = ring.pop(oldest[first] % self.size)
                changed.add(gone[0] % self.size)
                events, total, first = events - gone[1], total - gone[2], first + 1
            slot = row.minute % self.size
            ring[slot] = (row.minute, row.events, row.total)
            oldest.append(row.minute)
            changed.add(slot)
            events, total = events + row.events, total + row.total
            yield Row(event_type=key[0], minute=row.minute, events=row.events, total=row.total, ring_minutes=len(oldest) - first, ring_events=events, ring_total=total)
        for slot in changed:
            if slot in ring:
                self.slots.updateValue((slot,), ring[slot])
            else:
                self.slots.removeKey((slot,))

    def close(self) -> None:
        pass


def minute_ring(events: DataFrame, size: int = RING) -> DataFrame:
    """A snapshot of each type and minute with events, once the watermark has passed it, with sums over the last `size` minutes.

    Columns: event_type, minute (since 1970), events, total, ring_minutes (with events), ring_events, ring_total; totals
    of value (null: 0) are in millionths. Rows without ts have no part in it; a null type is a type of its own.
    """
    value = F.round(F.coalesce("value", F.lit(0.0)) * UNIT).cast("long")
    minutes = events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    minutes = minutes.select("event_type", F.floor(F.unix_timestamp("w.start") / 60).alias("minute"), "events", "total")
    out = "event_type string, minute long, events long, total long, ring_minutes long, ring_events long, ring_total long"
    return minutes.groupBy("event_type").transformWithState(_Ring(size), out, "Append", "None")


class _Cache(StatefulProcessor):
    """The second in which a key was last asked for, held until it can't be a hit any more."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "second long")

    def _timer(self, second: int) -> int:
        return (second + self.ttl + 2) * 1000  # when the second after the last possible hit is closed

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.last.get() if self.last.exists() else None
        before = last = held[0] if held else None
        for row in sorted(rows, key=lambda r: r.second):
            hit = last is not None and row.second - last <= self.ttl
            last = row.second
            yield Row(cache_key=key[0], second=last, requests=row.requests, hits=row.requests - (0 if hit else 1))
        if before is not None:
            self.handle.deleteTimer(self._timer(before))
        if last is not None:
            self.last.update((last,))
            self.handle.registerTimer(self._timer(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def cache_seconds(requests: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Requests and hits of each key and second: a request is a hit if the key was asked for at most ttl_seconds before.

    requests(cache_key string, ts). Seconds come once the watermark has passed them, in order, so rows out of
    order count as if they were in order. A key's state goes by a timer when it can give no hit any more. Rows without
    ts have no part in it; the null key is a key.
    """
    seconds = requests.withWatermark("ts", LATE).groupBy(F.window("ts", "1 second").alias("w"), "cache_key").agg(F.count("*").alias("requests"))
    seconds = seconds.select("cache_key", F.window_time("w").alias("at"), F.unix_timestamp("w.start").alias("second"), "requests")
    return seconds.groupBy("cache_key").transformWithState(_Cache(ttl_seconds), "cache_key string, second long, requests long, hits long", "Append", "EventTime")


class _Recent(StatefulProcessor):
    """The n events of a key that are latest by (ts, event_id); gives those of a batch that are among them, or all of them as one list."""

    def __init__(self, n: int, lists: bool) -> None:
        self.n, self.lists = n, lists

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "micros long, event_id long, user_id long")
        self.version = handle.getValueState("version", "no long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = {tuple(r) for r in self.kept.get()}
        top = list(held)
        for row in rows:
            top.append((row.micros, row.event_id, row.user_id))
            if len(top) >= 2 * self.n + 1000:
                top = self._best(top)
        top = self._best(top)
        if set(top) == held:
            return
        self.kept.put(top)
        if self.lists:
            no = self.version.get()[0] + 1 if self.version.exists() else 0
            self.version.update((no,))
            for place, t in enumerate(top):
                yield Row(event_type=key[0], version=no, place=place + 1, micros=t[0], event_id=t[1], user_id=t[2])
        else:
            for t in top:
                if t not in held:
                    yield Row(event_type=key[0], micros=t[0], event_id=t[1], user_id=t[2])

    def _best(self, rows: list[tuple]) -> list[tuple]:
        return sorted(set(rows), key=lambda t: (-t[0], -t[1], t[2] is None, t[2] or 0))[: self.n]

    def close(self) -> None:
        pass


def recent_events(events: DataFrame, n: int = 100) -> DataFrame:
    """The n latest events of each type as a list that is given anew, under the next version, whenever it changes.

    Columns: event_type, version (from 0), place (from 1), micros (of ts), event_id, user_id. Latest by ts, then event_id; equal events
    count once; those without ts or event_id have no part in it. A type is dealt in SALT parts, each of which passes on only what is
    among its own n latest.
    """
    found = events.where("ts is not null and event_id is not null").select("event_type", F.unix_micros("ts").alias("micros"), "event_id", "user_id", F.pmod(F.xxhash64("event_id"), F.lit(SALT)).alias("salt"))
    row = "event_type string, micros long, event_id long, user_id long"
    some = found.groupBy("event_type", "salt").transformWithState(_Recent(n, False), row, "Append", "None")
    return some.groupBy("event_type").transformWithState(_Recent(n, True), "event_type string, version long, place long, micros long, event_id long, user_id long", "Append", "None")


def last_version(lists: DataFrame, hours: float | None = None) -> DataFrame:
    """The latest list of each type of rows that recent_events gave; of those of the last hours before the newest event, if given."""
    newest = lists.groupBy("event_type").agg(F.max("version").alias("version"))
    newest = newest.withColumnsRenamed({"event_type": "_type", "version": "_version"})
    out = lists.join(newest, lists["event_type"].eqNullSafe(newest["_type"]) & (lists["version"] == newest["_version"])).drop("_type", "_version")
    if hours is not None:
        now = lists.agg(F.max("micros").alias("now"))  # one row
        out = out.join(F.broadcast(now)).where(F.col("micros") >= F.col("now") - int(hours * 3_600_000_000)).drop("now")
    return out.drop("version")


def split_late(events: DataFrame, folder: str, delay: str = LATE) -> tuple[DataFrame, DataFrame]:
    """Rows of a stream that came in time, and rows that came too late for its watermark: ts lies more than `delay` before the latest of earlier batches.

    Each batch writes its own folders under folder/in_time, folder/late and folder/high (its latest ts) and overwrites them when it
    is tried again, so no row is lost or doubled. Rows without ts are in time. A later call with the same folder goes on.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, no: int) -> None:
        high = batch.agg(F.max("ts").alias("high")).withColumn("no", F.lit(no))
        high.write.mode("overwrite").parquet(f"{folder}/high/batch={no}")
        bound = spark.read.schema("high timestamp, no long").parquet(f"{folder}/high").where(F.col("no") < no).agg((F.max("high") - F.expr(f"interval {delay}")).alias("bound"))
        marked = batch.join(F.broadcast(bound)).withColumn("_late", F.coalesce(F.col("ts") < F.col("bound"), F.lit(False))).drop("bound").persist()
        for name, part in (("in_time", marked.where("not _late")), ("late", marked.where("_late"))):
            part.drop("_late").write.mode("overwrite").parquet(f"{folder}/{name}/batch={no}")
        marked.unpersist()

    events.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    read = lambda name: spark.read.schema(events.schema).parquet(f"{folder}/{name}").drop("batch")
    return read("in_time"), read("late")


def events_of(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Files of events at a path, each read once, `files` a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
