"""Registered queries that run as streams over the events and keep state, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans.queries import query
from quillspark.sources.scratch import scratch_folder
from quillspark.streaming import metrics as M
from quillspark.streaming import state as S

_TTL = 6 * 3600


def _events(spark, sf_dir):
    # a pattern, as a stream takes no path of a single file
    return S.events_of(spark, f"{sf_dir}/events.parque[t]", M.EVENTS)


@query("""with e as (select event_type, cast(floor(epoch(ts)/60) as bigint) as minute, cast(round(coalesce(value,0)*1000000) as bigint) as v from events where ts is not null),
m as (select event_type, minute, count(*) as events, cast(sum(v) as bigint) as total from e group by 1,2),
r as (select *, count(*) over w as ring_minutes, cast(sum(events) over w as bigint) as ring_events, cast(sum(total) over w as bigint) as ring_total from m window w as (partition by event_type order by minute range between 1439 preceding and current row))
select r.* from r, (select max(ts) - interval 10 minute as closed from events) where to_timestamp((minute+1)*60) at time zone 'UTC' <= closed""")
def minute_ring_stream(spark, sf_dir):
    """Snapshots of each minute with sums over a ring of a day, as a stream; minutes that the watermark has not passed are still open."""
    return S.run(S.minute_ring(_events(spark, sf_dir)), scratch_folder(spark, "minute-ring"))


@query(f"""with e as (select event_type||':'||user_id as cache_key, cast(floor(epoch(ts)) as bigint) as second from events where ts is not null),
h as (select *, coalesce(second - lag(second) over (partition by cache_key order by second) <= {_TTL}, false) as hit from e),
s as (select cache_key, second, count(*) as requests, count(*) filter (hit) as hits from h group by 1,2)
select s.* from s, (select max(ts) - interval 10 minute as closed from events) where to_timestamp(second+1) at time zone 'UTC' <= closed""")
def cache_seconds_stream(spark, sf_dir):
    """Requests and hits of a cache of six hours by type and user, as a stream with timers."""
    asked = _events(spark, sf_dir).select(F.concat_ws(":", "event_type", "user_id").alias("cache_key"), "ts")
    return S.run(S.cache_seconds(asked, _TTL), scratch_folder(spark, "cache-seconds"))


@query("""with e as (select distinct event_type, epoch_us(ts) as micros, event_id, user_id from events where event_type in ('error','refund') and ts is not null),
r as (select *, row_number() over (partition by event_type order by micros desc, event_id desc, user_id) as place from e)
select * from r where place<=100 and micros >= (select max(micros) from e) - 172800000000""")
def recent_errors_stream(spark, sf_dir):
    """The hundred latest errors and refunds of two days, as a stream that keeps no more."""
    found = _events(spark, sf_dir).where(F.col("event_type").isin("error", "refund"))
    return S.last_version(S.run(S.recent_events(found), scratch_folder(spark, "recent-errors")), hours=48)
