"""Streaming queries; their SQL is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel import streaming as X

from .base import query


@query(
    "q_stream_sliding",
    "select strftime(w, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, sum(value) as total "
    "from (select *, unnest([time_bucket(interval '12 hours', ts), time_bucket(interval '12 hours', ts) - interval '12 hours']) as w "
    "from events) group by all",
    "start event_type n",
    4,
)
def stream_sliding(spark, sf):
    rows = X.sliding_counts(X.read_table(spark, sf, "events"), F.col("ts"), "24 hours", "12 hours", "1 hour", ["event_type"])
    return X.drained(rows).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query(
    "q_stream_session",
    "with x as (select user_id, ts, (ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours') as near from events), y as (select *, sum(case when near then 0 else 1 end) over (partition by user_id order by ts) as s from x) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from y group by user_id, s",
)
def stream_session(spark, sf):
    rows = X.sessions(X.read_table(spark, sf, "events"), F.col("ts"), "6 hours", "1 hour", ["user_id"])
    return X.drained(rows).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


#: The batch twin of a state by event time: rows that the watermark has passed.
PASSED = "where ts < (select max(ts) from events) - interval '1 hour'"


def in_time(spark, sf):
    return X.read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


@query(
    "q_stream_carried",
    f"with c as (select event_id, user_id, ts, last_value(case when event_type <> 'error' then value end ignore nulls) over (partition by user_id order by ts, event_id) as last from events) select event_id, user_id, last from c {PASSED}",
    "event_id user_id",
)
def stream_carried(spark, sf):
    return X.drained(X.carried_in_order(in_time(spark, sf), "user_id", "ts", "value", late="1 hour", tie="event_id"), "append").select("event_id", "user_id", "last")


@query(
    "q_stream_onsets",
    f"""with v as (select event_id, user_id, ts, case when event_type <> 'error' then value end as v from events),
    m as (select *, median(v) over (partition by user_id order by ts, event_id rows between 5 preceding and current row) as m from v),
    a as (select *, v > greatest(m * 1.5, 50) as above from m)
    , o as (select event_id, user_id, ts, above and not coalesce(lag(above) over (partition by user_id order by ts, event_id), false) as onset from a) select event_id, user_id, onset from o {PASSED}""",
)
def stream_onsets(spark, sf):
    return X.drained(X.onsets_in_order(in_time(spark, sf), "user_id", "ts", "value", 5, 1.5, 50.0, late="1 hour", tie="event_id"), "append").select("event_id", "user_id", "onset")


@query(
    "q_stream_episodes",
    f"""with r as (select event_id, user_id, ts, row_number() over w as i, value > 100 as f, coalesce(lag(value > 100) over w, false) as was from events window w as (partition by user_id order by ts, event_id)),
    e as (select *, lag(ts) over (partition by user_id order by i) as before from r where f <> was),
    s as (select event_id from e where f and (before is null or ts - before >= interval '6 hours')),
    n as (select r.*, sum(case when s.event_id is null then 0 else 1 end) over (partition by user_id order by i rows unbounded preceding) as nth from r left join s using (event_id))
    select event_id, user_id, (case when f then nth end)::bigint as episode from n {PASSED}""",
)
def stream_episodes(spark, sf):
    rows = X.read_table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 100).alias("high"))
    return X.drained(X.episodes_in_order(rows, "user_id", "ts", "high", 6 * 3600.0, late="1 hour", tie="event_id"), "append").select("event_id", "user_id", "episode")
