"""Streaming queries over the events table, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.streaming import events as E


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an event time of the stream is an instant; the table's has no zone and is taken as UTC
    return E.source(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"))


def _plain(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def q_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.run_complete(spark, E.tumbling(_events(spark, sf_dir), "1 hour"), "tumbling")
    return _plain(out, "start").select("start", "event_type", "n", F.round("total", 4).alias("total"))


def q_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(E.run_complete(spark, E.sliding(_events(spark, sf_dir), "2 hours", "1 hour"), "sliding"), "start")


def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.run_complete(spark, E.sessions(_events(spark, sf_dir), "30 minutes"), "sessions")
    return _plain(out, "start", "end").select("user_id", "start", F.col("end").alias("finish"), "n")


def q_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_append(spark, E.first_seen(_events(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"), "dedup")


QUERIES = {"stream_tumbling": q_tumbling, "stream_sliding": q_sliding, "stream_session": q_sessions, "stream_dedup": q_dedup}

_FMT = "'%Y-%m-%d ' || '%H:%M:%S'"
ORACLE_SQL = {
    "stream_tumbling": f"select strftime(date_trunc('hour', ts), {_FMT}) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "stream_sliding": f"with h as (select date_trunc('hour', ts) as h from events union all select date_trunc('hour', ts) - interval 1 hour from events) select strftime(h, {_FMT}) as start, count(*) as n from h group by 1",
    "stream_session": f"""with g as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 30 minutes then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, strftime(min(ts), {_FMT}) as start, strftime(max(ts) + interval 30 minutes, {_FMT}) as finish, count(*) as n from s group by user_id, k""",
    "stream_dedup": "select distinct user_id, event_type from events",
}
