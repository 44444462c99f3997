"""Queries over streams: the events table read as a stream of files."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources.tables import load
from tidemark.storage import shared_dir
from tidemark.streaming import jobs as J


def stream(spark, sf):
    raw = spark.readStream.schema(load(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    ms = F.floor(F.col("value") * 1000 + 0.5)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("artist"), F.col("event_type").alias("track"), ms.alias("ms_played"))


def _drain(stream_, spark, mode):
    return J.drain(stream_, spark, mode)


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS plays, sum(CAST(floor(value * 1000 + 0.5) AS BIGINT))::BIGINT AS ms FROM events GROUP BY 1""")
def stream_hourly(spark, sf):
    out = _drain(J.tumbling_counts(stream(spark, sf)), spark, "complete")
    return out.select(F.unix_micros("window.start").alias("start_us"), "plays", "ms")


@query("""WITH e AS (SELECT epoch_us(ts) AS t FROM events), k AS (SELECT CAST(floor(t / 10800000000) AS BIGINT) - u AS i FROM e, range(2) r(u))
    SELECT i * 10800000000 AS start_us, count(*) AS plays FROM k GROUP BY i""")
def stream_sliding(spark, sf):
    out = _drain(J.sliding_counts(stream(spark, sf)), spark, "complete")
    return out.select(F.unix_micros("window.start").alias("start_us"), "plays")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT * FROM g ORDER BY user_id, ts)),
    t AS (SELECT user_id, count(*) AS plays, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM s GROUP BY user_id, session)
    SELECT CAST(user_id AS VARCHAR) AS artist, plays, start_us, end_us FROM t WHERE end_us + 1800000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000""")
def stream_sessions(spark, sf):
    """Sessions that the watermark has closed, ten minutes before the last event; later ones stay open."""
    out = _drain(J.stream_sessions(stream(spark, sf), "artist"), spark, "append")
    return out.select("artist", "plays", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


@query("""SELECT DISTINCT props AS file_hash FROM events""")
def stream_dedup(spark, sf):
    """Repeats within a day are dropped in the stream, and those after that when they come to the table."""
    raw = spark.readStream.schema(load(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    uploads = raw.select(F.col("props").alias("file_hash"), F.col("ts").cast("timestamp").alias("ts"))
    folder = f"{shared_dir(spark)}/uploads-{uuid4().hex}"
    J.run_inserts(J.new_uploads(uploads).select("file_hash"), f"{folder}/table", f"{folder}/state", ["file_hash"]).awaitTermination()
    return spark.read.parquet(f"{folder}/table")


@query("""SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id""")
def stream_job_states(spark, sf):
    raw = spark.readStream.schema(load(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events = raw.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("ts"))
    return _drain(J.job_states(events), spark, "complete").select("job_id", "status")


@query("""SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE i = 1 OR event_type <> before""")
def stream_drop_repeats(spark, sf):
    return _drain(J.drop_repeats(stream(spark, sf), "artist", "track", ("ts", "event_id")), spark, "append").select("event_id")
