"""Queries over raw history, work state, logs, audio signals and context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import dsp
from tidemark.functions import text as X
from tidemark.operators import context as M
from tidemark.operators import state as W
from tidemark.plans.listening import EV
from tidemark.plans.registry import query
from tidemark.sources import history
from tidemark.sources.tables import load, plays_from_events

_RAW = """WITH raw AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'never' WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS ts,
    CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS ms, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 10 = 0 THEN '' ELSE event_type END AS track,
    CASE WHEN event_id % 19 <> 0 THEN CAST(user_id AS VARCHAR) END AS artist, CASE event_id % 3 WHEN 0 THEN 'svc:track:t' || event_id WHEN 1 THEN 'svc:episode:e' || event_id END AS uri, epoch_us(date_trunc('second', ts)) AS us FROM events)
"""


def raw_history(spark, sf):
    """Events as raw rows of an export, with gaps and faults of every kind."""
    e, id_ = load(spark, sf, "events"), F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select(
        F.when(id_ % 17 == 0, "never").when(id_ % 2 == 0, F.concat(iso, F.lit("Z"))).otherwise(iso).alias("ts"), F.when(id_ % 13 != 0, F.floor(F.col("value") * 1000)).alias("ms_played"),
        F.when(id_ % 11 == 0, F.lit(None)).when(id_ % 10 == 0, "").otherwise(F.col("event_type")).alias(history.TRACK), F.when(id_ % 19 != 0, F.col("user_id").cast("string")).alias(history.ARTIST), F.lit(None).cast("string").alias(history.ALBUM),
        F.when(id_ % 3 == 0, F.concat(F.lit("svc:track:t"), id_)).when(id_ % 3 == 1, F.concat(F.lit("svc:episode:e"), id_)).alias(history.URI),
        *[F.lit(None).cast("string").alias(c) for c in ("platform", "conn_country", "reason_start", "reason_end", "_corrupt_record")], *[F.lit(None).cast("boolean").alias(c) for c in ("shuffle", "skipped", "offline", "incognito_mode")],
        F.concat(F.lit("part"), id_ % 4).alias("source_file"),
    )


@query(_RAW + """SELECT us, coalesce(ms, 0) AS ms_played, track, artist, CASE WHEN uri LIKE 'svc:track:%' THEN substr(uri, 11) END AS external_id, 'part' || (event_id % 4) AS source_file, coalesce(ms, 0) < 30000 AS short_play
    FROM raw WHERE track <> '' AND artist IS NOT NULL AND ts <> 'never'""")
def parsed_history(spark, sf):
    return history.parse(raw_history(spark, sf)).select(F.unix_micros("ts").alias("us"), "ms_played", "track", "artist", "external_id", "source_file", "short_play")


@query(_RAW + """, c AS (SELECT *, CASE WHEN track IS NULL OR track = '' OR artist IS NULL THEN 'n' WHEN ts = 'never' THEN 'b' ELSE 't' END AS c FROM raw)
    SELECT count(DISTINCT event_id % 4) AS files, count(*) AS rows, count(*) FILTER (c = 't') AS tracks, count(*) FILTER (c = 'n') AS skipped_non_music, count(*) FILTER (c = 'b') AS bad_rows, 0 AS unreadable FROM c""")
def parse_stats(spark, sf):
    return history.parse_stats(raw_history(spark, sf))


_LOG = """WITH log AS (SELECT o_custkey AS track_id, o_orderpriority AS stage, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'done' ELSE 'running' END AS status, 'order ' || o_orderkey AS error, o_orderdate AS d, o_orderkey AS n FROM orders)
"""


def state_log(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "done").otherwise("running")
    return load(spark, sf, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderpriority").alias("stage"), status.alias("status"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("error"), F.struct("o_orderdate", "o_orderkey").alias("ts"))


@query(_LOG + "SELECT track_id, stage, arg_max(status, (d, n)) AS status, count(*) AS attempts, left(arg_max(error, (d, n)), 500) AS error FROM log GROUP BY track_id, stage")
def processing_state(spark, sf):
    return W.fold_state(state_log(spark, sf)).drop("ts")


@query(_LOG + "SELECT status, count(*) AS n FROM (SELECT arg_max(status, (d, n)) AS status FROM log GROUP BY track_id, stage) GROUP BY status")
def status_counts(spark, sf):
    return W.fold_state(state_log(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query(_LOG + """SELECT l.track_id, count(*) AS attempts FROM log l LEFT JOIN (SELECT track_id, max((d, n)) AS ok FROM log WHERE status = 'done' GROUP BY 1) s ON l.track_id = s.track_id
    WHERE l.status = 'failed' AND (ok IS NULL OR (l.d, l.n) > ok) GROUP BY 1""")
def download_failures(spark, sf):
    return W.failures(state_log(spark, sf))


_OLD = "SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0"
_NEW = "SELECT c_custkey AS id, -c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0"


def _two(spark, sf):
    c = load(spark, sf, "customer")
    return c.filter("c_custkey % 3 <> 0").selectExpr("c_custkey id", "c_acctbal v"), c.filter("c_custkey % 2 = 0").selectExpr("c_custkey id", "-c_acctbal v")


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
def upsert(spark, sf):
    return W.upsert(*_two(spark, sf), ["id"])


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def insert_ignore(spark, sf):
    return W.insert_ignore(*_two(spark, sf), ["id"])


@query("""WITH t AS (SELECT lower('[download] Destination ' || event_type || CASE WHEN event_id % 50 = 0 THEN ' HTTP 403 Forbidden' WHEN event_id % 70 = 0 THEN ' rate-limited, try again later' ELSE '' END) AS v FROM events),
    c AS (SELECT sum((length(v) - length(replace(v, '[download] destination', ''))) // 22)::BIGINT AS downloads, sum((length(v) - length(replace(v, 'rate-limited', ''))) // 12 + (length(v) - length(replace(v, 'try again later', ''))) // 15)::BIGINT AS throttled,
    0 AS agegate, sum((length(v) - length(replace(v, '403', ''))) // 3 + (length(v) - length(replace(v, 'forbidden', ''))) // 9)::BIGINT AS forbid, 0 AS unavail FROM t)
    SELECT *, CASE WHEN throttled > 5 THEN 'throttled' WHEN forbid > 5 THEN 'forbidden' WHEN downloads > 0 THEN 'downloading' ELSE 'quiet' END AS verdict FROM c""")
def log_classes(spark, sf):
    id_ = F.col("event_id")
    more = F.when(id_ % 50 == 0, " HTTP 403 Forbidden").when(id_ % 70 == 0, " rate-limited, try again later").otherwise("")
    return W.classify_log(load(spark, sf, "events").select(F.concat(F.lit("[download] Destination "), F.col("event_type"), more).alias("value")))


@query("""WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, count(*) FILTER (event_type <> 'error') AS m FROM events GROUP BY 1),
    s AS (SELECT epoch_us(day) AS us, (SELECT count(*) FROM events) AS total, sum(n) OVER w AS got, sum(m) OVER w AS analyzed FROM d WINDOW w AS (ORDER BY day)),
    r AS (SELECT *, (us - lag(us) OVER w) / 3600000000.0 AS h, got - lag(got) OVER w AS g, analyzed - lag(analyzed) OVER w AS a FROM s WINDOW w AS (ORDER BY us)),
    x AS (SELECT us, total, got::BIGINT AS got, analyzed::BIGINT AS analyzed, CASE WHEN h > 0 THEN g / h ELSE 0 END AS got_rate, CASE WHEN h > 0 THEN a / h ELSE 0 END AS analyzed_rate FROM r)
    SELECT *, CASE WHEN got < total AND got_rate > 0.5 THEN 'downloading' WHEN analyzed < got AND analyzed_rate > 0.5 THEN 'analyzing' WHEN got >= total AND analyzed >= total THEN 'complete' ELSE 'idle' END AS phase, 100.0 * got / total AS pct FROM x""")
def progress(spark, sf):
    """Snapshots at the end of each day, one row to a day."""
    from pyspark.sql.window import Window

    day = load(spark, sf, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("m"))
    w = Window.partitionBy().orderBy("ts")
    snaps = day.select("ts", F.sum("n").over(Window.partitionBy()).alias("total"), F.sum("n").over(w).alias("got"), F.sum("m").over(w).alias("analyzed"))
    return W.rates(snaps).withColumn("us", F.unix_micros("ts")).drop("ts", "eta")


@query("""SELECT conv_id, turn, length(coalesce(text, '')) AS chars, CAST(floor(turn / 10) * 10 AS BIGINT)::VARCHAR || 's' AS decade FROM conversations""")
def decades(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), X.decade(F.col("turn")).alias("decade"))


_CTX = EV + """, g AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60000000.0, 999) AS gap FROM plays WINDOW w AS (PARTITION BY artist ORDER BY ts, seq)),
    s AS (SELECT *, CAST(sum(CASE WHEN gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY artist ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session, CAST(skipped AS INTEGER) AS k FROM g)
"""


@query(_CTX + """SELECT seq, session, sin(hour * 2 * pi() / 24) AS hour_sin, row_number() OVER i AS session_position, coalesce(sum(ms) OVER (i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS session_ms_so_far,
    coalesce(sum(k) OVER (i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS skips_this_session, coalesce(lag(k) OVER w, 0) AS prev_skipped, avg(1.0 - k) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS completion_last_5
    FROM s WINDOW i AS (PARTITION BY artist, session ORDER BY ts, seq), w AS (PARTITION BY artist ORDER BY ts, seq)""", rounded="hour_sin completion_last_5")
def context_features(spark, sf):
    found = M.context_features(plays_from_events(spark, sf), ["artist"])
    return found.select("seq", "session", "hour_sin", "session_position", "session_ms_so_far", "skips_this_session", "prev_skipped", "completion_last_5")


@query()
def skip_baseline(spark, sf):
    return M.skip_baseline(M.context_features(plays_from_events(spark, sf), ["artist"]))


def signals(spark, sf):
    """Two seconds of clicks and a chord for each supplier, by its key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in dsp.parts(batches):
            yield pd.DataFrame({"id": pdf["s_suppkey"], "samples": [dsp.clicks_and_chord(k) for k in pdf["s_suppkey"]]})

    return load(spark, sf, "supplier").select("s_suppkey").repartition(8).mapInPandas(run, "id long, samples array<float>")


@query()
def audio_features(spark, sf):
    """Signals are made in the worker that uses them, as between two Python passes they go through the executor's memory."""
    key = F.col("s_suppkey")
    return dsp.features_of(load(spark, sf, "supplier").select(key.alias("id"), key.alias("samples")).repartition(8), dsp.clicks_and_chord)


@query()
def audio_analysis(spark, sf):
    found = dsp.analyze(signals(spark, sf))
    return found.select("id", "duration", "tempo", F.size("beats").alias("n_beats"), F.size("segments").alias("n_segments"), "error")


@query()
def audio_embeddings(spark, sf):
    return dsp.embed(signals(spark, sf))
