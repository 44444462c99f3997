"""Queries over listening history; the SQL states each report anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import listening as L
from tidemark.plans.registry import query
from tidemark.sources.tables import plays_from_events as events
from tidemark.sources.tables import plays_from_lineitem as lines

_PARTS = """CAST(lts AS DATE) AS date, CAST(extract(hour FROM lts) AS INTEGER) AS hour, dayname(lts) AS dow,
    strftime(lts, '%Y-%m') AS month, CAST(extract(year FROM lts) AS INTEGER) AS year"""
EV = f"""WITH plays AS (SELECT *, {_PARTS} FROM (
    SELECT event_id AS seq, ts, ts + INTERVAL 330 MINUTE AS lts, CAST(floor(value * 1000 + 0.5) AS BIGINT) AS ms,
        event_type AS track, CAST(user_id AS VARCHAR) AS artist, json_extract_string(props, '$.k') AS album,
        event_type = 'error' AS skipped, floor(value * 1000 + 0.5) < 30000 AS short_play, event_id % 3 = 0 AS shuffle,
        CASE WHEN event_id % 5 <> 0 THEN event_id % 7 = 0 END AS offline FROM events))
"""
LI = f"""WITH plays AS (SELECT *, {_PARTS} FROM (
    SELECT l_orderkey * 10 + l_linenumber AS seq, o_orderdate AS ts, o_orderdate + INTERVAL 330 MINUTE AS lts,
        CAST(l_quantity * 1000 AS BIGINT) AS ms, p_name AS track, s_name AS artist, p_brand AS album,
        l_returnflag = 'R' AS skipped, CAST(l_quantity * 1000 AS BIGINT) < 5000 AS short_play, o_orderpriority AS reason_start,
        o_orderstatus AS reason_end, l_linestatus AS platform
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey))
"""
H = "sum(ms) / 3600000.0 AS hours"


def ranked(base: str, keys: str, measures: str, order: str, n: int) -> str:
    cond = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"{base} SELECT {keys}, {measures} FROM plays WHERE {cond} GROUP BY {keys} ORDER BY {order} DESC, {keys} LIMIT {n}"


def _flag(c: str) -> str:
    return f"CAST(coalesce(sum(CAST({c} AS INTEGER)), 0) AS BIGINT) AS {c}_plays, avg(CAST({c} AS INTEGER)) AS {c}_share"


@query(EV + f"""SELECT {H}, sum(ms) / 86400000.0 AS days, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date,
    CAST(max(date) - min(date) AS BIGINT) AS span_days, count(*) AS plays, count(DISTINCT track) AS tracks, count(DISTINCT artist) AS artists,
    count(DISTINCT album) AS albums, {', '.join(map(_flag, ('skipped', 'short_play', 'shuffle', 'offline')))} FROM plays""")
def overview(spark, sf):
    return L.overview(events(spark, sf))


def rounded_hours(digits: int) -> str:
    return f"round_even(sum(ms) / 3600000.0, {digits}) AS hours"


@query(ranked(LI, "track, artist", f"count(*) AS plays, {rounded_hours(1)}", "plays", 25))
def top_tracks_by_plays(spark, sf):
    return L.top(lines(spark, sf), ["track", "artist"], [L.plays_count(), L.hours(1)], "plays", 25)


@query(ranked(LI, "track, artist", f"count(*) AS plays, {rounded_hours(2)}", "sum(ms)", 25))
def top_tracks_by_hours(spark, sf):
    """Ranked before rounding."""
    return L.top(lines(spark, sf), ["track", "artist"], [L.plays_count(), L.hours(2), F.sum("ms_played").alias("ms")], "ms", 25).drop("ms")


@query(ranked(LI, "artist", f"count(*) AS plays, {H}, count(DISTINCT track) AS tracks", "plays", 25))
def top_artists(spark, sf):
    return L.top(lines(spark, sf), ["artist"], [L.plays_count(), L.hours(), F.countDistinct("track").alias("tracks")], "plays", 25)


@query(ranked(LI, "album, artist", f"count(*) AS plays, {H}", "plays", 20))
def top_albums(spark, sf):
    return L.top(lines(spark, sf), ["album", "artist"], [L.plays_count(), L.hours()], "plays", 20)


@query(EV + f"""SELECT hour, plays, hours, repeat('█', CAST(floor(plays / max(plays) OVER () * 30) AS INTEGER)) AS bar
    FROM (SELECT hour, count(*) AS plays, {H} FROM plays GROUP BY hour)""")
def hourly_profile(spark, sf):
    return L.with_bar(L.profile(events(spark, sf), "hour"), F.col("plays"), 30)


@query(EV + f""", days AS (SELECT unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) AS dow,
    unnest([0, 1, 2, 3, 4, 5, 6]) AS position)
    SELECT days.dow, CAST(position AS BIGINT) AS position, plays, hours FROM days LEFT JOIN
    (SELECT dow, count(*) AS plays, {H} FROM plays WHERE dow <> 'Sunday' GROUP BY dow) p ON days.dow = p.dow""")
def weekday_profile(spark, sf):
    """Without Sundays, so that a day without plays is seen to stay."""
    return L.weekday_profile(events(spark, sf).filter("dow <> 'Sunday'"))


@query(LI + f"SELECT year, count(*) AS plays, {H}, count(DISTINCT track) AS tracks, count(DISTINCT artist) AS artists FROM plays GROUP BY year")
def yearly_profile(spark, sf):
    return L.profile(lines(spark, sf), "year", F.countDistinct("track").alias("tracks"), F.countDistinct("artist").alias("artists"))


@query(LI + f"SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS plays, {H} FROM plays GROUP BY 1 ORDER BY hours DESC, date LIMIT 20")
def top_days(spark, sf):
    day = lines(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return L.top(day, ["date"], [L.plays_count(), L.hours()], "hours", 20)


_SKIPS = "count(*) AS plays, CAST(sum(CAST(skipped AS INTEGER)) AS BIGINT) AS skips, CAST(sum(CAST(short_play AS INTEGER)) AS BIGINT) AS short_plays"


@query(LI + f"""SELECT *, round_even(100.0 * skips / plays, 1) AS skip_rate FROM (SELECT artist, {_SKIPS} FROM plays GROUP BY artist)
    WHERE plays >= 20 ORDER BY skip_rate DESC, plays DESC, artist LIMIT 20""")
def artist_skip_rates(spark, sf):
    return L.skip_rates(lines(spark, sf), ["artist"], 20, 20)


@query(LI + f"""SELECT *, round_even(100.0 * skips / plays, 1) AS skip_rate FROM (SELECT track, artist, {_SKIPS} FROM plays GROUP BY track, artist)
    WHERE plays >= 5 ORDER BY skip_rate DESC, plays DESC, track, artist LIMIT 20""")
def track_skip_rates(spark, sf):
    return L.skip_rates(lines(spark, sf), ["track", "artist"], 5, 20)


@query(LI + """SELECT track, artist, count(*) AS plays FROM plays GROUP BY track, artist
    HAVING count(*) >= 10 AND count(*) FILTER (skipped) = 0 ORDER BY plays DESC, track, artist LIMIT 20""")
def never_skipped(spark, sf):
    return L.never_skipped(lines(spark, sf), ["track", "artist"])


@query(LI + "SELECT reason_start, count(*) AS n FROM plays WHERE reason_start IS NOT NULL GROUP BY 1")
def start_reasons(spark, sf):
    return L.value_counts(lines(spark, sf), "reason_start")


@query(LI + "SELECT reason_end, count(*) AS n FROM plays WHERE reason_end IS NOT NULL GROUP BY 1")
def end_reasons(spark, sf):
    return L.value_counts(lines(spark, sf), "reason_end")


@query(LI + "SELECT platform, count(*) AS n FROM plays WHERE platform IS NOT NULL GROUP BY 1")
def platform_breakdown(spark, sf):
    return L.value_counts(lines(spark, sf), "platform")


@query(LI + """SELECT artist, strftime(min(lts), '%Y-%m-%d') AS first_heard, count(*) AS total_plays FROM plays
    GROUP BY artist ORDER BY total_plays DESC, artist LIMIT 30""")
def discovery_timeline(spark, sf):
    return L.discovery(lines(spark, sf))


@query(LI + f"""SELECT *, repeat('█', CAST(floor(round_even(hours, 1) / max(round_even(hours, 1)) OVER () * 40) AS INTEGER)) AS bar
    FROM (SELECT month, count(*) AS plays, {H} FROM plays GROUP BY month)""")
def monthly_trend(spark, sf):
    return L.with_bar(L.profile(lines(spark, sf), "month"), F.bround("hours", 1), 40)


@query(LI + """SELECT year, artist, ms / 3600000.0 AS hours, place FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY ms DESC, artist) AS place
    FROM (SELECT year, artist, sum(ms) AS ms FROM plays GROUP BY year, artist)) WHERE place <= 3""")
def top_artists_per_year(spark, sf):
    return L.top_per_group(lines(spark, sf), "year", "artist")


_SLOT = "CASE WHEN hour >= 22 OR hour <= 4 THEN 'late_night' WHEN hour <= 11 THEN 'morning' WHEN hour <= 17 THEN 'afternoon' ELSE 'evening' END"


@query(EV + f"SELECT {_SLOT} AS time_slot, count(*) AS plays, {H} FROM plays GROUP BY 1")
def time_slots(spark, sf):
    return L.profile(events(spark, sf).withColumn("time_slot", L.time_slot()), "time_slot")


@query(EV + f"""SELECT track, artist, count(*) AS plays, {H} FROM plays WHERE {_SLOT} = 'late_night'
    GROUP BY track, artist ORDER BY plays DESC, track, artist LIMIT 10""")
def late_night_tracks(spark, sf):
    late = events(spark, sf).withColumn("time_slot", L.time_slot()).filter("time_slot = 'late_night'")
    return L.top(late, ["track", "artist"], [L.plays_count(), L.hours()], "plays", 10)


def _sessions(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return EV + f""", gaps AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (s)) / 60000000.0, 999) AS gap FROM plays WINDOW s AS ({part}ORDER BY ts, seq)),
    marked AS (SELECT *, CAST(sum(CASE WHEN gap > 30 THEN 1 ELSE 0 END) OVER (s ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session FROM gaps WINDOW s AS ({part}ORDER BY ts, seq)),
    sessions AS (SELECT {by + ', ' if by else ''}session, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS end_us, count(*) AS plays, {H},
        (max(epoch_us(ts)) - min(epoch_us(ts))) / 3600000000.0 AS duration_h FROM marked GROUP BY ALL)
    """


def _times(sessions):
    return sessions.withColumn("start_us", F.unix_micros("start")).withColumn("end_us", F.unix_micros("end")).drop("start", "end")


@query(_sessions("artist") + "SELECT * FROM sessions")
def user_sessions(spark, sf):
    return _times(L.session_table(L.with_sessions(events(spark, sf), ["artist"]), ["artist"]))


@query(_sessions("") + "SELECT * FROM sessions")
def sessions(spark, sf):
    return _times(L.session_table(L.global_sessions(events(spark, sf)), []))


@query(_sessions("") + """SELECT count(*) AS sessions, avg(plays) AS mean_plays, avg(duration_h) AS mean_duration_h, max(duration_h) AS max_duration_h,
    arg_min(session, (-duration_h, session)) AS longest_session FROM sessions""")
def session_summary(spark, sf):
    return L.session_summary(L.session_table(L.global_sessions(events(spark, sf)), []))


@query(LI + """, days AS (SELECT DISTINCT date FROM plays), isl AS (SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS g FROM days),
    runs AS (SELECT min(date) AS a, max(date) AS b, count(*) AS n FROM isl GROUP BY g), best AS (SELECT * FROM runs ORDER BY n DESC, a LIMIT 1),
    span AS (SELECT count(*) AS active_days, CAST(max(date) - min(date) + 1 AS BIGINT) AS span_days FROM days)
    SELECT active_days, span_days, 100.0 * active_days / span_days AS active_share, n AS longest, strftime(a, '%Y-%m-%d') AS streak_start,
    strftime(b, '%Y-%m-%d') AS streak_end FROM span, best""")
def listening_streak(spark, sf):
    return L.streak(lines(spark, sf))


@query(EV + """, days AS (SELECT DISTINCT artist, date FROM plays), isl AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY artist ORDER BY date) AS INTEGER) AS g FROM days)
    SELECT artist, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last, count(*) AS length FROM isl GROUP BY artist, g""")
def user_streaks(spark, sf):
    runs = L.islands(events(spark, sf), ["artist"])
    return runs.withColumn("first", F.date_format("first", "yyyy-MM-dd")).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


@query(LI + f"SELECT year, month, count(*) AS plays, {H} FROM plays GROUP BY ROLLUP (year, month)")
def span_rollup(spark, sf):
    return L.span_rollup(lines(spark, sf))


@query(EV + """SELECT artist, count(*) AS plays, sum(ms)::BIGINT AS total_ms, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM plays GROUP BY artist""")
def entity_stats(spark, sf):
    return events(spark, sf).groupBy("artist").agg(L.plays_count(), F.sum("ms_played").alias("total_ms"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


@query(EV + """SELECT hour, sum(ms)::BIGINT AS total_ms, avg(CAST(skipped AS INTEGER)) AS skip_share, avg(CAST(ms > 120000 AS INTEGER)) AS long_share FROM plays GROUP BY hour""")
def hour_profile_stats(spark, sf):
    return events(spark, sf).groupBy("hour").agg(F.sum("ms_played").alias("total_ms"), F.avg(F.col("skipped").cast("int")).alias("skip_share"), F.avg((F.col("ms_played") > 120_000).cast("int")).alias("long_share"))
