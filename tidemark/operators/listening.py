"""Listening-history reports over plays (ts, ms_played, track, artist, album, skipped, short_play, ... and local parts).

Grouping leaves out null keys, as the reports do. Hours are the whole milliseconds divided at the end, so that
sums do not depend on the order of rows. Ties are broken by the grouping keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
HOUR_MS = 3_600_000


def hours(digits: int | None = None) -> Column:
    """Hours played; rounded half to even where a report says to how many digits."""
    h = F.sum("ms_played") / HOUR_MS
    return (h if digits is None else F.bround(h, digits)).alias("hours")


def plays_count() -> Column:
    return F.count("*").alias("plays")


def rate(part: str, whole: str, digits: int = 1) -> Column:
    return F.bround(100.0 * F.col(part) / F.col(whole), digits)


def known(plays: DataFrame, *keys: str) -> DataFrame:
    return plays.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def top(plays: DataFrame, keys: list[str], measures: list[Column], order: str, n: int) -> DataFrame:
    """Measures by key, the n greatest by ``order``; planned as a distributed top-n, without a full sort."""
    out = known(plays, *keys).groupBy(*keys).agg(*measures)
    return out.orderBy(F.col(order).desc(), *keys).limit(n)


def overview(plays: DataFrame) -> DataFrame:
    flags = [c for c in ("skipped", "short_play", "shuffle", "offline") if c in plays.columns]
    share = [x for c in flags for x in (F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).cast("long").alias(f"{c}_plays"), F.avg(F.col(c).cast("int")).alias(f"{c}_share"))]
    return plays.agg(
        hours(), (F.sum("ms_played") / (24 * HOUR_MS)).alias("days"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"),
        F.datediff(F.max("date"), F.min("date")).cast("long").alias("span_days"), plays_count(), F.countDistinct("track").alias("tracks"), F.countDistinct("artist").alias("artists"), F.countDistinct("album").alias("albums"), *share,
    )


def profile(plays: DataFrame, key: str, *more: Column) -> DataFrame:
    return known(plays, key).groupBy(key).agg(plays_count(), hours(), *more)


def with_bar(rows: DataFrame, value: Column, width: int) -> DataFrame:
    """A bar of full blocks, the greatest value ``width`` long. The maximum of few groups is taken in one window."""
    return rows.withColumn("bar", F.repeat(F.lit("█"), F.floor(value / F.max(value).over(Window.partitionBy()) * width).cast("int")))


def weekday_profile(plays: DataFrame) -> DataFrame:
    """All seven weekdays in order; a day without plays has nulls."""
    days = plays.sparkSession.createDataFrame([(d, i) for i, d in enumerate(WEEKDAYS)], "dow string, position long")
    return F.broadcast(days).join(profile(plays, "dow"), "dow", "left").select("dow", "position", "plays", "hours")


def skip_rates(plays: DataFrame, keys: list[str], least: int, n: int) -> DataFrame:
    measures = [plays_count(), F.sum(F.col("skipped").cast("long")).alias("skips"), F.sum(F.col("short_play").cast("long")).alias("short_plays")]
    out = known(plays, *keys).groupBy(*keys).agg(*measures).filter(F.col("plays") >= least)
    return out.withColumn("skip_rate", rate("skips", "plays")).orderBy(F.desc("skip_rate"), F.desc("plays"), *keys).limit(n)


def never_skipped(plays: DataFrame, keys: list[str], least: int = 10, n: int = 20) -> DataFrame:
    out = known(plays, *keys).groupBy(*keys).agg(plays_count(), F.sum(F.coalesce(F.col("skipped").cast("long"), F.lit(0))).alias("skips"))
    return out.filter((F.col("plays") >= least) & (F.col("skips") == 0)).drop("skips").orderBy(F.desc("plays"), *keys).limit(n)


def value_counts(plays: DataFrame, key: str) -> DataFrame:
    return known(plays, key).groupBy(key).agg(F.count("*").alias("n"))


def discovery(plays: DataFrame, n: int = 30) -> DataFrame:
    out = known(plays, "artist").groupBy("artist").agg(F.date_format(F.min("local_ts"), "yyyy-MM-dd").alias("first_heard"), F.count("*").alias("total_plays"))
    return out.orderBy(F.desc("total_plays"), "artist").limit(n)


def top_per_group(plays: DataFrame, group: str, key: str, n: int = 3) -> DataFrame:
    """The n keys of each group with most hours; ranked after aggregation, with a limit in each task before the shuffle."""
    totals = known(plays, group, key).groupBy(group, key).agg(F.sum("ms_played").alias("ms"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("ms"), key))
    return totals.withColumn("place", place).filter(F.col("place") <= n).select(group, key, (F.col("ms") / HOUR_MS).alias("hours"), F.col("place").cast("long").alias("place"))


def time_slot(hour: str = "hour") -> Column:
    """Late night is from 22 to 4, hour 4 included."""
    h = F.col(hour)
    return F.when((h >= 22) | (h <= 4), "late_night").when(h <= 11, "morning").when(h <= 17, "afternoon").otherwise("evening")


# ---- sessions and streaks


def with_sessions(plays: DataFrame, by: list[str], gap_minutes: float = 30, tie: str = "seq") -> DataFrame:
    """Add gap_minutes (999 for the first) and session, from 0, of each ``by``: a session ends at a longer gap.

    Rows of one ``by`` are ordered in one task, so it should be a user or, for a single listener, see ``global_sessions``.
    """
    w = Window.partitionBy(*by).orderBy("ts", tie)
    gap = F.coalesce((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 60_000_000, F.lit(999.0))
    starts = F.sum(F.when(F.col("gap_minutes") > gap_minutes, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return plays.withColumn("gap_minutes", gap).withColumn("session", (starts - F.lit(1 if gap_minutes < 999 else 0)).cast("long"))


def global_sessions(plays: DataFrame, gap_minutes: float = 30, tie: str = "seq") -> DataFrame:
    """``with_sessions`` of a single listener without one task that orders all rows.

    Rows are ordered within days. What a day needs of those before, its last time and number of sessions, comes from
    a table with a row for each day.
    """
    by_day = plays.withColumn("_day", F.to_date("ts"))
    days = by_day.groupBy("_day").agg(F.min(F.unix_micros("ts")).alias("_low"), F.max(F.unix_micros("ts")).alias("_high"))
    in_order = Window.partitionBy().orderBy("_day")
    days = days.withColumn("_before", F.lag("_high").over(in_order))
    w = Window.partitionBy("_day").orderBy("ts", tie)
    rows = by_day.join(days.select("_day", "_before"), "_day")
    gap = F.coalesce((F.unix_micros("ts") - F.coalesce(F.lag(F.unix_micros("ts")).over(w), F.col("_before"))) / 60_000_000, F.lit(999.0))
    rows = rows.withColumn("gap_minutes", gap).withColumn("_new", (F.col("gap_minutes") > gap_minutes).cast("long"))
    counts = rows.groupBy("_day").agg(F.sum("_new").alias("_n"))
    counts = counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_here", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.join(counts.select("_day", "_earlier"), "_day").withColumn("session", F.col("_earlier") + F.col("_here") - 1)
    return out.select(*plays.columns, "gap_minutes", "session")


def session_table(with_session: DataFrame, by: list[str]) -> DataFrame:
    """Start, end, plays, hours and duration of each session."""
    out = with_session.groupBy(*by, "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), plays_count(), hours())
    return out.withColumn("duration_h", (F.unix_micros("end") - F.unix_micros("start")) / 3_600_000_000)


def session_summary(sessions: DataFrame) -> DataFrame:
    """One row; longest_session is the first of the longest."""
    first = F.min_by("session", F.struct(-F.col("duration_h"), F.col("session")))
    return sessions.agg(F.count("*").alias("sessions"), F.avg("plays").alias("mean_plays"), F.avg("duration_h").alias("mean_duration_h"), F.max("duration_h").alias("max_duration_h"), first.alias("longest_session"))


def islands(days: DataFrame, by: list[str], day: str = "date") -> DataFrame:
    """Runs of consecutive days (first, last, length) of each ``by``; days are made distinct first."""
    w = Window.partitionBy(*by).orderBy(day)
    marked = days.select(*by, day).distinct().withColumn("_island", F.date_sub(F.col(day), F.row_number().over(w)))
    return marked.groupBy(*by, "_island").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("length")).drop("_island")


def streak(plays: DataFrame) -> DataFrame:
    """Active days, span, share and the longest run of days, the first of equals. Only distinct days meet in one task."""
    days = plays.select("date").distinct()
    longest = islands(days, []).agg(F.min_by(F.struct("first", "last", "length"), F.struct(-F.col("length"), F.col("first"))).alias("x"))
    span = days.agg(F.count("*").alias("active_days"), (F.datediff(F.max("date"), F.min("date")) + 1).cast("long").alias("span_days"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd")
    return span.crossJoin(longest).select("active_days", "span_days", (100.0 * F.col("active_days") / F.col("span_days")).alias("active_share"), F.col("x.length").alias("longest"), fmt("x.first").alias("streak_start"), fmt("x.last").alias("streak_end"))


def span_rollup(plays: DataFrame) -> DataFrame:
    """Plays and hours by year and month with subtotals."""
    return plays.rollup("year", "month").agg(plays_count(), hours())
