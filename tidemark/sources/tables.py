"""Parquet tables, and play events made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(c: Column) -> Column:
    """A timestamp without zone as one in UTC (the session's zone is UTC)."""
    return c.cast("timestamp")


def local_parts(plays: DataFrame, tz: str = "Asia/Kolkata") -> DataFrame:
    """Add local time, its calendar parts and derived units to plays (ts, ms_played)."""
    at = F.from_utc_timestamp("ts", tz)
    return plays.withColumns({
        "local_ts": at,
        "date": F.to_date(at),
        "hour": F.hour(at),
        "dow": F.date_format(at, "EEEE"),
        "month": F.date_format(at, "yyyy-MM"),
        "year": F.year(at),
    })


def plays_from_events(spark: SparkSession, sf_dir: str, tz: str = "Asia/Kolkata") -> DataFrame:
    """Events as plays: the type is the track, the user the artist, the value the seconds played."""
    ms = F.floor(F.col("value") * 1000 + 0.5)
    plays = load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        utc(F.col("ts")).alias("ts"),
        ms.alias("ms_played"),
        F.col("event_type").alias("track"),
        F.col("user_id").cast("string").alias("artist"),
        F.get_json_object("props", "$.k").alias("album"),
        (F.col("event_type") == "error").alias("skipped"),
        (ms < 30_000).alias("short_play"),
        (F.col("event_id") % 3 == 0).alias("shuffle"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 7 == 0).alias("offline"),
    )
    return local_parts(plays, tz)


def plays_from_lineitem(spark: SparkSession, sf_dir: str, tz: str = "Asia/Kolkata") -> DataFrame:
    """Order lines as plays: the part's name is the track, the supplier the artist, the brand the album.

    Orders and lines are joined on their key; parts and suppliers follow by plain joins, which the optimizer
    broadcasts while they are small and shuffles when they are not.
    """
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    ms = (F.col("l_quantity") * 1000).cast("long")
    plays = joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        utc(F.col("o_orderdate")).alias("ts"),
        ms.alias("ms_played"),
        F.col("p_name").alias("track"),
        F.col("s_name").alias("artist"),
        F.col("p_brand").alias("album"),
        (F.col("l_returnflag") == "R").alias("skipped"),
        (ms < 5_000).alias("short_play"),
        F.col("o_orderpriority").alias("reason_start"),
        F.col("o_orderstatus").alias("reason_end"),
        F.col("l_linestatus").alias("platform"),
    )
    return local_parts(plays, tz)
