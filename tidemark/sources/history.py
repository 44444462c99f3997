"""Exported listening history: files of JSON arrays, read with a fixed schema, broken rows kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import uri_id
from tidemark.schema import HISTORY

# How an export names its files and fields.
FILES = "Streaming_History_Audio_*.json"
TRACK, ARTIST, ALBUM = "master_metadata_track_name", "master_metadata_album_artist_name", "master_metadata_album_album_name"
#: What the track's URI is called here; an export has a name of its own for it.
URI = "track_uri"


def read_history(spark: SparkSession, folder: str, year: int | None = None, any_json: bool | None = None, uri_field: str = URI) -> DataFrame:
    """Raw rows of all files below ``folder`` with source_file; a file that is no JSON is one row with _corrupt_record.

    ``uri_field`` is the export's name of the field that has the track's URI. ``year`` keeps to files whose name has it.
    ``any_json`` reads every JSON file; left open, that is done if no file has the usual name.
    """
    reader = spark.read.schema(f"{HISTORY}, `{uri_field}` string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")

    def matching(pattern: str) -> DataFrame:
        return reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder)

    usual = FILES if year is None else FILES.replace("*.", f"*{year}*.")
    rows = matching(usual)
    if any_json or (any_json is None and not rows.inputFiles()):
        rows = matching("*.json" if year is None else f"*_{year}*.json")
    return rows.withColumnRenamed(uri_field, URI).withColumn("source_file", F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0))


def parse_time(c: Column) -> Column:
    """ISO time with or without zone; without one it is in UTC."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(F.concat(c, F.lit("Z"))))


def row_class(strict: bool = True) -> Column:
    """What a raw row is: unreadable, non_music, bad_row or track. Strict parsing wants an artist and no empty names."""
    named = F.col(TRACK).isNotNull() & ((F.col(TRACK) != "") & F.col(ARTIST).isNotNull() & (F.col(ARTIST) != "") if strict else F.lit(True))
    return F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(~named, "non_music").when(parse_time(F.col("ts")).isNull(), "bad_row").otherwise("track")


def parse(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Plays of raw rows: names shortened, times read, milliseconds 0 if missing, ids from track URIs only."""
    rows = raw.filter(row_class(strict) == "track")
    out = rows.select(
        parse_time(F.col("ts")).alias("ts"), F.coalesce("ms_played", F.lit(0)).cast("long").alias("ms_played"), F.col(TRACK).alias("track"), F.col(ARTIST).alias("artist"), F.col(ALBUM).alias("album"),
        uri_id(F.col(URI)).alias("external_id"), "platform", F.col("conn_country").alias("country"), "reason_start", "reason_end", "shuffle", "skipped", "offline", F.col("incognito_mode").alias("incognito"), "source_file",
    )
    return out.withColumn("short_play", F.col("ms_played") < 30_000)


def parse_stats(raw: DataFrame) -> DataFrame:
    """One row: files, rows, tracks, and rows of each other class."""
    c = raw.withColumn("_c", row_class())
    count = lambda k: F.count_if(F.col("_c") == k)
    readable = F.countDistinct(F.when(F.col("_c") != "unreadable", F.col("source_file")))
    return c.agg(readable.alias("files"), F.count_if(F.col("_c") != "unreadable").alias("rows"), count("track").alias("tracks"), count("non_music").alias("skipped_non_music"), count("bad_row").alias("bad_rows"), count("unreadable").alias("unreadable"))


def with_duration_minutes(plays: DataFrame) -> DataFrame:
    return plays.withColumn("minutes", F.col("ms_played") / 60_000).withColumn("hours", F.col("ms_played") / 3_600_000)
