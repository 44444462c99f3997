"""Audio files, side tables, caches and logs; bulk work on bytes runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dsp
from tidemark.schema import FEATURES

# Formats that are accepted, and the largest upload.
FORMATS = ("wav", "mp3", "flac", "ogg", "m4a", "aac", "opus", "webm")
MOST_BYTES = 200 << 20


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def scan_library(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files below a folder: path, format, length, hash of the content, its place in a store, and what is wrong with it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = extension(F.col("path"))
    h = F.sha2("content", 256)
    rejected = F.when(~kind.isin(*FORMATS), "unsupported format").when(F.col("length") > MOST_BYTES, "too large")
    return files.select("path", kind.alias("format"), "length", h.alias("file_hash"), F.concat(F.substring(h, 1, 2), F.lit("/"), h, F.lit("."), kind).alias("store_key"), rejected.alias("rejected"), "content")


def dedup_uploads(files: DataFrame) -> DataFrame:
    """The first path of each content."""
    return files.groupBy("file_hash").agg(F.min_by(F.struct(*[c for c in files.columns if c != "file_hash"]), "path").alias("x")).select("file_hash", "x.*")


def cached(files: DataFrame, least: int = 10_000) -> DataFrame:
    """Cached downloads that are large enough to be whole."""
    return files.filter(F.col("length") > least)


def decode(files: DataFrame, rate: int = dsp.RATE) -> DataFrame:
    """(path, samples, error): WAV content as mono samples at the rate; others and clips under a second carry an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [dsp.try_decode(bytes(c), rate) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "samples": [y for y, _ in rows], "error": [e for _, e in rows]})

    return files.select("path", "content").mapInPandas(run, "path string, samples array<float>, error string")


def side_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of id to path as rows."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("track_id", "path"))


def with_paths(tracks: DataFrame, paths: DataFrame) -> DataFrame:
    """Tracks with the path of the map, or else their own id."""
    return tracks.join(paths, "track_id", "left").withColumn("path", F.coalesce("path", "track_id"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES).option("header", True).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
