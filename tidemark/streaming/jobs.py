"""Streams of jobs, results and plays: file sources here, any broker's in production.

Work is at least once: a batch is written under its number and by key, so that a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.schema import JOB, RESULT
from tidemark.sources.sinks import insert_table, upsert_table, write_index
from tidemark.storage import exists, remove, shared_dir


def json_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Messages, one JSON object to a line, of the files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return json_stream(spark, folder, JOB)


def results(spark: SparkSession, folder: str, statuses: tuple[str, ...] = ("done",)) -> DataFrame:
    """Results that can be used: of one of ``statuses``, and of a known track."""
    return json_stream(spark, folder, RESULT).filter(F.col("status").isin(*statuses) & F.col("track_id").isNotNull())


def run_batches(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Apply ``step`` to each micro-batch and write its rows, one for each key, under the number of the batch."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).dropDuplicates(keys).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """What ``run_batches`` has written, the last batch's row of each key."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*keys, "_x.*")


def to_messages(rows: DataFrame) -> DataFrame:
    """Rows as JSON messages."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def job_states(events: DataFrame) -> DataFrame:
    """The last state of each job; events (job_id, status, ts), as a batch or in complete output mode."""
    return events.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def new_uploads(uploads: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first upload of each content; on a stream repeats are known for the delay."""
    return uploads.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["file_hash"]) if uploads.isStreaming else uploads.dropDuplicates(["file_hash"])


def tumbling_counts(plays: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return plays.withWatermark("ts", delay).groupBy(F.window("ts", size)).agg(F.count("*").alias("plays"), F.sum("ms_played").alias("ms"))


def sliding_counts(plays: DataFrame, size: str = "6 hours", hop: str = "3 hours", delay: str = "1 hour") -> DataFrame:
    return plays.withWatermark("ts", delay).groupBy(F.window("ts", size, hop)).agg(F.count("*").alias("plays"))


def stream_sessions(plays: DataFrame, by: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each ``by``; the end is the last play, not the end of the gap."""
    w = F.session_window("ts", gap)
    out = plays.withWatermark("ts", delay).groupBy(by, w).agg(F.count("*").alias("plays"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return out.drop("session_window")


def drop_repeats(plays: DataFrame, by: str, value: str, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """A stream without the rows whose value is that of the row before of the same ``by``, as a poller sees them.

    ``order`` names the columns by which the rows of a micro-batch are put in order, ties included.
    """
    import pandas as pd

    fields = plays.schema

    def step(key, batches, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(list(order))
        before = rows[value].shift()
        before.iloc[0] = last
        state.update((None if pd.isna(rows[value].iloc[-1]) else str(rows[value].iloc[-1]),))
        yield rows[rows[value] != before]

    return plays.groupBy(by).applyInPandasWithState(step, fields, "last string", "append", "NoTimeout")


def run_inserts(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Add each micro-batch's rows to a table unless it has their keys: exact whatever the stream's state has forgotten."""
    return stream.writeStream.foreachBatch(lambda batch, _: insert_table(batch, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_upserts(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """``step`` of each micro-batch replaces what a table has of its keys, as embeddings follow finished jobs; a repeated batch changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: upsert_table(step(batch), path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebuild_index(spark: SparkSession, vectors: str, out: str, n_cells: int) -> None:
    """Write the index of a vector table anew."""
    write_index(spark.read.parquet(vectors), out, n_cells)


def rebuild_periodically(spark: SparkSession, vectors: str, out: str, n_cells: int, every: str = "600 seconds") -> StreamingQuery:
    """Rebuild the index at each tick for as long as the query runs."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: rebuild_index(spark, vectors, out, n_cells)).trigger(processingTime=every).start()


def write_messages(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery | None:
    """Rows of a batch or a stream as JSON messages, one to a line, for the next reader."""
    messages = to_messages(rows)
    if not rows.isStreaming:
        messages.write.mode("append").text(folder)
        return None
    return messages.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """All that a stream gives now, run to its end, as a Parquet table in the shared folder.

    ``append`` adds each micro-batch under its number, ``complete`` replaces the table; nothing comes to the driver.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{'all' if mode == 'complete' else number}")

    done = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    done.awaitTermination()
    remove(spark, f"{folder}-state")
    if not exists(spark, folder):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(folder)
