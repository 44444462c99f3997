"""Token counts by a separator scan of flat token files.

Flat files hold token ids of a fixed width, each document's followed by the end-of-document id, and nothing
else: no index, no lengths. A file is cut into blocks that are read independently; in each one vectorised
search finds the end-of-document ids. A block knows the documents that lie within it and what sticks out at
its head and tail. A prefix scan over the blocks (within groups of ``GROUP`` blocks, and over the groups)
gives each the number of documents before it and where the last of them ended, which stitches the rest.

``write_token_files`` makes such files from texts. A task writes one file named after its attempt in the shared
folder and reports the documents in it; only what committed tasks report counts, so a lost executor's
half-written file is never read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut
from tidemark.storage import own_folder

#: Bytes of a block, and blocks that the lower level of the prefix scan takes together.
BLOCK_BYTES, GROUP = 4 << 20, 1024
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE vocabularies of this kind split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary file goes to every task; files beyond this size are refused.
VOCABULARY_BYTES = 16 << 20


def open_folder(uri: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    if ":/" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def read_vocabulary(path: str) -> bytes:
    raw = Path(path).read_bytes()
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(raw)} bytes; at most {VOCABULARY_BYTES} are sent to tasks")
    return raw


def encoder(vocabulary: bytes):
    """Encoding without special tokens: their strings in a text are ordinary text."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, folder: str, vocabulary: bytes, separator: int, width: int = 2) -> DataFrame:
    """Write the texts of ``docs`` (doc_id, text) and return (file, ordinal, doc_id) for what was written.

    ``width`` is the bytes of an id. A null text is written as an empty document.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, system, path, out, n = None, None, None, None, 0
        file = TaskContext.get().taskAttemptId()
        end = np.array([separator], f"<u{width}").tobytes()
        try:
            for batch in batches:
                if not len(batch):
                    continue
                if out is None:
                    encode = encoder(sent.value).encode_to_numpy
                    system, path = open_folder(folder)
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{file}.bin")
                for text in batch.column(1):
                    if said := text.as_py():
                        out.write(encode(said).astype(f"<u{width}").tobytes())
                    out.write(end)
                m = len(batch)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, file, np.int64)), pa.array(np.arange(n, n + m)), batch.column(0)], names=["file", "ordinal", "doc_id"])
                n += m
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut(rows.mapInArrow(run, "file long, ordinal long, doc_id long"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the token files of a folder; the files themselves are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")


def scan_blocks(files: DataFrame, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of ``files`` (path, length): path, block, base and tokens, first and last separator, inner lengths."""
    step = max(1, block_bytes // width) * width
    blocks = files.filter(F.col("length") >= width).select("path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {step})")).alias("block"))
    dealt = blocks.repartition("path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = open_folder(path)
                size = min(step, length // width * width - block * step)
                with system.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(max(0, size), block * step), f"<u{width}")
                at = np.flatnonzero(ids == separator)
                base = block * (step // width)
                first, last = (base + int(at[0]), base + int(at[-1])) if len(at) else (None, None)
                values = [[path], [block], [base], [len(ids)], [len(at)], [first], [last], [(np.diff(at) - 1).tolist()]]
                types = [pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["path", "block", "base", "tokens", "ends", "first", "last", "inner"])

    return dealt.mapInArrow(run, "path string, block long, base long, tokens long, ends long, first long, last long, inner array<long>")


def stitch(blocks: DataFrame) -> DataFrame:
    """(path, ordinal, n_tokens) for each document of scanned ``blocks``; one without an end at the file's end counts if it has a token."""
    grouped = blocks.withColumn("group", F.floor(F.col("block") / GROUP))
    above = grouped.groupBy("path", "group").agg(F.sum("ends").alias("ends"), F.max("last").alias("last"))
    before = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    above = above.select("path", "group", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ends_above"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last_above"))
    within = Window.partitionBy("path", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = grouped.withColumn("ends_before", F.coalesce(F.sum("ends").over(within), F.lit(0))).withColumn("last_before", F.max("last").over(within))
    # Tables of groups, files and documents grow with the input: they are dealt by key and never sent to every task.
    placed = placed.join(above.hint("merge"), ["path", "group"])
    ordinal = F.col("ends_before") + F.col("ends_above")
    start = F.coalesce("last_before", "last_above") + 1
    lengths = F.concat(F.array(F.col("first") - start), F.col("inner"))
    ended = placed.filter("ends > 0").select("path", ordinal.alias("at"), F.posexplode(lengths).alias("k", "n_tokens"))
    ended = ended.select("path", (F.col("at") + F.col("k")).alias("ordinal"), "n_tokens")
    files = blocks.groupBy("path").agg(F.sum("tokens").alias("tokens"), F.sum("ends").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    rest = files.withColumn("n_tokens", F.col("tokens") - F.col("last") - 1).filter("n_tokens > 0").select("path", "ordinal", "n_tokens")
    return ended.unionByName(rest)


def count_tokens(files: DataFrame, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, n_tokens) for each document of flat token ``files`` (path, length), in file order from 0.

    A file without tokens has no document; bytes beyond a whole number of ids are left out.
    """
    return stitch(scan_blocks(files, separator, width, block_bytes))


def document_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs`` (doc_id, text), counted in the flat files that are made of them.

    * Null and empty texts have 0 tokens. The end-of-document id is not counted, and its name in a text is ordinary text.
    * Repeated rows are counted each; a null doc_id is carried along. Other columns are not looked at. There are no ties.
    * Very long texts are encoded whole by their task, and their ids may span any number of blocks.
    * An empty table gives an empty result. The token files are deleted when the counts are written, or when that fails.
    * A document whose count is not found is an error and no null.
    """
    spark = docs.sparkSession
    raw = read_vocabulary(vocabulary)
    separator = 1 + max(int(line.split()[1]) for line in raw.splitlines())
    width = 2 if separator < 1 << 16 else 4
    with own_folder(spark, "tokens") as folder:
        written = write_token_files(docs, folder, raw, separator, width)
        if written.isEmpty():
            return written.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
        of_file = F.regexp_extract("path", r"([0-9]+)\.bin$", 1).cast("long")
        # What a task that was tried again has left behind is not read.
        files = list_files(spark, folder).withColumn("file", of_file).join(written.select("file").distinct().hint("merge"), "file", "left_semi").drop("file")
        counted = count_tokens(files, separator, width, block_bytes).withColumn("file", of_file).drop("path")
        lost = F.raise_error(F.lit("a document that was written has no count")).cast("long")
        found = written.join(counted.hint("merge"), ["file", "ordinal"], "left")
        return cut(found.select("doc_id", F.coalesce("n_tokens", lost).alias("n_tokens")))
