"""What several corpus operators share: white space, Arrow plumbing, spanning forests, free column names."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import cut, shared_dir  # noqa: F401  the operators take them from here

#: The white space that separates words, as a regular-expression class body and as bytes.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_BYTES = b" \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished stages that nothing refers to, before the next ones are written."""
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def count_words(c: Column) -> Column:
    """Number of runs of non-space characters; null counts 0."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices: a whole batch of texts as Python objects, or sent back at once, takes its size several times over."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, fn: Callable[[list], Iterator[tuple] | list[tuple]], schema: str, batch_rows: int = 4096) -> DataFrame:
    """Apply ``fn`` to column lists of a few rows of an Arrow batch; it gives tuples for ``schema``, which are sent in batches."""
    names = [x.split()[0] for x in schema.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(",")])

    def send(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            held: list[tuple] = []
            for row in fn([c.to_pylist() for c in batch.columns]):
                held.append(row)
                if len(held) >= batch_rows:
                    yield send(held)
                    held = []
            if held:
                yield send(held)

    assert len(names) == len(arrow)
    return df.mapInArrow(run, schema)


def forest(pairs: Iterator[tuple[int, int]] | list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect what ``pairs`` connects, at most one for each node: (node, its smallest root)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in up if root(x) != x]


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
