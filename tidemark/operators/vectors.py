"""Similarity of vectors: exact and cell-probed nearest neighbours, centroids, normalization, feature vectors.

Vectors are compared in packed blocks: rows are gathered into blocks of a fixed size, a block of queries meets a
block of vectors in one matrix product, and only the best k of each block go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

BLOCK, QUERY_BLOCK = 4096, 512


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Scaled to length 1; a null vector if it has no length."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def mean_pool(frames: Column) -> Column:
    """Element-wise mean of an array of vectors of one size."""
    total = F.aggregate(F.slice(frames, 2, F.size(frames)), F.transform(frames[0], lambda x: x.cast("double")), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(frames))


def pack(vectors: DataFrame, size: int, by: list[str]) -> DataFrame:
    """Rows (id, vector, ...by) as blocks: ``by``, n, ids and values (binary); a task's rows at most ``size`` to a block."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*by).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        types: dict = {}

        def send(key: tuple, rows: list) -> pa.RecordBatch:
            ids, x = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            values = [*[pa.array([k], types[b]) for k, b in zip(key, by, strict=True)], [len(rows)], [ids.tobytes()], [x.tobytes()]]
            return pa.RecordBatch.from_pydict(dict(zip([*by, "n", "ids", "x"], values, strict=True)))

        for batch in batches:
            rows = batch.to_pydict()
            types.update({b: batch.schema.field(b).type for b in by})
            for i, (id_, v) in enumerate(zip(rows["id"], rows["vector"], strict=True)):
                if not v:
                    continue
                key = tuple(rows[b][i] for b in by)
                held.setdefault(key, []).append((id_, v))
                if len(held[key]) >= size:
                    yield send(key, held.pop(key))
        for key, rows in held.items():
            yield send(key, rows)

    return vectors.select("id", "vector", *by).mapInArrow(run, f"{schema}{', ' * bool(by)}n long, ids binary, x binary")


def _best_of_pairs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, v = (np.frombuffer(r[c]).reshape(r[n], -1) for c, n in (("qx", "qn"), ("x", "n")))
                qi, vi = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64)
                d = 1 - q @ v.T
                d[qi[:, None] == vi[None, :]] = np.inf
                # All that are no farther than the k-th; of those at the same distance the smallest ids stay.
                last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                row, at = np.nonzero((d <= last[:, None]) & np.isfinite(d))
                order = np.lexsort((vi[at], d[row, at], row))
                row, at = row[order], at[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, at = row[place < k], at[place < k]
                yield pa.RecordBatch.from_pydict({"query_id": qi[row], "id": vi[at], "distance": d[row, at]})

    return run


def _rank(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """(query_id, id, distance, place): the k nearest by cosine distance of the same ``by`` (such as a model version), itself left out.

    A stated set of queries against all rows, block by block; the product of the blocks is dealt over all tasks.
    """
    by = by or []
    q = pack(queries, QUERY_BLOCK, by).withColumnsRenamed({"n": "qn", "ids": "qids", "x": "qx"})
    v = pack(vectors, BLOCK, by)
    pairs = v.join(q, by) if by else v.crossJoin(q)
    return _rank(pairs.select("qn", "qids", "qx", "n", "ids", "x").mapInArrow(_best_of_pairs(k), "query_id long, id long, distance double"), k)


def weighted_centroids(vectors: DataFrame, key: str, weight: str) -> DataFrame:
    """Centroid of each key, weights of 0 or null counting 1; sums are taken for each position, so no group meets in one task."""
    w = F.coalesce(F.nullif(F.col(weight).cast("double"), F.lit(0.0)), F.lit(1.0))
    each = vectors.select(key, w.alias("w"), F.posexplode("vector").alias("pos", "x"))
    sums = each.groupBy(key, "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


def with_tracks(vectors: DataFrame, tracks: DataFrame, key: str = "id") -> DataFrame:
    """Vectors (or neighbours) with the columns of their tracks; those of unknown tracks are left out."""
    return vectors.join(tracks, key)


def centroid_search(queries: DataFrame, vectors: DataFrame, key: str, weight: str, k: int) -> DataFrame:
    """(query_id, id, distance, place): the keys whose weighted centroids are nearest to each query. ``key`` is a whole number."""
    centroids = weighted_centroids(vectors, key, weight).select(F.col(key).cast("long").alias("id"), "vector")
    # Queries and keys are numbered apart, so that no query is taken for the centroid of the same number.
    found = knn(queries.select((-1 - F.col("id")).alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("vector")), centroids, k)
    return found.withColumn("query_id", -1 - F.col("query_id"))


# ---- cells


def fit_cells(vectors: DataFrame, n_cells: int, sample_rows: int = 20_000, rounds: int = 15) -> np.ndarray:
    """Spherical k-means centres from a bounded sample: the rows with the least hashed ids, ``sample_rows`` at most on average."""
    total = vectors.count()
    share = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(1, total)) * (1 << 30))
    rows = vectors.filter(share).select("id", "vector").orderBy("id").limit(2 * sample_rows).collect()
    x = np.array([r["vector"] for r in rows if r["vector"]], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centers = x[np.random.default_rng(5).choice(len(x), min(n_cells, len(x)), replace=False)]
    for _ in range(rounds):
        of = (x @ centers.T).argmax(axis=1)
        centers = np.stack([x[of == c].mean(axis=0) if (of == c).any() else centers[c] for c in range(len(centers))])
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
    return centers


def with_cells(vectors: DataFrame, centers: np.ndarray, n: int = 1) -> DataFrame:
    """``vectors`` with cell: a row for each of the n nearest cells."""
    sent = vectors.sparkSession.sparkContext.broadcast(centers)
    kept = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [i for i, v in enumerate(batch.column("vector").to_pylist()) if v]
            if rows:
                batch = batch.take(pa.array(rows))
                x = np.array(batch.column("vector").to_pylist(), np.float64)
                m = min(n, len(sent.value))
                near = np.argsort(-(x @ sent.value.T), axis=1, kind="stable")[:, :m]
                out = batch.take(pa.array(np.repeat(np.arange(len(rows)), m)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel(), pa.int64())], names=[*kept, "cell"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("cell", LongType())]))


def knn_cells(queries: DataFrame, vectors: DataFrame, k: int, n_cells: int | None = None, probes: int | None = None) -> DataFrame:
    """``knn`` over the nearest cells of each query only. Every vector is in a cell; the cells come from a sample.

    Two thirds of the cells are looked at unless told otherwise, which finds nine in ten of the nearest even among
    vectors without clusters, where no index can do with few; for clustered ones say how many ``probes`` do.
    """
    n_cells = n_cells or max(1, int(2 * vectors.count() ** 0.5))
    probes = probes or max(-(-2 * n_cells // 3), 8)
    centers = fit_cells(vectors, n_cells)
    found = knn(with_cells(queries, centers, probes), with_cells(vectors, centers), k, ["cell"])
    return found.drop("place").dropDuplicates(["query_id", "id"]).transform(lambda d: _rank(d, k))


# ---- feature vectors


@lru_cache
def projection(size: int = 42, to: int = 128, seed: int = 42) -> np.ndarray:
    """A fixed random matrix; the seeded generator gives the same one everywhere."""
    return (np.random.RandomState(seed).randn(size, to).astype(np.float32) / np.sqrt(size)).astype(np.float32)


def feature_vectors(features: DataFrame, id_: str = "id") -> DataFrame:
    """(id, vector) of 128 from features: ten scaled, the key as one of twelve, 20 aggregates of the analysis (array extra, may be null)."""
    c = F.col
    base = F.array(*[c(x).cast("double") for x in ("danceability", "energy", "valence", "speechiness", "acousticness", "instrumentalness", "liveness")], (c("loudness") + 60) / 60, c("tempo") / 250, c("mode").cast("double"))
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.when(k == c("key"), 1.0).otherwise(0.0))
    extra = F.coalesce(c("extra"), F.array_repeat(F.lit(0.0), 20)) if "extra" in features.columns else F.array_repeat(F.lit(0.0), 20)
    whole = features.select(c(id_).alias("id"), F.concat(base, one_hot, extra).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = np.stack(pdf["v"]).astype(np.float64) @ projection().astype(np.float64)
            z = z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-8)
            yield pd.DataFrame({"id": pdf["id"], "vector": list(z.astype(np.float32))})

    return whole.mapInPandas(run, f"id {features.schema[id_].dataType.simpleString()}, vector array<float>")
