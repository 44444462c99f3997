"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its byte 1-, 2- and 3-grams, hashed to ``DIMENSIONS`` and scaled to length 1.
Each language has several centroids, from spherical k-means over a bounded sample of its labelled rows; a text
gets the language of the centroid with the largest cosine. A text farther from its centroid than
``reject_ratio`` times the cosine that 99 in 100 of the language's sample reach is marked as rejected.

The fit reads at most about ``sample_rows`` rows of each language: those whose hashed doc_id is lowest. Each
language's rows meet in one task as vectors of a fixed size; the driver gets the centroids only. Prediction
reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, few

#: On sf0.001 and sf0.01 every row is at 0.46 or more of the reference; unlearned languages and gibberish are at 0.36 or less.
DIMENSIONS, CENTROIDS, SAMPLE_ROWS, REJECT_RATIO = 4096, 4, 256, 0.42
UNKNOWN = "und"
#: Bytes of a text that are turned to grams at once; grams over the border of two blocks are kept.
BLOCK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of the byte 1- to 3-grams of the lower-cased text; what is no letter counts as one space."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_SPACED).split()) + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, max(1, len(raw) - 2), BLOCK):
        x = raw[at : at + BLOCK + 2]
        last = at + BLOCK + 2 >= len(raw)
        one, two = x[: None if last else BLOCK], (x[:-1] << 8 | x[1:]) + np.uint32(1 << 24)
        two = two if last else two[:BLOCK]
        three = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        for grams in (one + np.uint32(2 << 24), two, three):
            out += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    return out


def scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times IDF, each row scaled to length 1."""
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Spherical k-means; up to k centroids and the cosine that 99 in 100 of the rows reach.

    It starts from rows at even steps of the order by cosine to the common mean. Clusters that still have under
    3 in 100 of the rows after five rounds are given up, as a few odd texts make no centroid.
    """
    order, k = np.argsort(x @ x.mean(axis=0), kind="stable"), min(k, len(x))
    centers = x[order[(2 * np.arange(k) + 1) * len(x) // (2 * k)]].copy()
    for n in range(rounds):
        of = (x @ centers.T).argmax(axis=1)
        members = np.bincount(of, minlength=len(centers))
        keep = np.flatnonzero(members >= min(members.max(), 0.03 * len(x) if n >= 5 else 1))
        fresh = np.stack([x[of == c].sum(axis=0) for c in keep])
        fresh /= np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-12)
        if len(fresh) == len(centers) and n > 5 and np.allclose(fresh, centers):
            break
        centers = fresh
    return centers, float(np.quantile((x @ centers.T).max(axis=1), 0.01))


@dataclass
class Model:
    langs: list[str]
    centroids: np.ndarray
    nearest: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None], reject_ratio: float) -> tuple[list[str], list[float], list[bool]]:
        rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            cosines = scaled(np.stack([gram_counts(texts[i]) for i in part]), self.idf) @ self.centroids.T
            for i, c, s in zip(part, cosines.argmax(axis=1).tolist(), cosines.max(axis=1).tolist(), strict=True):
                langs[i], scores[i], rejected[i] = self.langs[c], min(1.0, max(0.0, s)), s < reject_ratio * self.nearest[c]
        return langs, scores, rejected


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from learning; a null doc_id counts as an empty text, which is."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> Model:
    """Learn from ``docs`` (doc_id, text, lang), rows of a null lang or without letters left out."""
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    rank = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(F.broadcast(sizes.withColumnRenamed("lang", "_l")), F.col("lang") == F.col("_l")).filter(rank * F.col("n") < sample_rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, gram_counts(t).astype(np.float32).tobytes()) for t, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t and _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.binary())], names=["lang", "v"])

    counted = cut(sample.select("text", "lang").mapInArrow(vectors, "lang string, v binary"))

    def document_counts(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, np.float32) for v in pdf["v"]])
        return pd.DataFrame({"n": [len(x)], "v": [(x > 0).sum(axis=0).astype(np.float64).tobytes()]})

    found = counted.groupBy("lang").applyInPandas(document_counts, "n long, v binary").collect()
    n = sum(r["n"] for r in found)
    df = sum((np.frombuffer(bytes(r["v"])) for r in found), np.zeros(DIMENSIONS))
    idf = np.log((1 + n) / (1 + df)) + 0.1

    def centers(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = scaled(np.stack([np.frombuffer(v, np.float32) for v in sorted(pdf["v"])]).astype(np.float64), idf)
        c, near = cluster(x, centroids)
        return pd.DataFrame({"lang": key[0], "k": range(len(c)), "nearest": near, "v": [row.astype(np.float32).tobytes() for row in c]})

    rows = sorted(counted.groupBy("lang").applyInPandas(centers, "lang string, k long, nearest double, v binary").collect(), key=lambda r: (r["lang"], r["k"]))
    matrix = np.stack([np.frombuffer(bytes(r["v"]), np.float32) for r in rows]).astype(np.float64) if rows else np.zeros((0, DIMENSIONS))
    return Model([r["lang"] for r in rows], matrix, np.array([r["nearest"] for r in rows]), idf)


def classify(docs: DataFrame, model: Model, reject_ratio: float = REJECT_RATIO) -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected, which replace columns so named.

    * A null text or one without a letter is ``und`` with score 0, and rejected. So is every text if nothing was learned.
    * Of centroids at the same distance the first by language and number wins.
    * Repeated rows get the same answer; other columns stay as they are; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at, schema = kept.index("text"), docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            langs, scores, rejected = sent.value.predict(batch.column(at).to_pylist(), reject_ratio)
            extra = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([bool(x) for x in rejected], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*kept, "lang_pred", "score", "rejected"])

    return docs.select(*kept).mapInArrow(run, schema)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS, reject_ratio: float = REJECT_RATIO) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out and classify all of them; see ``fit`` and ``classify``."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))), sample_rows, centroids)
    return classify(docs, model, reject_ratio)
