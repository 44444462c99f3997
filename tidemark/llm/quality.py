"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Five counts of each text become a vector of transformed statistics. For each language and source a minimum
covariance determinant estimate gives centre and scatter of the bulk, and a text whose squared Mahalanobis
distance is beyond the chi-square quantile of ``TAIL`` is an outlier. Two fixed base rules come first.

The estimate is the subset of ``BULK`` of the rows whose scatter (with ``FLOORS``, so that statistics which most
texts do not have stay regular) has the least determinant. The search starts from four estimates made of all rows
(robust scales, correlations of squashed values, of directions, and the moments of the inner half) and ``DRAWN``
of about ``DRAW`` rows each, drawn by hash. Each takes concentration steps: distances of all rows, the nearest ``BULK`` of them, their mean and covariance. A step never
raises the determinant. After ``TRIALS`` steps the ``BEST`` starts of least determinant go on until none falls by
``TOLERANCE`` any more, and the least is taken.

A step is two grouped sums over all rows, combined before the shuffle: counts by fine distance bins, which tell how
far the bulk reaches, and moments up to there. No group's rows ever meet in a task.

Small groups lean on larger ones: the estimate of a language and source with n rows has the weight n / (n + ``LEAN``),
that of its language the rest, which leans on that of all rows alike, and that on ``WIDE``. The mixture's scatter
counts the distance of the centres, so language and source are in force from the first row on, with no threshold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_BYTES, cut

SYMBOLS = "#*$%&|<>"
BULK, LEAN, DRAWN, DRAW, TRIALS, BEST, TOLERANCE = 0.75, 6, 8, 9, 2, 3, 1e-3
#: Groups whose estimates are sent to every task, at most; each of up to four takes about 500 bytes.
BROADCAST_GROUPS = 10_000
#: Share of normal rows that may be called outliers. Of the rows of sf0.1 that pass the base rules, its quantile takes 199 of 301
#: labelled as bad and 12 of 3330 labelled as good; 1e-4 would take 280 and 22, 1e-6 169 and 4.
TAIL = 1e-5
#: Scatter of three quarters of normal rows in 5 dimensions is this much too small.
CONSISTENCY = 1.41
#: Least standard deviation of each statistic; most texts have no symbol or repeat at all, which has no scatter.
FLOORS = (0.3, 0.1, 0.5, 0.5, 0.5)
#: Standard deviations taken where there are hardly any rows at all.
WIDE = (2.0, 0.5, 1.5, 1.5, 1.5)
#: Half of normal rows in 5 dimensions are within this squared distance.
INNER = 4.35
#: Distance bins to a doubling.
FINE = 32
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]


def cutoff(tail: float = TAIL) -> float:
    """Squared distance that a share of ``tail`` of normal rows in 5 dimensions exceeds."""
    beyond = lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if beyond(mid) > tail else (low, mid)
    return low


def repeated_words(words: list[bytes]) -> int:
    """Words in 5-word windows that are found twice or more, the first one's included."""
    n = len(words) - 4
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = sum((h[k : k + n] * _MIX[k] for k in range(5)), np.zeros(n, np.uint64))
    order = np.sort(keys)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(keys, again)).tolist()
    windows = [tuple(words[i : i + 5]) for i in at]
    found = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, windows, strict=True):
        if found[w] > 1:
            covered[i] += 1
            covered[i + 5 : i + 6] -= 1
    return int((np.cumsum(covered[: len(words)]) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts of ``STATS``; a null text has none."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(SPACE_BYTES.decode()):
            seen.add(line)
    spaces = sum(text.count(c) for c in SPACE_BYTES.decode())
    return len(words), len(text) - spaces, sum(text.count(c) for c in SYMBOLS), dup_lines, repeated_words(words)


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_stats(t.as_py()) for t in batch.column(3)]
            counts = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *counts], names=["doc_id", "lang", "source", *STATS])

    columns = [F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS))


def _vector() -> list[Column]:
    c = F.col
    rate = lambda part, whole: F.log1p(100 * c(part) / (c(whole) + 1))
    return [F.log1p("n_words"), F.log((c("word_chars") + 1) / (c("n_words") + 1)), rate("n_symbols", "word_chars"), rate("n_dup_lines", "n_words"), rate("n_repeat_words", "n_words")]


def _spread(pdf: pd.DataFrame) -> pd.DataFrame:
    """Median and quartile range of each statistic of a group from its histogram."""
    center, scale = [], []
    for k in range(5):
        x = pdf[pdf["k"] == k].sort_values("bin")
        share = x["n"].cumsum().to_numpy() / x["n"].sum()
        low, mid, high = (x["bin"].to_numpy()[np.searchsorted(share, q)] / 50 for q in (0.25, 0.5, 0.75))
        center.append(mid)
        scale.append(max((high - low) / 1.349, FLOORS[k]))
    return pd.DataFrame({"g": pdf["g"].iloc[:1], "center": [center], "scale": [scale]})


def _matrix(products: np.ndarray) -> np.ndarray:
    """The symmetric matrix of 15 products."""
    out = np.empty((5, 5))
    for (i, j), v in zip(_PAIRS, products, strict=True):
        out[i, j] = out[j, i] = v
    return out


def _products(v: list[Column], weight: Column | None = None) -> Column:
    return F.array(*[F.sum(v[i] * v[j] if weight is None else weight * v[i] * v[j]) for i, j in _PAIRS])


def _fitted(cov: np.ndarray) -> tuple[list[float], float]:
    """Inverse and log determinant of a subset's scatter, made regular."""
    scatter = CONSISTENCY * cov + np.diag(np.square(FLOORS))
    return np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])


ESTIMATE = "g long, start int, n long, center array<double>, cov array<double>, precision array<double>, logdet double"


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The four first estimates of each group from its sums over standardized rows."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            center, scale = np.array(r.center), np.diag(r.scale)
            shapes = [np.eye(5)]
            for products in (r.squashed, r.directions):
                m = _matrix(products) / r.n
                sd = np.sqrt(np.maximum(np.diag(m), 1e-9))
                shapes.append(0.95 * m / np.outer(sd, sd) + 0.05 * np.eye(5))
            mean = np.array(r.inner) / r.n_inner if r.n_inner else np.zeros(5)
            cov = _matrix(r.inner_products) / r.n_inner - np.outer(mean, mean) if r.n_inner else np.eye(5)
            shapes.append(cov + 0.05 * np.eye(5))
            for k, shape in enumerate(shapes):
                own = center + (scale @ mean if k == 3 else 0)
                out.append((r.g, k, r.n, own.tolist(), [], np.linalg.inv(scale @ shape @ scale).ravel().tolist(), math.inf))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ESTIMATE.split(", ")])


def _drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First estimates from drawn rows; of under two there is none."""
    for pdf in batches:
        out = []
        for r in pdf[pdf["n_near"] > 1].itertuples():
            mean = np.array(r.s) / r.n_near
            precision, _ = _fitted(_matrix(r.ss) / r.n_near - np.outer(mean, mean))
            out.append((r.g, r.start, r.n, mean.tolist(), [], precision, math.inf))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ESTIMATE.split(", ")])


def _last_bin(bins: Column, most: Column) -> Column:
    """Struct of the first distance bin, of a group's (bin, n) in order, up to which there are ``most`` rows, and the share of it that makes up ``most``."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(None).cast("int").alias("bin"), F.lit(0.0).alias("own"))
    step = lambda acc, x: F.when(acc["n"] >= most, acc).otherwise(F.struct((acc["n"] + x["n"]).alias("n"), x["bin"].alias("bin"), x["n"].cast("double").alias("own")))
    return F.aggregate(bins, start, step, lambda acc: F.struct(acc["bin"].alias("bin"), (1 - (acc["n"] - most) / acc["own"]).alias("share")))


def _moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Estimates from the bulk's moments; ``fell`` by how much the log determinant is less than before."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            mean = np.array(r.s) / r.n_near
            cov = _matrix(r.ss) / r.n_near - np.outer(mean, mean)
            precision, logdet = _fitted(cov)
            out.append((r.g, r.start, r.n, mean.tolist(), cov.ravel().tolist(), precision, logdet, r.logdet - logdet))
        yield pd.DataFrame(out, columns=[*[x.split()[0] for x in ESTIMATE.split(", ")], "fell"])


def _distance() -> Column:
    """Squared Mahalanobis distance of x from center."""
    diffs = [F.col("x")[k] - F.col("center")[k] for k in range(5)]
    terms = [diffs[i] * diffs[j] * F.col("precision")[5 * i + j] * (1 if i == j else 2) for i, j in _PAIRS]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _sent(estimates: DataFrame, groups: int) -> DataFrame:
    """While there are few estimates they go to every task, so that no row is dealt by its group; beyond that the join
    is a shuffled one, whose skewed partitions Spark splits."""
    return F.broadcast(estimates) if groups <= BROADCAST_GROUPS else estimates


def _step(bulk: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """One concentration step of each estimate (g, start)."""
    far = F.floor(FINE * F.log2(_distance() + 1e-3)).cast("int")
    near = bulk.join(_sent(estimates, groups), "g").withColumn("bin", far)
    # Bins are added up before they are dealt by group: else each task's part of every bin would go there.
    bins = cut(near.groupBy("g", "start", "bin").agg(F.count("*").alias("n")))
    last = bins.groupBy("g", "start").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), (BULK * F.sum("n")).alias("most"))
    last = last.select("g", "start", _last_bin(F.col("bins"), F.col("most")).alias("last"))
    # Rows beyond get no weight, those of the last bin the share that the bulk needs. They are not filtered: a filter on the distance would become the join's condition, which computes
    # each of its parts again wherever they are used.
    near = bulk.join(_sent(estimates.join(last, ["g", "start"]), groups), "g").withColumn("bin", far)
    weight = F.when(F.col("bin") < F.col("last.bin"), 1.0).when(F.col("bin") == F.col("last.bin"), F.col("last.share")).otherwise(0.0)
    near = near.select("g", "start", weight.alias("w"), *[F.col("x")[k].alias(f"x{k}") for k in range(5)])
    x = [F.col(f"x{k}") for k in range(5)]
    moments = near.groupBy("g", "start").agg(F.sum("w").alias("n_near"), F.array(*[F.sum(F.col("w") * v) for v in x]).alias("s"), _products(x, F.col("w")).alias("ss"))
    moments = moments.join(estimates.select("g", "start", "n", "logdet"), ["g", "start"])
    return cut(moments.mapInPandas(_moved, f"{ESTIMATE}, fell double"))


def fit(bulk: DataFrame) -> DataFrame:
    """The minimum covariance determinant estimate of each group of ``bulk`` (g long, x array of 5): g, n, center, cov (of the subset, 25 numbers), logdet."""
    bins = cut(bulk.select("g", F.posexplode("x").alias("k", "v")).groupBy("g", "k", F.floor(F.col("v") * 50).alias("bin")).agg(F.count("*").alias("n")))
    spread = cut(bins.groupBy("g").applyInPandas(_spread, "g long, center array<double>, scale array<double>"))
    z = [(F.col("x")[k] - F.col("center")[k]) / F.col("scale")[k] for k in range(5)]
    groups = spread.count()
    rows = bulk.join(_sent(spread, groups), "g").select("g", *[v.alias(f"z{k}") for k, v in enumerate(z)])
    z = [F.col(f"z{k}") for k in range(5)]
    size = sum((v * v for v in z[1:]), z[0] * z[0])
    inner, length = F.when(size <= INNER, 1.0).otherwise(0.0), F.sqrt(size + 1e-9)
    sums = rows.groupBy("g").agg(
        F.count("*").alias("n"), _products([F.tanh(v) for v in z]).alias("squashed"), _products([v / length for v in z]).alias("directions"),
        F.sum(inner).cast("long").alias("n_inner"), F.array(*[F.sum(v * inner) for v in z]).alias("inner"), _products([v * inner for v in z]).alias("inner_products"),
    )
    made = cut(sums.join(spread, "g").mapInPandas(_starts, ESTIMATE))
    draw = F.filter(F.sequence(F.lit(4), F.lit(3 + DRAWN)), lambda k: F.pmod(F.xxhash64(k, "x"), F.lit(1 << 30)) * F.col("n") < DRAW * (1 << 30))
    few = bulk.join(_sent(made.filter("start = 0").select("g", "n"), groups), "g").select("g", "n", "x", F.explode(draw).alias("start"))
    x = [F.col("x")[k] for k in range(5)]
    few = few.groupBy("g", "start").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), F.array(*[F.sum(v) for v in x]).alias("s"), _products(x).alias("ss"))
    moving = made.unionByName(cut(few.mapInPandas(_drawn, ESTIMATE)))
    for _ in range(TRIALS):
        moving = _step(bulk, moving.drop("fell"), groups)
    ranked = moving.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("logdet", "start", F.struct(*moving.columns).alias("e")))).alias("all"))
    best = ranked.select(F.explode(F.slice("all", 1, BEST)).alias("x")).select("x.e.*")
    settled, moving = best, best
    while not moving.isEmpty():
        stepped = _step(bulk, moving.drop("fell"), groups)
        settled = settled.unionByName(stepped)
        moving = stepped.filter(F.col("fell") > TOLERANCE)
    least = settled.groupBy("g").agg(F.min_by(F.struct("n", "center", "cov", "logdet"), F.struct("logdet", "start")).alias("e"))
    return least.select("g", "e.*")


def _mixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre and precision of each language and source from its estimate, its language's and that of all rows."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            center, scatter = np.array(r.all_center), np.diag(np.square(WIDE))
            for n, own, cov in ((r.all_n, r.all_center, r.all_cov), (r.lang_n, r.lang_center, r.lang_cov), (r.own_n, r.own_center, r.own_cov)):
                w, d = n / (n + LEAN), np.array(own) - center
                scatter = w * CONSISTENCY * np.array(cov).reshape(5, 5) + (1 - w) * scatter + w * (1 - w) * np.outer(d, d)
                center = center + w * d
            out.append((r.g, center.tolist(), np.linalg.inv(scatter + np.diag(np.square(FLOORS))).ravel().tolist()))
        yield pd.DataFrame(out, columns=["g", "center", "precision"])


def _group(*columns: str) -> Column:
    """Number of a group: hashed from JSON, which has null and text apart."""
    return F.xxhash64(F.to_json(F.struct(F.lit(len(columns)).alias("level"), *columns)))


def _estimates(rows: DataFrame) -> DataFrame:
    """(g, center, precision) for each language and source of ``rows`` (g, g_lang, g_all, x), fitted to all of them."""
    fitted = fit(rows.select("x", F.explode(F.array("g", "g_lang", "g_all")).alias("g")))
    groups = rows.groupBy("g").agg(F.first("g_lang").alias("g_lang"), F.first("g_all").alias("g_all"))

    def of(key: str, name: str) -> DataFrame:
        return fitted.select(F.col("g").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "center", "cov")])

    joined = groups.join(of("g", "own"), "g").join(of("g_lang", "lang"), "g_lang").join(of("g_all", "all"), "g_all")
    return cut(joined.mapInPandas(_mixed, "g long, center array<double>, precision array<double>"))


def rate(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): doc_id, the counts of ``STATS``, base_failed, kept, distance.

    * A null text counts as empty, which fails the base rules: under 10 words, or over 20 in 100 of the words repeated.
    * Null languages and sources are values of their own. Repeated rows are rated alike; a null doc_id is carried along.
    * Very long texts are counted whole; one must fit in a task's memory a few times.
    * Estimates come from rows that pass the base rules. ``distance`` is null in a language and source without any,
      whose rows have failed. Distances that equal the cutoff pass; of starts with equal determinants the first counts.
    * Other columns are not looked at. An empty table gives an empty result.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = with_stats(docs).withColumns({"base_failed": failed, "x": F.array(*_vector()), "g": _group("lang", "source"), "g_lang": _group("lang"), "g_all": _group()})
    rows = cut(stats.drop("lang", "source"))
    estimates = _estimates(rows.filter("not base_failed"))
    rated = rows.join(_sent(estimates, estimates.count()), "g", "left").withColumn("distance", F.when(F.col("center").isNotNull(), _distance()))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff(tail), F.lit(True))
    return rated.select("doc_id", *STATS, "base_failed", verdict.alias("kept"), "distance")
