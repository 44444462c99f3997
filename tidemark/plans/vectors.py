"""Queries over vectors. Searches ask for every row whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.operators import vectors as V
from tidemark.plans.registry import query
from tidemark.sources.tables import load


def vectors(spark, sf):
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_D = "CAST(embedding AS DOUBLE[])"


@query(f"""WITH v AS (SELECT vec_id AS id, {_D} AS x FROM embeddings), p AS (SELECT q.id AS query_id, v.id, 1 - list_cosine_similarity(q.x, v.x) AS distance
    FROM v q, v WHERE q.id % 100 = 0 AND q.id <> v.id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM p) WHERE place <= 10""", rounded="distance")
def knn(spark, sf):
    rows = vectors(spark, sf)
    return V.knn(rows.filter("id % 100 = 0"), rows, 10)


@query(f"""WITH v AS (SELECT vec_id AS id, {_D} AS x, label FROM embeddings), p AS (SELECT q.id AS query_id, v.id, 1 - list_cosine_similarity(q.x, v.x) AS distance
    FROM v q JOIN v ON q.label = v.label WHERE q.id % 100 = 0 AND q.id <> v.id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM p) WHERE place <= 5""", rounded="distance")
def knn_same_label(spark, sf):
    rows = vectors(spark, sf)
    return V.knn(rows.filter("id % 100 = 0"), rows, 5, ["label"])


@query()
def knn_cells(spark, sf):
    """Cell-probed search; its recall is tested against the exact one."""
    rows = vectors(spark, sf)
    return V.knn_cells(rows.filter("id % 100 = 0"), rows, 10)


@query(f"""SELECT vec_id AS id, list_transform({_D}, lambda x: x / sqrt(list_inner_product({_D}, {_D}))) AS vector FROM embeddings""")
def normalized_vectors(spark, sf):
    return vectors(spark, sf).select("id", V.normalized(F.col("vector")).alias("vector"))


@query("""WITH e AS (SELECT label, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE vec_id % 5 END AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    s AS (SELECT label, pos, sum(w * x) / sum(w) AS x FROM e GROUP BY label, pos) SELECT label, list(x ORDER BY pos) AS vector FROM s GROUP BY label""")
def label_centroids(spark, sf):
    rows = load(spark, sf, "embeddings").select("label", (F.col("vec_id") % 5).alias("w"), F.col("embedding").alias("vector"))
    return V.weighted_centroids(rows, "label", "w")


@query(f"""SELECT vec_id AS id, list_avg({_D}) AS mean, list_stddev_pop({_D}) AS std, list_min({_D}) AS least, list_max({_D}) AS greatest,
    quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.99) AS p99 FROM (SELECT vec_id, embedding, unnest({_D}) AS x FROM embeddings) GROUP BY vec_id, embedding""", rounded="mean std least greatest median p99")
def row_stats(spark, sf):
    v = F.transform("vector", lambda x: x.cast("double"))
    return vectors(spark, sf).select("id", S.mean(v).alias("mean"), S.std(v).alias("std"), F.array_min(v).alias("least"), F.array_max(v).alias("greatest"), S.percentile(v, 0.5).alias("median"), S.percentile(v, 0.99).alias("p99"))


_CH = "list_transform(list_slice(CAST(embedding AS DOUBLE[]), 1, 12), lambda x: abs(x))"
_PROF = "UNION ALL ".join(f"SELECT {s} AS key, {m} AS mode, {list(p)}::DOUBLE[] AS prof " for s in range(12) for m, p in ((1, S.MAJOR), (0, S.MINOR)))


@query(f"""WITH c AS (SELECT vec_id AS id, {_CH} AS ch FROM embeddings), prof AS ({_PROF}), r AS (SELECT id, key, mode, corr(list_extract(ch, CAST((k + key) % 12 + 1 AS INTEGER)), list_extract(prof, CAST(k + 1 AS INTEGER))) AS r
    FROM c, prof, range(12) t(k) GROUP BY id, key, mode), o AS (SELECT *, row_number() OVER w AS place, lead(r) OVER w AS second FROM r WINDOW w AS (PARTITION BY id ORDER BY r DESC))
    SELECT id, key, mode, r, least(greatest((r - second) * 5 + 0.3, 0), 1) AS confidence, least(greatest((r - second) / (abs(r) + 1e-12) + r, 0), 1) AS relative_confidence FROM o WHERE place = 1""", rounded="r confidence relative_confidence")
def key_detection(spark, sf):
    """The first twelve parts of each vector stand in for a chroma."""
    chroma = F.transform(F.slice("vector", 1, 12), lambda x: F.abs(x.cast("double")))
    return vectors(spark, sf).select("id", S.key_of(chroma).alias("k")).select("id", "k.*")


@query(f"""WITH c AS (SELECT vec_id AS id, {_CH} AS ch FROM embeddings), t AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{n}', {[round(x, 17) for x in v]}::DOUBLE[])" for k, (n, v) in enumerate(S.chord_templates()))}) x(k, chord, tv)),
    s AS (SELECT id, k, chord, list_inner_product(ch, tv) / (sqrt(list_inner_product(ch, ch)) + 1e-12) AS s FROM c, t)
    SELECT id, chord, s AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, k) AS place FROM s) WHERE place = 1""", rounded="confidence")
def chord_detection(spark, sf):
    chroma = F.transform(F.slice("vector", 1, 12), lambda x: F.abs(x.cast("double")))
    return vectors(spark, sf).select("id", S.chord_of(chroma).alias("c")).select("id", "c.chord", "c.confidence")


_W = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))"


@query(f"""SELECT vec_id AS id, list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END)) AS entropy
    FROM (SELECT vec_id, list_transform({_W}, lambda y: y / list_sum({_W})) AS p FROM embeddings)""", rounded="entropy")
def spectral_entropy(spark, sf):
    return vectors(spark, sf).select("id", S.entropy(F.transform("vector", lambda x: F.abs(x.cast("double")))).alias("entropy"))


@query(f"""WITH e AS (SELECT label, unnest({_D}) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) SELECT label, list(m ORDER BY pos) AS vector FROM
    (SELECT label, pos, avg(x) AS m FROM e GROUP BY label, pos) GROUP BY label""")
def mean_pooled(spark, sf):
    """Mean of all vectors of a label, as frames of one clip are pooled, without gathering them."""
    return V.weighted_centroids(vectors(spark, sf).withColumn("one", F.lit(1)), "label", "one")


_FV = "[" + ", ".join(f"least(greatest(abs(x[{k + 1}]), 0.0), 1.0)" for k in range(7)) + ", (60 - abs(x[8])) / 60, abs(x[9]) * 250 / 250, (id % 2)::DOUBLE] || list_transform(range(12), lambda k: CASE WHEN k = id % 13 - 1 THEN 1.0 ELSE 0.0 END)"
_ROWS = "[" + ", ".join(str(V.projection()[:22, j].astype(float).tolist()) for j in range(128)) + "]"


@query(f"""WITH e AS (SELECT vec_id AS id, {_D} AS x FROM embeddings), v AS (SELECT id, CAST({_FV} AS DOUBLE[]) AS f FROM e), z AS (SELECT id, list_transform(CAST({_ROWS} AS DOUBLE[][]), lambda r: list_inner_product(f, r)) AS z FROM v)
    SELECT id, CAST(list_transform(z, lambda y: y / (sqrt(list_inner_product(z, z)) + 1e-8)) AS FLOAT[]) AS vector FROM z""")
def feature_vectors(spark, sf):
    """128-part vectors of synthetic features: the first parts of each embedding, brought to 0 to 1."""
    x = lambda k: F.abs(F.col("vector")[k].cast("double"))
    names = ("danceability", "energy", "valence", "speechiness", "acousticness", "instrumentalness", "liveness")
    rows = vectors(spark, sf).select("id", *[S.clip(x(k)).alias(n) for k, n in enumerate(names)], (-x(7)).alias("loudness"), (x(8) * 250).alias("tempo"), (F.col("id") % 2).alias("mode"), (F.col("id") % 13 - 1).alias("key"))
    return V.feature_vectors(rows)
