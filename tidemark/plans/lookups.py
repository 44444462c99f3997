"""Queries that look up, join, enrich, audit and pick, and the feature formulas over arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions import text as X
from tidemark.operators import catalog as C
from tidemark.operators import lookup as K
from tidemark.operators import timeseries as T
from tidemark.operators import vectors as V
from tidemark.plans import series
from tidemark.plans.registry import ORACLES, query
from tidemark.plans.vectors import _D, vectors
from tidemark.sources.history import with_duration_minutes
from tidemark.sources.tables import load, plays_from_events


@query("SELECT c_custkey * 2 AS id, p_name AS title, p_brand AS album, p_partkey IS NOT NULL AS found FROM customer LEFT JOIN part ON p_partkey = c_custkey * 2")
def lookup_tracks(spark, sf):
    tracks = load(spark, sf, "part").selectExpr("p_partkey id", "p_name title", "p_brand album")
    return K.lookup(tracks, load(spark, sf, "customer").selectExpr("c_custkey * 2 id"), "id")


@query("""SELECT p_partkey AS id, p_partkey // 50 AS call, o_totalprice AS value, o_orderkey IS NOT NULL AS found, CASE WHEN o_orderkey IS NULL THEN 'not_found' ELSE 'ok' END AS status
    FROM part LEFT JOIN orders ON o_orderkey = p_partkey""")
def batched_lookup(spark, sf):
    table = load(spark, sf, "orders").selectExpr("o_orderkey id", "o_totalprice value")
    return K.lookup_batched(load(spark, sf, "part").selectExpr("p_partkey id"), table, "id")


@query("""WITH h AS (SELECT p_name AS title, p_type AS artist, min(p_partkey) AS pos, arg_min(p_brand, p_partkey) AS recording FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2)
    SELECT p_partkey AS id, recording, pos FROM part LEFT JOIN h ON h.title = p_name AND h.artist = p_type""")
def first_hits(spark, sf):
    """Every third part is a recording that a search by title and artist can find."""
    part = load(spark, sf, "part")
    hits = part.filter("p_partkey % 3 = 0").selectExpr("p_name title", "p_type artist", "p_partkey pos", "p_brand recording")
    found = K.first_hit(part.selectExpr("p_partkey id", "p_name title", "p_type artist"), hits, ["title", "artist"])
    return found.select("id", "hit.recording", "hit.pos")


@query("""WITH n AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1), q AS (SELECT p_name AS name, max(p_partkey) AS id FROM part GROUP BY 1),
    w AS (SELECT q.id AS query_id, n.id AS candidate_id, len(list_intersect(string_split(q.name, ' '), string_split(n.name, ' '))) AS shared FROM q, n)
    SELECT query_id, candidate_id, shared, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, candidate_id) - 1 AS pos FROM w WHERE shared > 0 QUALIFY pos < 5""")
def search_names(spark, sf):
    """Distinct names against distinct names; a search gives five results."""
    names = load(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("candidate_id"), F.max("p_partkey").alias("query_id")).withColumn("words", X.words(F.col("name")))
    return K.search(names.select("query_id", "words"), names.select("candidate_id", "words"), 5)


@query("SELECT vec_id AS id, label, len(embedding) AS dim, p_name AS title, p_brand AS album FROM embeddings JOIN part ON p_partkey = vec_id")
def embedding_catalog(spark, sf):
    tracks = load(spark, sf, "part").selectExpr("p_partkey id", "p_name title", "p_brand album")
    return V.with_tracks(vectors(spark, sf), tracks).select("id", "label", F.size("vector").cast("long").alias("dim"), "title", "album")


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def known_vectors(spark, sf):
    seen = load(spark, sf, "lineitem").filter("l_returnflag = 'R'").selectExpr("l_partkey id")
    return vectors(spark, sf).select("id", "label").join(seen, "id", "left_semi")


@query(f"""SELECT n.query_id, n.id, n.place, n.distance, p_name AS title FROM ({ORACLES['knn']}) n LEFT JOIN part ON p_partkey = n.id""")
def similar_tracks(spark, sf):
    """Neighbours with the names of their tracks, by one join."""
    rows = vectors(spark, sf)
    tracks = load(spark, sf, "part").selectExpr("p_partkey id", "p_name title")
    out = V.knn(rows.filter("id % 100 = 0"), rows, 10).join(tracks, "id", "left")
    return out.withColumn("distance", F.round(F.col("distance") + 3.3e-10, 8) + 0.0)


@query(f"""WITH c AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest({_D}) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
    SELECT vec_id AS query_id, c.label AS id, 1 - list_cosine_similarity({_D}, c.v) AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY 1 - list_cosine_similarity({_D}, c.v), c.label) AS place
    FROM embeddings, c WHERE vec_id % 100 = 0 QUALIFY place <= 3""", rounded="distance")
def centroid_search(spark, sf):
    """The labels' centroids nearest to each vector whose id is divisible by 100."""
    rows = vectors(spark, sf)
    return V.centroid_search(rows.filter("id % 100 = 0"), rows.withColumn("one", F.lit(1)), "label", "one", 3)


@query("""SELECT event_id, json_extract_string(m, '$.k') AS k, json_extract_string(m, '$.seen') AS seen FROM (SELECT event_id, json_merge_patch(props, '{"seen":"' || event_type || '"' || CASE WHEN event_id % 3 = 0 THEN ',"k":null' ELSE '' END || '}') AS m FROM events)""")
def json_merge(spark, sf):
    gone = F.when(F.col("event_id") % 3 == 0, ',"k":null').otherwise("")
    patch = F.concat(F.lit('{"seen":"'), F.col("event_type"), F.lit('"'), gone, F.lit("}"))
    m = load(spark, sf, "events").select("event_id", K.merge_patch(F.col("props"), patch).alias("m"))
    return m.select("event_id", F.get_json_object("m", "$.k").alias("k"), F.get_json_object("m", "$.seen").alias("seen"))


@query("""SELECT p_partkey AS id, 'C' || p_partkey AS isrc, p_brand AS album, CASE WHEN p_partkey % 4 <> 0 THEN 1990 + p_size END AS release_year, [p_type, p_name] AS artists, CAST(p_size * 1000 AS BIGINT) AS duration_ms, p_size AS popularity FROM part""")
def payload_projection(spark, sf):
    c = F.col
    date = F.when(c("p_partkey") % 4 != 0, F.concat((1990 + c("p_size")).cast("string"), F.lit("-05-01"))).otherwise("unknown")
    answer = F.to_json(F.struct(
        F.struct(F.concat(F.lit("C"), c("p_partkey")).alias("isrc")).alias("external_ids"), F.struct(c("p_brand").alias("name"), date.alias("release_date")).alias("album"),
        F.array(F.struct(c("p_type").alias("name")), F.struct(c("p_name").alias("name"))).alias("artists"), (c("p_size") * 1000).alias("duration_ms"), c("p_size").alias("popularity"), F.lit("x").alias("other"),
    ))
    return load(spark, sf, "part").select(c("p_partkey").alias("id"), K.payload(answer).alias("p")).select("id", "p.*")


@query("""SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS asked, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS answer FROM orders""")
def zipped_answers(spark, sf):
    """A customer's orders are the keys of one request, and their prices its answers, in the same order."""
    rows = load(spark, sf, "orders").withColumn("a", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))
    one = rows.groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "a"))).alias("x"))
    zipped = one.select("k", F.posexplode(K.zip_answers(F.col("x")["o_orderkey"], F.col("x")["a"])).alias("pos", "z"))
    return zipped.select("k", F.col("pos").cast("long").alias("pos"), "z.asked", "z.answer")


@query("SELECT p_partkey AS id, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[2] AS second FROM part")
def array_places(spark, sf):
    names = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("artists"))
    return names.select("id", F.get("artists", F.lit(0)).alias("first"), F.get("artists", F.lit(1)).alias("second"))


BOUNDS = {"l_quantity": (1, 40), "l_discount": (0, 0.05), "l_tax": (0, 1)}


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS rows, count(*) - count({c}) AS missing, count(*) FILTER (NOT {c} BETWEEN {a} AND {b}) AS outside FROM lineitem" for c, (a, b) in BOUNDS.items()))
def range_audit(spark, sf):
    return K.range_audit(load(spark, sf, "lineitem"), BOUNDS)


@query(f"""WITH p AS (SELECT vec_id AS id, list_transform({_D}, lambda x: abs(x)) AS w FROM embeddings), e AS (SELECT id, unnest(w) / list_sum(w) AS p, generate_subscripts(w, 1) - 1 AS label FROM p)
    SELECT id, CAST(label AS INTEGER) AS label, p, row_number() OVER (PARTITION BY id ORDER BY p DESC, label) - 1 AS place FROM e WHERE p > 0.02 QUALIFY place < 10""", rounded="p")
def top_labels(spark, sf):
    w = F.transform("vector", lambda x: F.abs(x.cast("double")))
    shares = vectors(spark, sf).select("id", S.let(w, lambda v: S.let(S.total(v), lambda s: F.transform(v, lambda x: x / s))).alias("p"))
    found = shares.select("id", F.posexplode(K.top_labels(F.col("p"), 10, 0.02)).alias("place", "x"))
    return found.select("id", F.col("x.label").cast("int").alias("label"), "x.p", F.col("place").cast("long").alias("place"))


_NAMES = (("click", "plucked"), ("view", "plucked"), ("purchase", "bowed"), ("signup", "bowed"))


@query(f"""SELECT user_id AS id, label, max(value) AS score FROM events JOIN (VALUES {', '.join(map(str, _NAMES))}) n(raw, label) ON event_type = raw GROUP BY 1, 2""")
def remapped_labels(spark, sf):
    scores = load(spark, sf, "events").selectExpr("user_id id", "event_type raw", "value score")
    return K.remap_labels(scores, spark.createDataFrame(_NAMES, "raw string, label string"))


@query("""SELECT user_id AS k, list_sort(list_distinct(list(event_id % 50) || list(user_id % 50) || [0, 50])) AS bounds FROM events GROUP BY 1""")
def merged_bounds(spark, sf):
    rows = load(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.collect_set(F.col("event_id") % 50).alias("a"), F.collect_set(F.col("user_id") % 50).alias("b"))
    ends = F.array(F.lit(0).cast("long"), F.lit(50).cast("long"))
    return rows.select("k", K.merged_bounds(F.col("a"), F.col("b"), ends).alias("bounds"))


@query("""SELECT event_id AS seq, CAST(floor(value * 1000 + 0.5) AS BIGINT) / 60000.0 AS minutes, CAST(floor(value * 1000 + 0.5) AS BIGINT) / 3600000.0 AS hours FROM events""")
def derived_units(spark, sf):
    return with_duration_minutes(plays_from_events(spark, sf)).select("seq", "minutes", "hours")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, coalesce(nullif(CAST(l_quantity % 3 AS BIGINT), 0), nullif(CAST(l_linenumber % 2 AS BIGINT), 0)) / 1000.0 AS seconds, CASE WHEN l_returnflag = 'R' THEN 'fingerprint' ELSE 'metadata' END AS method,
    CASE WHEN l_returnflag = 'R' THEN 0.95 ELSE 0.8 END::DOUBLE AS score FROM lineitem""")
def match_evidence(spark, sf):
    c = F.col
    method = C.match_method(F.when(c("l_returnflag") == "R", c("l_linestatus")))
    rows = load(spark, sf, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), C.known_duration((c("l_quantity") % 3).cast("long"), (c("l_linenumber") % 2).cast("long")).alias("seconds"), method.alias("m"))
    return rows.select("id", "seconds", "m.method", "m.score")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(extract(year FROM o_orderdate) AS INTEGER) END AS year, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus ELSE 'plain' END AS artist,
    CASE WHEN o_orderkey % 4 = 0 THEN '—' WHEN o_orderkey % 4 = 1 THEN '~30 min' WHEN o_orderkey % 4 = 2 THEN '~7.5 h' ELSE '~4.0 days' END AS eta FROM orders""")
def small_parsers(spark, sf):
    c, quoted = F.col, lambda x: F.concat(F.lit('"'), F.col(x), F.lit('"'))
    date = F.when(c("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("unknown")
    third = c("o_orderkey") % 3
    artists = F.when(third == 0, F.concat(F.lit("["), quoted("o_orderpriority"), F.lit(',"x"]'))).when(third == 1, F.concat(F.lit('[{"name":'), quoted("o_orderstatus"), F.lit("}]"))).otherwise("plain")
    hours = F.element_at(F.array(F.lit(0.0), F.lit(0.5), F.lit(7.5), F.lit(96.0)), (c("o_orderkey") % 4 + 1).cast("int"))
    return load(spark, sf, "orders").select(c("o_orderkey").alias("id"), X.leading_year(date).alias("year"), X.first_artist(artists).alias("artist"), X.eta(hours).alias("eta"))


# ---- formulas over arrays: a user's events are the frames of a track


_FRAMES = """WITH f AS (SELECT user_id AS k, event_id AS seq, value / 500 AS r, (event_id % 10) / 100.0 AS fl, (epoch_us(ts) - 1704067200000000) / 1000000.0 / 3600 AS t FROM events),
    d AS (SELECT *, 20 * log10(r + 1e-12) AS db FROM f), m AS (SELECT k, max(db) AS top, max(r) * 0.03 AS gate, quantile_cont(r, 0.25) AS low, count(*) AS n FROM d GROUP BY k)
"""


def frames(spark, sf):
    e, c = load(spark, sf, "events"), F.col
    t = (F.unix_micros(c("ts").cast("timestamp")) - 1_704_067_200_000_000) / 1_000_000.0 / 3600
    rows = e.groupBy(c("user_id").alias("k")).agg(F.sort_array(F.collect_list(F.struct(t.alias("t"), c("event_id").alias("seq"), (c("value") / 500).alias("r"), ((c("event_id") % 10) / 100.0).alias("fl")))).alias("x"))
    return rows.select("k", *[c("x")[n].alias(n) for n in ("t", "r", "fl")])


@query(_FRAMES + """, g AS (SELECT k, coalesce(stddev_pop(g), 0) AS sd, avg(g) AS mean FROM (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY t, seq) AS g FROM f) GROUP BY k)
    SELECT d.k, avg(db) FILTER (db > top - 40) AS loudness, 20 * log10(sqrt(avg(r * r) FILTER (r > gate)) + 1e-12) - 0.691 AS lufs,
    CASE WHEN count(*) FILTER (r < low) < 5 THEN 0.1 ELSE least(greatest(avg(fl) FILTER (r < low) * 8, 0), 1) * 0.8 END AS liveness,
    CASE WHEN any_value(n) < 8 THEN 0.2 ELSE 0.45 * (1 - least(greatest(any_value(sd) / (any_value(mean) + 1e-8), 0), 1)) + 0.3 * exp(-pow((90 + d.k % 50 - 115) / 45.0, 2)) + 0.25 * 0.5 END AS danceability
    FROM d JOIN m ON m.k = d.k LEFT JOIN g ON g.k = d.k GROUP BY d.k""", rounded="loudness lufs liveness danceability")
def array_formulas(spark, sf):
    c = F.col
    tempo = (90 + c("k") % 50).cast("double")
    return frames(spark, sf).select("k", S.gated_loudness(c("r")).alias("loudness"), S.lufs(c("r")).alias("lufs"), S.liveness(c("r"), c("fl")).alias("liveness"), S.danceability(c("t"), tempo, F.lit(0.5)).alias("danceability"))


@query(f"SELECT id, 0.35 * coalesce(mode, 0) + 0.35 * least(greatest(centroid / 3500, 0.0), 1.0) + 0.3 * rms AS valence FROM ({series._F})", rounded="valence")
def valence_scores(spark, sf):
    f = series.feature_rows(spark, sf)
    return f.select("id", S.valence(F.coalesce("mode", F.lit(0)), F.col("centroid"), F.col("rms")).alias("valence"))


@query(f"""SELECT b.k, b.beats, CASE WHEN b.beats >= 4 THEN b.ibi_mean END AS ibi_mean, CASE WHEN b.beats >= 4 THEN b.ibi_std END AS ibi_std, CASE WHEN b.beats >= 4 THEN b.regularity END AS regularity,
    CASE WHEN b.beats >= 4 THEN e.entropy END AS entropy, CASE WHEN b.beats >= 4 THEN s.syncopation END AS syncopation FROM ({ORACLES['beat_stats']}) b LEFT JOIN ({ORACLES['rhythmic_entropy']}) e ON e.k = b.k LEFT JOIN ({ORACLES['syncopation']}) s ON s.k = b.k""")
def rhythm_blocks(spark, sf):
    """Rhythm of each track in one row."""
    p = series.points(spark, sf)
    out = T.rhythm_block(p, p.filter("kind <> 'click'"), p.filter("kind = 'click'").select("k", "t"), ["k"], "value")
    return out.withColumns({c: F.round(F.col(c) + 3.3e-10, 8) + 0.0 for c in ("ibi_mean", "ibi_std", "regularity", "entropy")})
