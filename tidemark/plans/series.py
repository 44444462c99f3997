"""Queries over series: a user's events are a track, their seconds of the month its times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.operators import timeseries as T
from tidemark.plans.registry import query
from tidemark.sources.tables import load

_P = """WITH p AS (SELECT user_id AS k, event_id AS seq, (epoch_us(ts) - 1704067200000000) / 1000000.0 AS t, event_type AS kind, value FROM events)
"""


def points(spark, sf):
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 1_000_000.0
    return load(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), t.alias("t"), F.col("event_type").alias("kind"), "value")


@query(_P + "SELECT seq, t, greatest(coalesce(lead(t) OVER (PARTITION BY k ORDER BY t, seq), 2678400) - t, 0) AS duration FROM p")
def beat_intervals(spark, sf):
    return T.intervals(points(spark, sf).withColumn("end", F.lit(2_678_400.0)), ["k"]).select("seq", "t", "duration")


@query(_P + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, seq) - 1 AS i FROM p) WHERE i % 4 = 0)
    SELECT k, seq, t, greatest(coalesce(lead(t) OVER (PARTITION BY k ORDER BY t, seq), 2678400) - t, 0) AS duration FROM b""")
def bars(spark, sf):
    return T.intervals(T.every(points(spark, sf), ["k"], 4).withColumn("end", F.lit(2_678_400.0)), ["k"]).select("k", "seq", "t", "duration")


@query(_P + """, d AS (SELECT k, seq, t, greatest(coalesce(lead(t) OVER (PARTITION BY k ORDER BY t, seq), 2678400) - t, 0) AS duration FROM p)
    SELECT seq, CAST(part AS INTEGER) AS part, t + duration * part / 2.0 AS start, duration / 2 AS duration FROM d, range(2) r(part)""")
def tatums(spark, sf):
    return T.subdivide(T.intervals(points(spark, sf).withColumn("end", F.lit(2_678_400.0)), ["k"])).select("seq", "part", "start", "duration")


@query(_P + """, g AS (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY t, seq) AS gap FROM p)
    SELECT k, count(*) AS beats, avg(gap) AS ibi_mean, stddev_pop(gap) AS ibi_std,
    CASE WHEN count(gap) > 1 AND avg(gap) > 0 THEN 1 - least(greatest(stddev_pop(gap) / avg(gap), 0), 1) END AS regularity FROM g GROUP BY k""", rounded="ibi_mean ibi_std regularity")
def beat_stats(spark, sf):
    return T.beat_stats(points(spark, sf), ["k"])


@query(_P + """SELECT k, seq, kind FROM (SELECT *, lag(kind) OVER w AS before, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY k ORDER BY t, seq)) WHERE i = 1 OR kind IS DISTINCT FROM before""")
def collapse_repeats(spark, sf):
    at = F.struct("t", "seq")
    return T.collapse(points(spark, sf).withColumn("t", at), ["k"], "kind").select("k", "seq", "kind")


@query("""WITH c AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, count(*) AS points, count(*) FILTER (role <> before) AS changes, CASE WHEN count(*) > 1 THEN count(*) FILTER (role <> before) / (count(*) - 1.0) ELSE 0.0 END AS rate FROM c GROUP BY conv_id""")
def role_change_rate(spark, sf):
    return T.change_rate(load(spark, sf, "conversations").select("conv_id", "role", F.col("turn").alias("t")), ["conv_id"], "role")


_STEPS = """WITH s AS (SELECT role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), n AS (SELECT a AS "from", b AS "to", count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY a, b)
"""


@query(_STEPS + 'SELECT *, n / sum(n) OVER (PARTITION BY "from") AS share FROM n')
def role_transitions(spark, sf):
    return T.transitions(load(spark, sf, "conversations").select("conv_id", "role", F.col("turn").alias("t")), ["conv_id"], "role")


@query(_STEPS + """, u AS (SELECT count(*) AS used FROM (SELECT "from" FROM n UNION SELECT "to" FROM n)), h AS (SELECT -sum(n / tot * log2(n / tot)) AS h, count(*) AS kinds FROM n, (SELECT sum(n) AS tot FROM n))
    SELECT used, h / log2(greatest(kinds, 2)) AS entropy, least(greatest(0.5 * used / 24 + 0.5 * h / log2(greatest(kinds, 2)), 0), 1) AS complexity FROM u, h""")
def step_complexity(spark, sf):
    return T.harmonic_complexity(T.transitions(load(spark, sf, "conversations").select("conv_id", "role", F.col("turn").alias("t")), ["conv_id"], "role"))


@query(_P + """, m AS (SELECT k, 69 + 12 * log2(value / 440) AS v FROM p WHERE value > 0), c AS (SELECT k, CAST(CASE WHEN v = 108 THEN 83 ELSE floor(v - 24) END AS BIGINT) AS bin, count(*) AS n FROM m WHERE v >= 24 AND v <= 108 GROUP BY 1, 2)
    SELECT u.k, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT k FROM m) u CROSS JOIN (SELECT range AS bin FROM range(84)) b LEFT JOIN c ON c.k = u.k AND c.bin = b.bin""")
def pitch_histogram(spark, sf):
    rows = points(spark, sf).filter("value > 0").withColumn("v", S.midi(F.col("value")))
    return T.histogram(rows, ["k"], "v", 24.0, 108.0, 84)


@query(_P + """, g AS (SELECT k, value AS v, min(value) OVER (PARTITION BY k) AS l, max(value) OVER (PARTITION BY k) AS h FROM p), c AS (SELECT k, CAST(CASE WHEN h = l THEN 10 WHEN v = h THEN 19 ELSE floor((v - l) / ((h - l) / 20)) END AS BIGINT) AS bin, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT k, -sum(n / s * log2(n / s)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY k) AS s FROM c) GROUP BY k""", rounded="entropy")
def rhythmic_entropy(spark, sf):
    return T.rhythmic_entropy(T.spread_histogram(points(spark, sf), ["k"], "value"), ["k"])


@query(_P + "SELECT k, arg_min(kind, (-n, kind)) AS mode FROM (SELECT k, kind, count(*) AS n FROM p GROUP BY k, kind) GROUP BY k")
def mode_of_kinds(spark, sf):
    return T.mode_of(points(spark, sf), ["k"], "kind")


_BEATS = ", o AS (SELECT * FROM p WHERE kind <> 'click'), b AS (SELECT * FROM p WHERE kind = 'click')"


@query(_P + _BEATS + " SELECT seq, (SELECT min(abs(o.t - b.t)) FROM b WHERE b.k = o.k) AS distance FROM o WHERE EXISTS (SELECT 1 FROM b WHERE b.k = o.k)")
def nearest_beat(spark, sf):
    p = points(spark, sf)
    found = T.nearest(p.filter("kind <> 'click'"), p.filter("kind = 'click'").select("k", "t"), ["k"])
    return found.filter("distance is not null").select("seq", "distance")


@query(_P + _BEATS + """, i AS (SELECT k, median(g) AS ibi FROM (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS g FROM b) GROUP BY k),
    d AS (SELECT o.k, min(abs(o.t - b.t)) AS d FROM o JOIN b ON b.k = o.k GROUP BY o.k, o.seq) SELECT d.k, avg(CAST(d > 0.25 * ibi AS DOUBLE)) AS syncopation FROM d JOIN i ON i.k = d.k GROUP BY d.k""")
def syncopation(spark, sf):
    p = points(spark, sf)
    return T.syncopation(p.filter("kind <> 'click'"), p.filter("kind = 'click'").select("k", "t"), ["k"])


@query(_P + _BEATS + """, e AS (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS u, row_number() OVER (PARTITION BY k ORDER BY t) AS bar FROM b)
    SELECT e.k, bar, count(o.t) AS n FROM e LEFT JOIN o ON o.k = e.k AND o.t >= e.t AND o.t < e.u WHERE u IS NOT NULL GROUP BY e.k, bar""")
def beats_per_bar(spark, sf):
    p = points(spark, sf)
    return T.beats_per_bar(p.filter("kind <> 'click'"), p.filter("kind = 'click'"), ["k"])


@query(_P + _BEATS + """, a AS (SELECT o.k, o.seq, o.t, arg_max(b.t, b.t) FILTER (b.t <= o.t) AS t0, arg_max(b.value, b.t) FILTER (b.t <= o.t) AS v0, arg_min(b.t, b.t) FILTER (b.t > o.t) AS t1, arg_min(b.value, b.t) FILTER (b.t > o.t) AS v1
    FROM o JOIN b ON b.k = o.k GROUP BY o.k, o.seq, o.t) SELECT seq, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS value FROM a""")
def interpolate(spark, sf):
    p = points(spark, sf)
    found = T.interpolate(p.filter("kind <> 'click'").select("k", "t", "seq"), p.filter("kind = 'click'").select("k", "t", "value"), ["k"])
    return found.filter("value is not null").select("seq", "value")


@query(_P + """, h AS (SELECT k, CAST(floor(t / 3600) AS BIGINT) AS h, value FROM p) SELECT k, w * 24 AS start, avg(value) AS mean, count(*) AS n
    FROM h, range(0, 100) r(w) WHERE w * 24 <= h AND h < w * 24 + 48 GROUP BY k, w""", rounded="mean")
def sliding_means(spark, sf):
    rows = points(spark, sf).withColumn("h", F.floor(F.col("t") / 3600))
    return T.sliding_means(rows, ["k"], "h", "value", 48, 24)


_LAGS = ", v AS (SELECT k, value, lead(value, 3) OVER w AS l3, lead(value, 4) OVER w AS l4 FROM p WINDOW w AS (PARTITION BY k ORDER BY t, seq))"


@query(_P + _LAGS + " SELECT k, corr(value, l3) AS lag3, corr(value, l4) AS lag4 FROM v GROUP BY k HAVING count(*) >= 10", rounded="lag3 lag4")
def lagged_correlation(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("k").orderBy("t", "seq")
    rows = points(spark, sf).withColumn("l3", F.lead("value", 3).over(w)).withColumn("l4", F.lead("value", 4).over(w))
    return rows.groupBy("k").agg(F.corr("value", "l3").alias("lag3"), F.corr("value", "l4").alias("lag4"), F.count("*").alias("n")).filter("n >= 10").drop("n")


_SEG = """WITH s AS (SELECT l_orderkey AS k, (l_linenumber * 10.0)::DOUBLE AS start, l_linenumber * 10.0 + 5 + l_quantity % 5 AS "end", CAST(l_quantity % 3 AS INTEGER) AS cluster, l_extendedprice AS energy, 80.0 AS duration FROM lineitem)
"""


def segments(spark, sf):
    c = F.col
    start = c("l_linenumber") * 10.0
    return load(spark, sf, "lineitem").select(c("l_orderkey").alias("k"), start.alias("start"), (start + 5 + c("l_quantity") % 5).alias("end"), (c("l_quantity") % 3).cast("int").alias("cluster"), c("l_extendedprice").alias("energy"), F.lit(80.0).alias("duration"))


@query(_SEG + """SELECT k, sum(CASE WHEN n > 1 THEN "end" - start ELSE 0 END) / sum("end" - start) AS repetition FROM (SELECT *, count(*) OVER (PARTITION BY k, cluster) AS n FROM s) GROUP BY k""")
def section_repetition(spark, sf):
    return T.repetition(segments(spark, sf), ["k"])


@query(_SEG + """, a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY start, "end", cluster, energy) AS i, count(*) OVER (PARTITION BY k) AS n, count(*) OVER (PARTITION BY k, cluster) AS c,
    (energy - min(energy) OVER (PARTITION BY k)) / (max(energy) OVER (PARTITION BY k) - min(energy) OVER (PARTITION BY k) + 1e-12) AS e FROM s),
    b AS (SELECT *, avg(e) OVER (PARTITION BY k, cluster) AS ce FROM a), r AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY c DESC, round(ce, 9) DESC, cluster) AS place FROM b)
    SELECT k, start, CASE WHEN i = 1 AND "end" < 16 THEN 'intro' WHEN i = n AND start > 60 THEN 'outro' WHEN place = 1 AND c >= 2 THEN 'chorus' WHEN place = 2 AND c >= 2 THEN 'verse'
    WHEN e < 0.25 THEN 'breakdown' WHEN c = 1 AND e > 0.8 AND start > 32 AND start < 68 THEN 'solo' WHEN c = 1 THEN 'bridge' ELSE 'verse' END AS label FROM r""")
def section_labels(spark, sf):
    return T.label_sections(segments(spark, sf), ["k"]).select("k", "start", "label")


@query()
def merged_sections(spark, sf):
    """Sections with those under 7 s merged into the one before: a fold, which SQL has no windows for."""
    s = F.array_sort(F.collect_list(F.struct("start", "end", "cluster", "energy")))
    rows = segments(spark, sf).groupBy("k").agg(s.alias("s"))
    return rows.select("k", F.explode(T.merge_short(F.col("s"), 7.0)).alias("x")).select("k", "x.*")


_F = """SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity / 50 AS rms, l_discount * 5 AS flux, l_tax * 50 AS onsets, l_extendedprice / 20 AS centroid, 60 + l_quantity * 2 AS tempo, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS mode FROM lineitem"""
_C = lambda x: f"least(greatest({x}, 0.0), 1.0)"
_E, _AR = _C("rms * 12"), _C(f"0.5 * {_C('rms * 12')} + 0.3 * least(tempo / 180, 1.0) + 0.2 * least(centroid / 5000, 1.0)")
_V = _C("0.45 + 0.3 * (least(centroid / 4500, 1.0) - 0.5) + CASE WHEN mode = 1 THEN 0.15 WHEN mode = 0 THEN -0.15 ELSE 0 END")


@query(f"""SELECT id, 0.5 * tanh(rms * 8) + 0.3 * tanh(flux * 2) + 0.2 * tanh(onsets / 4) AS energy, 0.4 * (1 - {_C('centroid * 1.5 / 11025')}) + 0.4 * (1 - {_C('centroid / 4000')}) + 0.2 * (1 - {_C('flux * 10')}) AS acousticness,
    {_C('1.6 - flux')} AS instrumentalness, {_C(f'0.4 * {_C("flux * 20")} + 0.4 * rms + 0.2 * flux * 5')} * 0.66 AS speechiness, 20 * log10(rms + 1e-12) AS db FROM ({_F})""", rounded="energy acousticness instrumentalness speechiness db")
def feature_formulas(spark, sf):
    f = feature_rows(spark, sf)
    c = F.col
    return f.select("id", S.energy(c("rms"), c("flux"), c("onsets")).alias("energy"), S.acousticness(c("centroid") * 1.5, c("centroid"), c("flux"), 11025.0).alias("acousticness"), S.instrumentalness(c("flux")).alias("instrumentalness"), S.speechiness(c("flux"), c("rms"), c("flux")).alias("speechiness"), S.amplitude_db(c("rms")).alias("db"))


def feature_rows(spark, sf):
    c = F.col
    mode = F.when(c("l_returnflag") == "R", 1).when(c("l_returnflag") == "A", 0)
    return load(spark, sf, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (c("l_quantity") / 50).alias("rms"), (c("l_discount") * 5).alias("flux"), (c("l_tax") * 50).alias("onsets"), (c("l_extendedprice") / 20).alias("centroid"), (60 + c("l_quantity") * 2).alias("tempo"), mode.alias("mode"))


@query(f"""WITH f AS ({_F}), m AS (SELECT id, {_E} AS energy, {_AR} AS arousal, {_V} AS valence, tempo FROM f) SELECT id, energy, arousal, valence, valence AS positivity, {_C('0.5 * arousal + 0.5 * energy')} AS dominance,
    {_C('0.4 * 0.5 + 0.3 * energy + 0.3 * exp(-(tempo - 120) * (tempo - 120) / 2400)')} AS danceability, {_C('energy * (1 - valence) * 1.5')} AS aggression, {_C('(1 - valence) * (1 - arousal) * 1.8')} AS melancholy,
    {_C('arousal * (1 - valence) * 1.6')} AS tension, {_C('(1 - arousal) * valence * 1.8')} AS relaxation FROM m""", rounded="energy arousal valence positivity dominance danceability aggression melancholy tension relaxation")
def mood_scores(spark, sf):
    c = F.col
    return feature_rows(spark, sf).select("id", S.mood(c("rms"), c("tempo"), c("centroid"), c("mode"), F.lit(0.5)).alias("m")).select("id", "m.*")
