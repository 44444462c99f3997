"""Titles, names, signals, histories: rules by example, and edge cases."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dsp
from tidemark.functions import stats as S
from tidemark.functions import text as X
from tidemark.operators import timeseries as T
from tidemark.plans import state
from tidemark.sources import files, history

TITLES = [
    ("One (2011 Remaster)", None, "One", "remaster", ["remaster"]),
    ("Layla - Acoustic; Live", None, "Layla", "live", ["acoustic", "live"]),
    ("HUMBLE. - Clean Version", None, "HUMBLE.", "clean", ["clean"]),
    ("Song Live at Wembley", None, "Song Live at Wembley", "live", ["live"]),
    ("Plain", "Plain (Deluxe Edition)", "Plain", "deluxe", ["deluxe"]),
    ("Plain", "Plain", "Plain", "original", []),
    ("Stay With Me", None, "Stay", "original", []),
    ("Track feat. Guest", None, "Track", "original", []),
    ("Hit [Radio Edit] (Mono)", None, "Hit", "radio_edit", ["radio_edit", "remix", "version"]),
    ("(Live)", None, "(Live)", "live", ["live"]),
]


def test_titles(spark):
    df = spark.createDataFrame([(i, t, a) for i, (t, a, *_) in enumerate(TITLES)], "i int, t string, a string")
    rows = df.select("i", X.parse_title(F.col("t"), F.col("a")).alias("p")).orderBy("i").collect()
    for r, (_, _, base, kind, tags) in zip(rows, TITLES, strict=True):
        assert (r.p.base_title, r.p.variant_type, list(r.p.variant_tags)) == (base, kind, tags)


def test_names(spark):
    df = spark.createDataFrame([("Beyoncé, Jay-Z", "  Sigur  Rós — Ágætis! "), ("AC/DC & Friends", "ﬁne ½"), (None, None)], "a string, b string")
    rows = df.select(X.normalize(X.primary_artist(F.col("a"))).alias("a"), X.normalize(F.col("b")).alias("b"), X.normalize(F.col("b"), native=True).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("beyonce", "sigur ros agtis", "sigur ros agtis"), ("ac dc", "fine 12", "ne"), (None, None, None)]


def test_small_parsers(spark):
    df = spark.createDataFrame([("svc:track:abc", "http://x/y/z//", "2011-05", '["A","B"]', 0.5), ("svc:episode:e", "q", "x", '[{"name":"C"}]', 72.0), (None, "", None, "D", float("nan"))], "u string, h string, d string, j string, e double")
    got = df.select(X.uri_id(F.col("u")), X.last_segment(F.col("h")), X.leading_year(F.col("d")), X.first_artist(F.col("j")), X.eta(F.col("e"))).collect()
    assert [tuple(r) for r in got] == [("abc", "z", 2011, "A", "~30 min"), (None, "q", None, "C", "~3.0 days"), (None, None, None, "D", "—")]
    sim = spark.createDataFrame([("a b c", "b c d"), ("", "a")], "x string, y string").select(X.jaccard(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in sim] == [0.5, 0.0]


def test_array_statistics(spark):
    v = [3.0, 1.0, 2.0, 2.0, 10.0]
    df = spark.createDataFrame([(v,)], "v array<double>")
    got = df.select(S.mean(F.col("v")), S.std(F.col("v")), S.percentile(F.col("v"), 0.3), S.mode(F.col("v")), S.entropy(F.col("v")), S.lagged(F.col("v"), 1)).first()
    p = np.array(v) / sum(v)
    assert got == pytest.approx((np.mean(v), np.std(v), np.percentile(v, 30), 2.0, -(p * np.log2(p)).sum(), np.corrcoef(v[:-1], v[1:])[0, 1]))


def test_formulas_on_arrays(spark):
    rms, flat = [0.1 * k for k in range(1, 31)], [0.01 * k for k in range(30)]
    beats, strengths = [0.5 * k for k in range(40)], [1.0 if k % 3 == 0 else 0.2 for k in range(40)]
    df = spark.createDataFrame([(rms, flat, beats, strengths)], "r array<double>, f array<double>, b array<double>, s array<double>")
    c = F.col
    got = df.select(S.gated_loudness(c("r")), S.lufs(c("r")), S.liveness(c("r"), c("f")), S.danceability(c("b"), F.lit(115.0), F.lit(1.0)), S.time_signature(c("s")), S.regularity(c("b"))).first()
    db = 20 * np.log10(np.array(rms) + 1e-12)
    quiet = np.array(flat)[np.array(rms) < np.percentile(rms, 25)]
    want = (db[db > db.max() - 40].mean(), 20 * np.log10(np.sqrt(np.mean(np.square(rms)))) - 0.691, min(1, quiet.mean() * 8) * 0.8, 1.0, 3, 1.0)
    assert tuple(got) == pytest.approx(want)


def test_key_of_chords(spark):
    df = spark.createDataFrame([(k, [1.0 if i in (k, (k + 4) % 12, (k + 7) % 12) else 0.1 for i in range(12)]) for k in range(12)], "k int, c array<double>")
    for r in df.select("k", S.key_of(F.col("c")).alias("x"), S.chord_of(F.col("c")).alias("y")).collect():
        assert (r.x.key, r.x.mode) == (r.k, 1) and r.y.chord == S.PITCHES[r.k] and 0 <= r.x.confidence <= 1


def test_short_sections_merge(spark):
    def seg(*xs):
        return [(float(a), float(b), c, float(e)) for a, b, c, e in xs]

    cases = [
        (seg((0, 1, 1, 0), (1, 10, 2, 1)), [(0, 10, 2)]),
        (seg((0, 10, 1, 0), (10, 11, 2, 1), (11, 20, 3, 0)), [(0, 11, 1), (11, 20, 3)]),
        (seg((0, 1, 1, 0)), [(0, 1, 1)]),
        (seg((0, 5, 1, 0), (5, 10, 2, 0)), [(0, 5, 1), (5, 10, 2)]),
        (seg((0, 1, 1, 0), (1, 2, 2, 0), (2, 9, 3, 0)), [(0, 9, 3)]),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], f"i int, s array<{T.SEGMENT}>")
    for r in df.select("i", T.merge_short(F.col("s")).alias("m")).collect():
        assert [(x.start, x.end, x.cluster) for x in r.m] == cases[r.i][1]


def test_modulations_follow_the_last_taken_key(spark):
    keys = [(0.0, "C", 0.9), (5.0, "G", 0.4), (10.0, "G", 0.8), (15.0, "G", 0.9), (20.0, "C", 0.7)]
    df = spark.createDataFrame([(keys,)], "k array<struct<t:double,key:string,confidence:double>>")
    got = df.select(T.modulations(F.col("k"), F.lit("C")).alias("m")).first().m
    assert [(x.t, x.before, x.after) for x in got] == [(10.0, "C", "G"), (20.0, "G", "C")]


# ---- signals


@pytest.mark.parametrize("bpm", [60, 120])
def test_tempo(bpm):
    assert min(abs(dsp.features(dsp.clicks(bpm, 15))["tempo"] - b) for b in (60, 120, 240)) < 6


def test_features_of_signals():
    chord, sine, noise = dsp.tones([261.63, 329.63, 392.0], 15), dsp.tones([440], 15), np.random.RandomState(0).randn(15 * dsp.RATE) * 0.3
    f = dsp.features(chord)
    assert (f["key"], f["mode"]) == (0, 1)
    for y in (chord, sine, noise, np.zeros(5 * dsp.RATE) + 1e-6):
        f = dsp.features(y)
        assert all(0 <= f[k] <= 1 for k in ("danceability", "energy", "valence", "speechiness", "acousticness", "instrumentalness", "liveness"))
    assert dsp.features(sine)["acousticness"] > dsp.features(noise)["acousticness"]
    assert dsp.features(sine)["loudness"] > dsp.features(sine * 0.1)["loudness"] and dsp.features(sine * 0.1)["loudness"] < 0


def test_analysis_of_clicks():
    a = dsp.analysis(dsp.clicks(120, 12))
    assert abs(a["duration"] - 12) < 0.01 and abs(len(a["beats"]) - 24) <= 0.35 * 24
    assert all(len(s["pitches"]) == 12 == len(s["timbre"]) and max(s["pitches"]) <= 1 + 1e-9 for s in a["segments"])
    for x, y in zip(a["beats"], a["beats"][1:], strict=False):
        assert abs(x["start"] + x["duration"] - y["start"]) < 0.01
    gaps = np.diff([b["start"] for b in a["beats"]])
    assert 1 - gaps.std() / gaps.mean() > 0.8


def test_files_are_decoded_and_errors_are_rows(spark, tmp_path):
    y = dsp.tones([440], 2)
    (tmp_path / "a.wav").write_bytes(dsp.encode_wav(y))
    (tmp_path / "copy.wav").write_bytes(dsp.encode_wav(y))
    (tmp_path / "short.wav").write_bytes(dsp.encode_wav(y[:100]))
    (tmp_path / "broken.wav").write_bytes(b"no audio")
    (tmp_path / "x.txt").write_bytes(b"text")
    lib = files.scan_library(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in lib.collect()}
    assert rows["x.txt"].rejected == "unsupported format" and rows["a.wav"].rejected is None and rows["a.wav"].store_key.startswith(rows["a.wav"].file_hash[:2] + "/")
    assert files.dedup_uploads(lib.select("path", "file_hash")).count() == 4
    got = {r.path.rsplit("/", 1)[1]: r for r in files.decode(lib.filter("rejected is null")).collect()}
    assert len(got["a.wav"].samples) == 2 * dsp.RATE and got["short.wav"].error == "shorter than a second" and got["broken.wav"].error.startswith("unreadable")
    tracks = files.decode(lib.filter("rejected is null")).withColumnRenamed("path", "id").drop("error")
    feats = {r.id.rsplit("/", 1)[1]: r for r in dsp.features_of(tracks).collect()}
    assert feats["a.wav"].error is None and feats["broken.wav"].error and feats["broken.wav"].tempo is None


class Mapped:
    """Stands in for a frame and keeps the function that maps it."""

    def __init__(self, spark):
        self.sparkSession, self.schema = spark, spark.createDataFrame([], "id long").schema

    def select(self, *_):
        return self

    repartition = select

    def mapInPandas(self, run, schema):
        self.run = run
        return self


def test_tracks_are_sent_on_a_few_at_a_time(spark, monkeypatch):
    n = 2 * dsp.TRACKS + 3
    monkeypatch.setattr(state, "load", lambda *_: Mapped(spark))
    made = list(state.signals(spark, "").run(iter([pd.DataFrame({"s_suppkey": range(n)})])))
    assert [len(x) for x in made] == [dsp.TRACKS, dsp.TRACKS, 3]
    tracks = pd.concat(made)
    assert list(tracks["id"]) == list(range(n))
    for f, rows in ((dsp.features_of, 1), (dsp.analyze, 1), (dsp.embed, len(dsp.MODELS))):
        got = list(f(Mapped(spark)).run(iter([tracks])))
        assert max(map(len, got)) == rows * dsp.TRACKS
        assert [k for x in got for k in x["id"]] == [k for k in range(n) for _ in range(rows)]


def test_features_are_made_in_one_pass_of_python(spark, monkeypatch):
    monkeypatch.setattr(state, "load", lambda *_: spark.createDataFrame([(k,) for k in range(1, 30)], "s_suppkey long"))
    got, want = state.audio_features(spark, ""), dsp.features_of(state.signals(spark, ""))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect())


def test_errors_of_loading_are_rows(spark):
    tracks = spark.createDataFrame([("a", 1), ("b", 0), ("c", None)], "id string, samples int")
    got = {r.id: r for r in dsp.features_of(tracks, lambda k: dsp.tones([440 / k], 2)).collect()}
    assert got["a"].error is None and got["a"].tempo is not None
    assert "division" in got["b"].error and got["b"].tempo is None and got["c"].error == "no samples"


# ---- history


def test_history_files(spark, tmp_path):
    row = {"ts": "2024-01-01T18:30:00Z", "ms_played": 30000, "master_metadata_track_name": "T", "master_metadata_album_artist_name": "A", "own_track_uri": "svc:track:x", "skipped": False}
    rows = [row, row | {"master_metadata_track_name": None}, row | {"master_metadata_album_artist_name": ""}, row | {"ts": "never"}, row | {"ts": "2024-01-02T00:00:00", "ms_played": None}]
    (tmp_path / "Streaming_History_Audio_2023_1.json").write_text(json.dumps(rows))
    (tmp_path / "Streaming_History_Audio_2024_2.json").write_text(json.dumps([row]))
    (tmp_path / "Streaming_History_Audio_2025_3.json").write_text("{ not json")
    (tmp_path / "Streaming_History_Video_2023.json").write_text(json.dumps([row]))
    raw = history.read_history(spark, str(tmp_path), uri_field="own_track_uri")
    assert history.parse_stats(raw).first().asDict() == {"files": 2, "rows": 6, "tracks": 3, "skipped_non_music": 2, "bad_rows": 1, "unreadable": 1}
    got = history.parse(raw).orderBy("source_file", "ts").collect()
    assert [(r.ms_played, r.external_id, r.short_play, r.source_file[-6:]) for r in got] == [(30000, "x", False, "1.json"), (0, "x", True, "1.json"), (30000, "x", False, "2.json")]
    assert history.parse(raw, strict=False).count() == 4
    assert history.read_history(spark, str(tmp_path), year=2024).count() == 1
    assert sum(r._corrupt_record is None for r in history.read_history(spark, str(tmp_path), any_json=True).collect()) == 7
    assert set(raw.columns) & {"ip_addr"} == set()
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "export.json").write_text(json.dumps([row]))
    assert history.read_history(spark, str(tmp_path / "other")).count() == 1  # no file has the usual name
