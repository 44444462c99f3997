"""Catalog, vectors, sinks, streams and the entry point."""

import json
import subprocess
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import catalog as C
from tidemark.operators import listening as L
from tidemark.operators import vectors as V
from tidemark.plans.registry import ORACLES, QUERIES
from tidemark.sources import sinks
from tidemark.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def fold(rows):
    """Plays added one by one: the rule that the exact assignment follows."""
    by_id, by_key, owner, out = {}, {}, [], []
    for ext, vkey in rows:
        entry = by_id.get(ext) if ext else None
        if entry is None:
            entry = by_key.get(vkey)
            if entry is not None and ext and owner[entry] is None:
                owner[entry], by_id[ext] = ext, entry
        if entry is None:
            entry = len(owner)
            owner.append(ext)
            if ext:
                by_id[ext] = entry
            by_key[vkey] = entry
        out.append(entry)
    return out


def groups(labels):
    first = {}
    return [first.setdefault(x, len(first)) for x in labels]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from([None, "a", "b", "c"]), st.sampled_from(["x", "y", "z"])), min_size=1, max_size=12), min_size=20, max_size=20))
def test_exact_identity_equals_a_fold(spark, histories):
    rows = [(h * 100 + i, None if e is None else f"{e}{h}", f"{k}{h}") for h, plays in enumerate(histories) for i, (e, k) in enumerate(plays)]
    df = spark.createDataFrame(rows, "seq long, external_id string, vkey string")
    got = {r.seq: r.entry_key for r in C.assign_entries_exact(df).collect()}
    for h, plays in enumerate(histories):
        assert groups([got[h * 100 + i] for i in range(len(plays))]) == groups(fold([(None if e is None else f"{e}{h}", f"{k}{h}") for e, k in plays]))


def test_identity_by_example(spark):
    play = lambda seq, title, ext, artist="Artist", ms=1000: (seq, f"2024-01-01 00:00:0{seq}", ms, title, artist, "Album", ext)
    rows = [play(0, "Song", "i1"), play(1, "Song", "i1"), play(2, "SONG!", None), play(3, "Song (Live)", "i2"), play(4, "Other", "i1"), play(5, "Song - 2011 Remaster", None, ms=5)]
    df = spark.createDataFrame(rows, "seq long, ts string, ms_played long, title string, artist string, album string, external_id string").withColumn("ts", F.to_timestamp("ts"))
    entries = C.build_catalog(C.assign_entries(C.with_identity(df)))
    got = {r.title: r for r in entries.collect()}
    assert {t: r.play_count for t, r in got.items()} == {"Song": 4, "Song (Live)": 1, "Song - 2011 Remaster": 1}
    assert got["Song"].external_id == "i1" and got["Song"].total_ms_played == 4000
    links = {(r.track_a, r.track_b): r.relation for r in C.variant_links(entries).collect()}
    assert links == {(got["Song (Live)"].entry_id, got["Song"].entry_id): "live_of", (got["Song - 2011 Remaster"].entry_id, got["Song"].entry_id): "remaster_of"}


def test_sessions_at_the_gap(spark):
    at = ["2024-01-01 23:00:00", "2024-01-01 23:30:00", "2024-01-02 00:00:01", "2024-01-05 00:00:00"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(at)], "seq long, ts string, ms_played long").withColumn("ts", F.to_timestamp("ts"))
    assert [r.session for r in L.global_sessions(df).orderBy("seq").collect()] == [0, 0, 1, 2]
    assert [r.session for r in L.with_sessions(df, []).orderBy("seq").collect()] == [0, 0, 1, 2]


def test_cells_find_nearly_all(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = rows.filter("id % 100 = 0")
    exact, cells = ({(r.query_id, r.id) for r in x.collect()} for x in (V.knn(q, rows, 10), V.knn_cells(q, rows, 10)))
    assert len(exact & cells) >= 0.9 * len(exact)


def test_vectors_without_length(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (100, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None)], "id long, vector array<float>")
    assert [(r.query_id, r.id) for r in V.knn(rows.filter("id = 100"), rows.filter("id in (2, 3, 100)"), 5).collect()] == [(100, 2)]
    assert V.knn(rows.limit(0), rows, 3).count() == 0


def test_feature_vectors_have_length_one(spark):
    for r in QUERIES["feature_vectors"](spark, SF).limit(5).collect():
        assert len(r.vector) == 128 and sum(x * x for x in r.vector) == pytest.approx(1, abs=1e-3)


def test_writes_can_be_repeated(spark, tmp_path):
    catalog = QUERIES["catalog_entries"](spark, SF).limit(50).persist()
    links = QUERIES["variant_links"](spark, SF)
    plays = spark.createDataFrame([(1, "a")], "seq long, entry_id string")
    for _ in range(2):
        sinks.write_catalog(catalog, links, plays, str(tmp_path))
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    assert read("catalog").count() == 50 == read("state").count() and read("links").count() == links.count() and read("plays").count() == 1
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1, 30)], "id long, vector array<double>")
    sinks.write_index(rows, str(tmp_path / "index"), 4)
    assert spark.read.parquet(str(tmp_path / "index/vectors")).count() == 29
    feats = spark.createDataFrame([(1, 0.5, None), (2, None, "bad")], "id long, tempo double, error string")
    docs = {r.id: r for r in sinks.documents(feats, feats.select("id", "tempo", "error")).collect()}
    assert docs[2].errors == {"features": "bad", "analysis": "bad"} and docs[1].errors == {}


def test_side_maps_and_logs_are_read(spark, tmp_path):
    from tidemark.sources import files

    (tmp_path / "map.json").write_text(json.dumps({"a": "/x/a.wav", "b": "/x/b.wav"}))
    (tmp_path / "log.txt").write_text("[download] Destination: x\n403 Forbidden\n")
    tracks = spark.createDataFrame([("a",), ("c",)], "track_id string")
    got = files.with_paths(tracks, files.side_map(spark, str(tmp_path / "map.json"))).collect()
    assert {(r.track_id, r.path) for r in got} == {("a", "/x/a.wav"), ("c", "c")}
    from tidemark.operators.state import classify_log, retry_failed

    c = classify_log(files.read_log(spark, str(tmp_path / "log.txt"))).first()
    assert (c.downloads, c.forbid, c.verdict) == (1, 2, "downloading")
    state = spark.createDataFrame([("a", "failed"), ("b", "done")], "track_id string, status string")
    assert [r.track_id for r in retry_failed(state).collect()] == ["b"]


def test_a_broken_off_swap_is_put_right(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *v: spark.createDataFrame(list(v), "id long, v string")
    sinks.upsert_table(rows((1, "a"), (2, "b")), path, ["id"])
    (tmp_path / "table").rename(tmp_path / "table.old")  # as after a crash between the two renames
    sinks.upsert_table(rows((2, "c")), path, ["id"])
    assert {(r.id, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")} and not (tmp_path / "table.old").exists()
    before = set((tmp_path / "table").iterdir())
    sinks.insert_table(rows((2, "x"), (3, "d"), (3, "d")), path, ["id"])
    assert before <= set((tmp_path / "table").iterdir())
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_neighbours_at_the_same_distance_are_the_smallest_ids(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(1, 40)] + [(100, [1.0, 0.1])], "id long, vector array<double>").repartition(5)
    got = V.knn(rows.filter("id = 100"), rows, 4).orderBy("place").collect()
    assert [r.id for r in got] == [1, 2, 3, 4]


def test_lookups(spark):
    from tidemark.operators import lookup as K

    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert [r.v for r in K.get(t, id=2).collect()] == ["b"] and K.get(t, id=9).count() == 0
    assert K.safe_count(lambda: t) == 2 and K.safe_count(lambda: spark.read.parquet("/no/such/table")) == 0
    got = spark.createDataFrame([('{"a":"1","b":"2"}', '{"b":null,"c":"3"}'), (None, None)], "o string, p string").select(K.merge_patch(F.col("o"), F.col("p"))).collect()
    assert [r[0] for r in got] == ['{"a":"1","c":"3"}', "{}"]
    key = spark.createDataFrame([(None, 3), (5, 3)], "deep int, own int").select(K.key_or(F.col("deep"), F.col("own"))).collect()
    assert [r[0] for r in key] == [3, 5]


def test_exact_identity_follows_long_chains(spark):
    """Plays that are linked by a chain of ids and names, longer than any number of rounds, are one component."""
    n = 600
    rows = [(2 * k, f"i{k}", f"v{k}") for k in range(n)] + [(2 * k + 1, f"i{k}", f"v{k + 1}") for k in range(n)]
    got = {r.seq: r.entry_key for r in C.assign_entries_exact(spark.createDataFrame(rows, "seq long, external_id string, vkey string")).collect()}
    want = fold([(e, v) for _, e, v in sorted(rows)])
    assert groups([got[s] for s in sorted(got)]) == groups(want)


def test_job_stream_is_idempotent(spark, tmp_path):
    src = tmp_path / "jobs"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"job_id": f"j{i % 4}", "track_id": f"t{k}", "path": "p", "format": "wav", "outputs": ["x"]}) for i in range(5)))
    step = lambda df: df.select("job_id", "track_id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"))
    for _ in range(2):
        J.run_batches(J.jobs(spark, str(src)), step, str(tmp_path / "out"), str(tmp_path / "check"), ["job_id"]).awaitTermination()
    assert J.latest_rows(spark, str(tmp_path / "out"), ["job_id"]).count() == 4
    assert J.to_messages(spark.createDataFrame([("j", "done")], "job_id string, status string")).first().value == '{"job_id":"j","status":"done"}'


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_rows(spark, name):
    assert len(QUERIES[name](spark, SF).take(1)) == 1


def test_entry_without_the_corpus_operators(tmp_path):
    """The library and the entry point import and list their queries where the corpus folders are deleted."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'top_artists' in q and 'pipeline' not in q and not set(e.oracle_sql()) - set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).take(3)) == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
