import corpus_pipeline as P
from tidemark.llm import lang_id
from tidemark.llm.common import map_rows

from . import test_decontaminate, test_line_dedup, test_mixing, test_simhash_dedup

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    state = {r.doc_id: r.asDict() for r in docs.collect()}
    steps = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]

    def apply(name, docs):
        out = steps[name](spark, docs, SF)
        assert out.columns == columns
        rows = {r.doc_id: r.asDict() for r in out.collect()}
        return rows, spark.createDataFrame([tuple(r[c] for c in columns) for r in rows.values()], docs.schema)

    model = lang_id.fit(docs.filter(~lang_id.held_out(docs.doc_id)))
    langs, _, rejected = model.predict([r["text"] for r in state.values()], lang_id.REJECT_RATIO)
    want = {d: s for (d, s), lang, no in zip(state.items(), langs, rejected, strict=True) if not no and lang != "und"}
    got, docs = apply("language_id", docs)
    assert got == want and len(got) >= 0.99 * len(state)

    want = {d: (t, n_drop) for d, t, _, n_drop in test_line_dedup.plain([(d, s["text"]) for d, s in got.items()])}
    before = got
    got, docs = apply("line_dedup", docs)
    assert {d: s["text"] for d, s in got.items()} == {d: t for d, (t, _) in want.items()}
    assert all(s["n_chars"] == (len(s["text"]) if want[d][1] else before[d]["n_chars"]) for d, s in got.items())

    ids = sorted(got)
    classes = test_simhash_dedup.plain_classes([[test_simhash_dedup.plain_fingerprint(got[d]["text"], k, 5) for k in range(8)] for d in ids])
    want = {d: got[d] for i, d in enumerate(ids) if classes[i] == i}
    got, docs = apply("simhash_near_dedup", docs)
    assert got == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in test_decontaminate.brute_force([(d, s["text"]) for d, s in got.items()], items)}
    want = {d: s for d, s in got.items() if d not in bad}
    got, docs = apply("decontamination", docs)
    assert got == want and bad

    rows = steps["mixing"](spark, docs, SF).collect()
    test_mixing.check([(d, s["text"], s["source"]) for d, s in got.items()], rows)
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, rows))


def test_rows_are_taken_from_a_batch_a_few_at_a_time(spark):
    def sizes(columns):
        yield (len(columns[0]),)

    got = map_rows(spark.range(0, 1000, 1, 1), sizes, "n long").collect()
    assert [r.n for r in got] == [256, 256, 256, 232]
