import hashlib
import random

import pytest

from tidemark.llm import line_dedup as L
from tidemark.llm.queries import ORACLES, QUERIES

from .oracle import same_rows

WS = " \t\n\v\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def plain(rows, min_chars=40, min_docs=5):
    holders = {}
    for i, (_, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(rows[i][0])
    rank = lambda d: (d is not None, d or 0)
    last = {k: max(v, key=rank) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) in last and last[key(x)] != d)]
        out.append((d, "\n".join(kept) if len(kept) < len(lines) else text, len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows_of(seed=0, n=60):
    rng = random.Random(seed)
    common = ["\tShared  LINE number %d that is long enough to count as one " % i for i in range(12)] + ["É" * 39, "É" * 40, "x" * 39, "Y" * 40, "", "short"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.5 else f"own line {rng.random()} " * 3 for _ in range(rng.randint(1, 12)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, "Y" * 40), (3, "Y" * 40), (n + 2, ("Y" * 40 + "\n") * 3000)]


def collect(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


@pytest.mark.parametrize("broadcast_bytes", [L.BROADCAST_BYTES, 0])
def test_equals_plain_version(spark, broadcast_bytes):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, key string").repartition(4)
    out = L.dedup_lines(df, broadcast_bytes=broadcast_bytes)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    assert collect(out) == plain(rows)


def test_insert_and_delete_leave_what_a_new_index_has(spark):
    rows = [r for r in rows_of(1) if r[0] is not None][:-2]
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string").repartition(2)
    everything = make(rows)
    index = L.LineIndex.build(make(rows[:30])).insert(make(rows[30:]))
    assert collect(index.apply(everything)) == plain(rows)
    gone, stay = rows[10:50], rows[:10] + rows[50:]
    index = index.delete(make(gone).select("doc_id"))
    assert collect(index.apply(make(stay))) == plain(stay)
    fresh = L.LineIndex.build(make(stay))
    marks = lambda x: sum((f.tables[0] > 0).sum() for f in (L.CuckooFilter.from_bytes(bytes(r["filter"])) for r in x.filters.collect()))
    assert marks(index) == marks(fresh)


def test_repeated_rows_are_one_document(spark):
    line = "a line that is long enough to count as one of them"
    rows = [(1, line)] * 4 + [(2, line)]
    assert collect(L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows) == sorted([(d, t, 1, 0) for d, t in rows], key=str)


def test_clashing_columns_stay(spark):
    rows = [(k, "Y" * 40, k, "d", [b"x"], True, "o") for k in range(6)]
    names = "doc_id long, text string, _doc int, _drop string, drop array<binary>, key boolean, own_id string"
    out = L.dedup_lines(spark.createDataFrame(rows, names))
    assert out.columns == ["doc_id", "text", "_doc", "_drop", "drop", "key", "own_id", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in out.collect()) == sorted((*r[:1], r[1] if r[0] == 5 else "", *r[2:], 1, 0 if r[0] == 5 else 1) for r in rows)


def test_changes_write_no_more_than_they_touch(spark, monkeypatch):
    rows = [(k, "\n".join(f"line {k % 7} {j} that is long enough to be a key of its own" for j in range(3))) for k in range(70)]
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = L.LineIndex.build(make(rows))
    written = []
    monkeypatch.setattr(L, "cut", lambda df, real=L.cut: written.append(real(df)) or written[-1])
    after = index.insert(make([(100, rows[0][1]), (101, "a new line that nobody else has said before now")])).delete(make([(101, "")]).select("doc_id"))
    sizes = {tuple(df.columns): max(x.count() for x in written if x.columns == df.columns) for df in written}
    assert sizes["key", "doc_id"] <= 4 and sizes["key", "n_docs", "max_doc"] <= 21
    assert after.references.count() == index.references.count() + 3 == after.compact().references.count()
    assert collect(after.apply(make(rows))) == [x for x in plain([*rows, (100, rows[0][1])]) if x[0] != 100]


def test_filter_finds_all_keys_and_forgets_deleted_ones():
    import numpy as np

    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(5000)]
    f = L.CuckooFilter(100)
    for k in keys:
        f.insert(k)
    f = L.CuckooFilter.from_bytes(f.to_bytes())
    head = lambda ks: np.frombuffer(b"".join(k[:8] for k in ks), "<u8")
    assert len(f.tables) > 1 and f.contains(head(keys)).all()
    assert all(f.delete(k) for k in keys[:4000])
    assert f.contains(head(keys[4000:])).all() and f.contains(head(keys[:4000])).mean() < 0.05


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_sql(spark):
    same_rows(spark, QUERIES["op2_line_dedup"], ORACLES["op2_line_dedup"])
