import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as S
from tidemark.llm.queries import QUERIES


def plain(rows, length=50):
    """Rows in order of doc_id, each held against all strings of smaller doc_ids."""
    seen, out, order = set(), {}, sorted(range(len(rows)), key=lambda i: S.NO_ID if rows[i][0] is None else rows[i][0])
    fresh, last = set(), None
    for i in order:
        d, t = rows[i][0] if rows[i][0] is not None else S.NO_ID, rows[i][1]
        if d != last:
            seen |= fresh
            fresh, last = set(), d
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = hash(b[s : s + length])
            fresh.add(x)
            if x in seen:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (rows[i][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


def collect(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def make(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randint(1, 9)))
    passages = ["".join(word() for _ in range(rng.randint(8, 60))) for _ in range(6)] + ["ab" * 60, "=" * 200]
    rows = []
    for d in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        text = "".join(p[rng.randint(0, 20) :] if rng.random() < 0.3 else p for p in parts)
        rows.append((d * 37 % 1009, text))
    rows += [(2000 + k, rows[3][1]) for k in range(5)] + [(2010, None), (2011, ""), (2012, "x" * 49), (2013, "x" * 50), (2014, "x" * 50), (None, rows[5][1]), rows[7]]
    # Null and repeated doc_ids with different texts, with texts that others have, and twice over.
    own = ["".join(word() for _ in range(40)) for _ in range(6)]
    rows += [(None, own[0]), (None, own[1]), (None, own[0]), (None, own[2] + passages[0]), (None, own[2]), (None, None), (None, "")]
    rows += [(rows[3][0], own[3]), (rows[3][0], own[3] + own[4]), (3000, own[4]), (3000, own[5]), (3000, own[5] + own[1]), (3001, own[5]), (-4, own[5]), ((1 << 63) - 1, own[4])]
    return rows


def test_sort_orders_windows():
    rng = random.Random(0)
    buffer = b"".join(rng.choice([b"the quick brown fox ", b"the quick brown fix ", b"aaaaaaaaaaaaaaaa", bytes(rng.choices(range(256), k=7))]) for _ in range(300))
    starts = np.array(rng.sample(range(len(buffer) - 50), 1500))
    for rounds in (0, 1, 3):
        order, rank = S.deep_shallow_sort(buffer, starts, 50, rounds)
        strings = [buffer[s : s + 50] for s in starts[order].tolist()]
        assert strings == sorted(strings)
        assert [strings[k] == strings[k - 1] for k in range(1, len(strings))] == [rank[k] == rank[k - 1] for k in range(1, len(strings))]


def test_runs_cover_every_window_once(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abc", k=n)) for n in (0, 49, 50, 51, 400, 3000)] + [b"=" * 500, b"xy" * 300]
    whole = [np.concatenate(x) for x in zip(*S.find_anchors(texts), strict=True)]
    first, last = S.runs(*whole, np.array([len(t) for t in texts]))
    for i, t in enumerate(texts):
        mine = whole[0] == i
        covered = sorted(s for f, u in zip(first[mine], last[mine], strict=True) for s in range(f, u + 1))
        assert covered == list(range(len(t) - 49))
    monkeypatch.setattr(S, "CHUNK", 100)
    parts = [np.concatenate(x) for x in zip(*S.find_anchors(texts), strict=True)]
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


@pytest.mark.parametrize(("hot", "unit"), [(S.HOT, S.UNIT_BYTES), (3, 100)])
def test_equals_plain_version(spark, hot, unit):
    rows = make(hot)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int").repartition(5)
    assert collect(S.remove_repeats(df, unit_bytes=unit, hot_at=hot)) == plain(rows)


def test_unlike_texts_of_one_id_stay(spark):
    a, b = "".join(chr(97 + k * k % 23) for k in range(80)), "".join(chr(97 + k * k * k % 19) for k in range(529))
    for rows in ([(1, a), (None, a), (None, b)], [(1, a), (2, a), (2, b)]):
        got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.n_bytes, r.n_removed) for r in got) == [(80, 0), (80, 80), (529, 0)]


def test_other_columns_are_not_looked_at(spark):
    rows = [(k, "text " * 30, k, k, "x") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, shard long, digest string")
    assert sorted(r.n_removed for r in S.remove_repeats(df).collect()) == [0, 150, 150]


def test_query_on_real_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op9_suffix_dedup"](spark, sf).collect()), key=str)
    assert got == plain(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df).count() == 0
    with pytest.raises(ValueError):
        S.remove_repeats(df, length=10)
