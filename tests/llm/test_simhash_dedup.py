import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash_dedup as S


def scrambled(h, k):
    """Output k of SplitMix64 whose state is h; the hash itself for k = 0."""
    if k == 0:
        return h
    z = (h + k * 0x9E3779B97F4A7C15) % 2**64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
    return z ^ z >> 31


def plain_fingerprint(text, k=0, size=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [scrambled(xxhash.xxh64_intdigest(g, seed=42), k) for g in grams]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes) > 0)


def plain_classes(fps):
    """Smallest index reachable of each index, by comparing all pairs; of lists of fingerprints, any two in the same place link."""
    at = list(range(len(fps)))
    x = np.array(fps, np.uint64).reshape(len(fps), -1)
    changed = True
    near = [np.flatnonzero((np.bitwise_count(x ^ v) <= 3).any(axis=1)) for v in x]
    while changed:
        changed = False
        for i, js in enumerate(near):
            low = min(at[j] for j in js)
            if low < at[i]:
                at[i], changed = low, True
    return at


def test_fingerprint_follows_its_definition():
    for t in (None, "", " \t\n", "One", "one two", "A b c", "Ünï X y z w", "a b c d e f " * 40, " ".join(map(str, range(300)))):
        assert S.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("split_at", [512, 1])
def test_classes_equal_those_of_all_pairs(spark, split_at):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 5000, n)) for n in (5, 30, 200, 400, 60)]
    texts = [None, "", "  ", *base]
    for b in base[2:]:
        for _ in range(12):
            w = b.split()
            w[int(rng.integers(len(w)))] = "changed"
            texts.append(" ".join(w))
    texts += base
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(3)
    got = {r.doc_id: (r.fp, r.component_id) for r in S.near_duplicates(df, split_at=split_at).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_classes(fps)
    assert got == {i: (S._signed(f), c) for i, (f, c) in enumerate(zip(fps, want, strict=True))}
    kept = {r.doc_id for r in S.keep_first(df, split_at=split_at).collect()}
    assert kept == set(want)


def test_families_follow_their_definition():
    for t in (None, "", "One", "A b c", "a b c d e f " * 40, " ".join(map(str, range(300)))):
        assert S.family(t, 4, 5) == [plain_fingerprint(t, k, 5) for k in range(4)]


@pytest.mark.parametrize("split_at", [512, 1])
def test_several_fingerprints_equal_all_pairs(spark, split_at):
    rng = np.random.default_rng(5)
    texts = [None, "", "one", "one", "one two"]
    for n in (30, 90, 200, 300):
        b = [f"w{k}" for k in rng.integers(0, 5000, n)]
        texts.append(" ".join(b))
        for _ in range(10):
            w = list(b)
            for at in rng.integers(0, n, 1 + n // 100):
                w[at] = "changed"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate([*texts, *texts[:7]])), "doc_id long, text string").repartition(3)
    options = {"words_per_shingle": 5, "count": 4, "split_at": split_at}
    fps = [[plain_fingerprint(t, k, 5) for k in range(4)] for t in [*texts, *texts[:7]]]
    want = plain_classes(fps)
    assert {r.doc_id: (r.fp, r.component_id) for r in S.near_duplicates(df, **options).collect()} == {i: (S._signed(f[0]), c) for i, (f, c) in enumerate(zip(fps, want, strict=True))}
    assert len(set(want)) < len(set(plain_classes([f[0] for f in fps])))
    assert {r.doc_id for r in S.keep_first(df, **options).collect()} == set(want)
    assert S.near_duplicates(df.limit(0), **options).count() == 0


def test_ball_search_finds_what_all_pairs_find(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 14, 5000).astype(np.int64) << 3)
    found = set(map(tuple, map(sorted, S._near_pairs(x))))
    want = {(int(a), int(b)) for i, a in enumerate(x) for b in x[i + 1 :][np.bitwise_count(x[i + 1 :] ^ a) <= 3]} if len(x) < 6000 else None
    assert found == want


def test_long_lists_of_few_shared_bytes_are_tallied(monkeypatch):
    monkeypatch.setattr(S, "DENSE", 8)
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 1 << 62, 600))
    x = np.unique(np.concatenate([x, x ^ (1 << rng.integers(0, 60, len(x)))]))
    assert S._all_share(x.view(np.uint64)) is None
    want = {(int(a), int(b)) for i, a in enumerate(x) for b in x[i + 1 :][np.bitwise_count(x[i + 1 :] ^ a) <= 3]}
    assert set(map(tuple, map(sorted, S._near_pairs(x)))) == want


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(k, "a b c d e", k, 1, 2, 3) for k in (5, 3, 4)], "doc_id long, text string, _stays long, stays int, fp int, component_id int")
    out = S.keep_first(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(3, "a b c d e", 3, 1, 2, 3)]


def test_chains_of_thousands_of_links(spark):
    from tidemark.graph import components

    n = 3000
    order = np.random.default_rng(4).permutation(n).tolist()
    df = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == dict.fromkeys(range(1, n), 0)


def test_query_on_real_documents(spark):
    from tidemark.llm.queries import QUERIES

    got = QUERIES["op8_simhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    want = plain_classes(fps)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d.doc_id, f"{f:016x}", docs[c].doc_id) for d, f, c in zip(docs, fps, want, strict=True)}


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d")], "doc_id long, text string")
    rows = S.near_duplicates(df).select("doc_id", "component_id").orderBy(F.col("doc_id")).collect()
    assert [tuple(r) for r in rows] == [(None, 7), (7, 7), (7, 7)]
