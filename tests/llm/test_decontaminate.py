import random
import re
from collections import Counter

import pytest

from tidemark.llm import decontaminate as D
from tidemark.llm.queries import QUERIES


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain(docs, items, threshold=0.8):
    """{(doc_id, item_id): best similarity} over all windows that a shared shingle aligns."""
    out = {}
    for i, it in items:
        iw = words(it)
        g = grams(iw)
        for d, t in docs:
            w, k = words(t), min(5, len(iw))
            starts = {p - q for p in range(len(w) - k + 1) for q in range(len(iw) - k + 1) if w[p : p + k] == iw[q : q + k]} if iw else ()
            for s in starts:
                h = grams(w[max(0, s) : s + len(iw)])
                sim = sum((g & h).values()) / sum((g | h).values())
                if sim >= threshold:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def make(seed=0):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "to", "in"] + ["".join(rng.choices("abcdeé", k=rng.randint(2, 9))) for _ in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 6, 12, 30, 60])))) for i in range(30)]
    items += [(30, None), (31, " .,"), (32, items[5][1]), (33, "the the the the the the the the the")]
    docs = []
    for d in range(150):
        w = rng.choices(vocab, k=rng.randint(0, 120))
        if rng.random() < 0.6:
            own = words(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                if own:
                    at = rng.randrange(len(own))
                    rng.choice([lambda: own.__setitem__(at, "changed"), lambda: own.insert(at, "more"), lambda: own.pop(at)])()
            cut = rng.choice([0, 0, 3])
            at = rng.randint(0, len(w))
            w = w[:at] + own[cut:] + (w[at:] if rng.random() < 0.8 else [])
        docs.append((d, ", ".join(w).title() if d % 3 else " ".join(w)))
    return docs + [(500, None), (501, ""), (502, "the " * 3000)], items


@pytest.mark.parametrize("literal_bound", [50_000, 0])
def test_equals_plain_version(spark, literal_bound):
    docs, items = make()
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, window string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in D.matches(df, bench, literal_bound=literal_bound).collect()}
    assert got == {k: round(v, 9) for k, v in plain(docs, items).items()}
    assert any(0.8 <= v < 1 for v in got.values())


def test_blocks_find_all_within_the_radius():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), D.RADIUS):
            b ^= 1 << k
        assert any((a >> 8 * n & 255) ^ (b >> 8 * n & 255) in D._FLIPS for n in range(8))


def test_fingerprints_follow_their_definition(spark):
    """Of every window over an anchor, and of no other."""
    docs, items = make(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = D.cut(D._items(bench))
    anchors = D.cut(D._anchors(known, 0.8))
    places = D._places(spark.createDataFrame(docs, "doc_id long, text string"), anchors, [1, 3, 5], 50_000)
    pieces = D._pieces(places, 60)
    rows = D._windows(pieces, anchors).join(pieces.select("piece", "doc_id"), "piece").collect()
    hashed = {r.s: r.h for r in spark.createDataFrame([(s,) for s in {" ".join(g) for _, t in docs for k in (1, 3, 5) for g in grams_of(words(t), k)}], "s string").selectExpr("s", "xxhash64(s) h").collect()}
    of = {r.anchor: set() for r in anchors.collect()}
    for r in anchors.collect():
        of[r.anchor].add(r["size"])
    want = {}
    for d, t in docs:
        w = words(t)
        for k in (1, 3, 5):
            h = [hashed[" ".join(g)] for g in grams_of(w, k)]
            for at, x in enumerate(h):
                for size in of.get(x, ()):
                    if min(5, size) == k:
                        for s in range(at - size + k, at + 1):
                            own = h[max(0, s) : min(len(w), s + size) - k + 1]
                            want[d, size, s] = sum(1 << b for b in range(64) if 2 * sum(y >> b & 1 for y in own) > len(own))
    assert {(r.doc_id, r["size"], r.s): r.fp % (1 << 64) for r in rows} == want


def grams_of(w, k):
    return [w[i : i + k] for i in range(len(w) - k + 1)]


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "one two three four five six", 7, 8, "x"), (2, "clean", 7, 8, "x")], "doc_id long, text string, _bad int, bad int, item_id string")
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    out = D.drop_contaminated(df, bench)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(2, "clean", 7, 8, "x")]


def test_query_on_real_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute_force(docs, items)
    got = QUERIES["op6_decontamination"](spark, sf).collect()
    assert {(r.doc_id, i) for r in got for i in r.item_ids} == set(want)


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "one two three four five six"), (1, "other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert [r.doc_id for r in D.contaminated(docs, bench).collect()] == [None]
    assert [r.doc_id for r in D.drop_contaminated(docs, bench).collect()] == [1]


def brute_force(docs, items, threshold=0.8):
    """The best similarity of each pair over windows at all starts."""
    out = {}
    for i, it in items:
        iw = words(it)
        g = grams(iw)
        for d, t in docs:
            w, k = words(t), min(5, len(iw))
            own, theirs = ({tuple(x[p : p + k]) for p in range(len(x) - k + 1)} for x in (iw, w))
            for s in range(1 - len(iw), len(w)) if k and own & theirs else ():
                h = grams(w[max(0, s) : s + len(iw)])
                sim = sum((g & h).values()) / sum((g | h).values())
                if sim >= threshold:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


@pytest.mark.parametrize("literal_bound", [50_000, 0])
def test_windows_at_all_starts(spark, literal_bound):
    rng = random.Random(5)
    items = [(n, " ".join(f"{rng.choice('abcdefgh') * rng.randint(1, 5)}{n}x{k}" for k in range(n))) for n in (3, 6, 30, 60, 80, 100)]
    docs = []
    for n, text in items:
        w, fill = text.split(), [f"w{k}" for k in range(40)]
        swapped = [*w[n // 2 :], *w[: n // 2]]
        pieces = [*w[: n // 4], "one", "two", *w[n // 4 : n // 2], "three", *w[n // 2 :]]
        docs += [(1000 + 10 * n + k, " ".join(x)) for k, x in enumerate([[*fill, *swapped, *fill], swapped, [*fill, *pieces, *fill], pieces, w])]
    lost = {(1600, 60), (1800, 80), (2000, 100)}
    more_docs, more_items = make()
    docs, items = docs + more_docs, items + [(1000 + i, t) for i, t in more_items]
    want = brute_force(docs, items)
    assert lost <= set(want) and not lost & set(plain(docs, items))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in D.matches(df, bench, literal_bound=literal_bound).collect()}
    assert got == {k: round(v, 9) for k, v in want.items()}
