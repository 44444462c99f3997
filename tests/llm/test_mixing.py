import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import mixing as M
from tidemark.llm.queries import QUERIES


def test_knapsack_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), rng.randint(1, 5))
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 80)
        taken = M.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        best = max(s for t in itertools.product(*(range(c + 1) for c in counts)) if (s := sum(a * b for a, b in zip(t, lengths, strict=True))) <= budget)
        assert sum(a * b for a, b in zip(taken, lengths, strict=True)) == best


@pytest.mark.parametrize("dp_budget", [M.DP_BUDGET, 500])
def test_large_budgets_are_met(dp_budget):
    rng = random.Random(6)
    lengths = list(range(1, 400)) + [5000, 90000]
    counts = [rng.randint(1, 50) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    for share in (0, 0.001, 0.3, 0.77, 1):
        taken = M.plan_lengths(lengths, counts, int(total * share), dp_budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert sum(a * b for a, b in zip(taken, lengths, strict=True)) == int(total * share)


def test_targets_share_the_excess():
    assert M.targets([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    assert M.targets([1, 100, 0], [3, 1, 2]) == pytest.approx([3, 98, 0])
    assert M.targets([], []) == []


def check(docs, rows):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    per = defaultdict(int)
    for d, _, s in docs:
        per[s] += size[d]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, M.targets([per[s] for s in order], [k % 3 + 1 for k in range(len(order))]), strict=True))
    taken, of = defaultdict(int), {d: s for d, _, s in docs}
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        assert (r["size"], r.source_size) == (size[r.doc_id], per[of[r.doc_id]]) and r.target == pytest.approx(want[of[r.doc_id]])
        assert r.taken in {k * r["size"] for k in range(4)}
        taken[of[r.doc_id]] += r.taken
    for s in order:
        longest = max(size[d] for d in of if of[d] == s)
        assert abs(taken[s] - want[s]) <= max(1, min(longest, 0.02 * per[s] + 3))


def test_small_tables(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(["w"] * rng.choice([1, 1, 2, 5, 40, 300])), rng.choice(["b", "a", "a", "a", None, "ä"])) for i in range(400)]
    docs += [(1000, None, "b"), (1001, "", None), (1002, " \t ", "empty")]
    df = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, source string, size string").repartition(5)
    rows = M.mix(df).collect()
    check(docs, rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, M.mix(df.repartition(2)).collect()), key=str)
    assert M.mix(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "a", "s")], "doc_id long, text string, source string")
    assert M.mix(twice).count() == 3


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op3_mixing"](spark, sf).collect()
    check(docs, rows)
    assert Counter(r.doc_id for r in rows).most_common(1)[0][1] == 1
