"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is spent in whole passes over its documents while they fit; what remains is a subset sum.
Documents are counted by exact length. Of each length the share that the budget is of the source is taken
first, then whole documents by the largest remainder down to ``dp_budget`` words, and bounded-knapsack
dynamic programming over the counts that are left fits the rest as closely as they allow. At last documents
are selected by length count: of every length the number decided, in a seeded order.

Only counts by length meet in one task for a source. A source of size S has at most sqrt(2 S) lengths.
Documents are ranked by one range-partitioned sort on (source, size, seeded hash), so a hot source or length
is dealt over many tasks like any other rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import count_words, cut

#: Words that the dynamic program fits at most, and how many times a document may be taken.
DP_BUDGET, MOST_TIMES = 1 << 16, 3


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum comes as near ``budget`` from below as can be.

    Bounded knapsack: counts are split into powers of two, each a step of a bit set of reachable sums. A sum
    remembers the step that first reached it, which gives a subset when read backwards.
    """
    taken = [0] * len(lengths)
    if budget <= 0:
        return taken
    full = (1 << budget + 1) - 1
    reach, steps, news = 1, [], []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if not 0 < lengths[k] <= budget:
            continue
        left, size = min(counts[k], budget // lengths[k]), 1
        while left and not reach >> budget & 1:
            size = min(size, left)
            if size * lengths[k] <= budget and (new := (reach << size * lengths[k]) & full & ~reach):
                reach |= new
                steps.append((k, size))
                news.append(new)
            left -= size
            size *= 2
        if reach >> budget & 1:
            break
    at, step = reach.bit_length() - 1, len(steps)
    while at:
        step -= 1
        if news[step] >> at & 1:
            k, size = steps[step]
            taken[k] += size
            at -= size * lengths[k]
    return taken


def plan_lengths(lengths: Sequence[int], counts: Sequence[int], budget: int, dp_budget: int = DP_BUDGET) -> list[int]:
    """Number of documents of each length for a budget of at most what there is: shares, remainders, then the knapsack."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    for k in sorted(range(len(lengths)), key=lambda k: (-(counts[k] * budget % total), lengths[k])):
        if left <= dp_budget:
            break
        if taken[k] < counts[k] and 0 < lengths[k] <= left - dp_budget // 2:
            taken[k] += 1
            left -= lengths[k]
    rest = [c - t for c, t in zip(counts, taken, strict=True)]
    while left > dp_budget:  # very long documents only: take what fits, the longest first
        k = max((k for k in range(len(lengths)) if rest[k] and lengths[k] <= left), key=lambda k: lengths[k], default=None)
        if k is None:
            break
        taken[k], rest[k], left = taken[k] + 1, rest[k] - 1, left - lengths[k]
    return [t + x for t, x in zip(taken, fit_budget(lengths, rest, min(left, dp_budget)), strict=True)]


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_TIMES) -> list[float]:
    """Shares of the total by weight; what goes beyond ``most`` times a size is shared again until none is above."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        total = sum(weights[k] for k in free)
        over = [k for k in sorted(free) if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(most * sizes[k])
            free.remove(k)
        left -= sum(out[k] for k in over)
    return out


def _source_targets(lengths: DataFrame, weights: Sequence[float]) -> DataFrame:
    """One row per source: source, source_size, target. Sources by code point, null last, get the weights in turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        order = sorted(range(len(rows)), key=lambda i: (rows["source"].iloc[i] is None, rows["source"].iloc[i] or ""))
        rows = rows.iloc[order].copy()
        rows["target"] = targets(rows["source_size"].tolist(), [weights[i % len(weights)] for i in range(len(rows))])
        yield rows

    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    return sizes.repartition(1).mapInPandas(run, "source string, source_size long, target double")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = 7, dp_budget: int = DP_BUDGET) -> DataFrame:
    """Mixture of ``docs`` (doc_id, text, source) in which each source has the words its weight asks for.

    Returns a row for each row of ``docs``: doc_id, source, size, source_size, target and taken, the words the
    mix takes of it: 0 to 3 times its size. The same input, weights and seed give the same mix.

    * A null text has size 0; rows of size 0 take 0. A null source is a source of its own, the last.
    * Repeated rows are rows of their own; which of them is taken is not told apart. Null doc_ids are taken as any.
    * An empty table gives an empty result. Other columns are not looked at.
    """
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), count_words(F.col("text").cast("string")).alias("size")).withColumn("h", h)
    sized = cut(sized)  # else the sort's sampling would read and count all texts a second time
    order = ["source", "size", "h", "doc_id"]
    ranked = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = cut(ranked.withColumn("at", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))

    lengths = cut(ranked.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = _source_targets(lengths, weights)

    def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        budget = round(target)
        whole = min(budget // size, MOST_TIMES) if size else 0
        some = plan_lengths(pdf["size"].tolist(), pdf["n"].tolist(), budget - whole * size, dp_budget) if whole < MOST_TIMES else [0] * len(pdf)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "source_size": size, "target": target, "whole": whole, "some": some})

    plan = lengths.join(per_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = cut(plan.groupBy("source").applyInPandas(decide, "source string, size long, source_size long, target double, whole long, some long"))

    # Rank of a row among those of its source and length: its place in the sorted whole, less the place of the first.
    # One row for each partition meets on the driver; their offsets go back with a join.
    parts, total = [], 0
    for r in sorted(ranked.groupBy("part").agg(F.count("*").alias("n")).collect()):
        parts.append((r["part"], total))
        total += r["n"]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(parts, "part long, offset long"))
    starts = ranked.groupBy("source", "size", "part").agg(F.min("at").alias("at")).join(offsets, "part")
    first = starts.groupBy("source", "size").agg(F.min(F.col("offset") + F.col("at")).alias("first"))

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))

    chosen = cut(plan.alias("p").join(first.alias("f"), same("p", "f")).select("p.*", "first"))
    mixed = ranked.join(offsets, "part").withColumn("place", F.col("offset") + F.col("at")).alias("r").join(chosen.alias("c"), same("r", "c"))
    times = F.col("whole") + (F.col("place") - F.col("first") < F.col("some")).cast("long")
    return mixed.select("r.doc_id", "r.source", "r.size", "c.source_size", "c.target", (times * F.col("r.size")).alias("taken"))
