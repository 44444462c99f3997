"""Time series of a track: intervals, rhythm, harmony and structure.

Points come as rows (key, t, ...); a series is ordered by window functions per key. Where the rule is a fold over
what came before, the rows of one key are gathered to a sorted array and folded by ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import stats as S


def ordered(by: list[str], *order: str):
    return Window.partitionBy(*by).orderBy(*order)


def intervals(points: DataFrame, by: list[str], t: str = "t", end: str = "end", tie: str = "seq") -> DataFrame:
    """Add duration: to the next point, for the last one to the column ``end``; never negative."""
    nxt = F.coalesce(F.lead(t).over(ordered(by, t, tie)), F.col(end))
    return points.withColumn("duration", F.greatest(nxt - F.col(t), F.lit(0)))


def every(points: DataFrame, by: list[str], n: int, t: str = "t", tie: str = "seq") -> DataFrame:
    """Every n-th point from the first, as bars are of beats."""
    place = F.row_number().over(ordered(by, t, tie)) - 1
    return points.withColumn("_i", place).filter(F.col("_i") % n == 0).drop("_i")


def subdivide(with_duration: DataFrame, parts: int = 2, t: str = "t") -> DataFrame:
    """Split each interval into equal parts (start, duration, part)."""
    out = with_duration.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return out.withColumn("start", F.col(t) + F.col("duration") * F.col("part") / parts).withColumn("duration", F.col("duration") / parts)


def beat_stats(points: DataFrame, by: list[str], t: str = "t", tie: str = "seq") -> DataFrame:
    """Beats, mean and spread of the times between them, regularity; the latter null for under two gaps."""
    gaps = points.withColumn("_gap", F.col(t) - F.lag(t).over(ordered(by, t, tie)))
    out = gaps.groupBy(*by).agg(F.count("*").alias("beats"), F.avg("_gap").alias("ibi_mean"), F.stddev_pop("_gap").alias("ibi_std"), F.count("_gap").alias("_n"))
    regular = F.when((F.col("_n") > 1) & (F.col("ibi_mean") > 0), 1 - S.clip(F.col("ibi_std") / F.col("ibi_mean")))
    return out.withColumn("regularity", regular).drop("_n")


def collapse(points: DataFrame, by: list[str], value: str, t: str = "t") -> DataFrame:
    """Points whose value is not that of the one before."""
    w = ordered(by, t)
    first = F.row_number().over(w) == 1
    return points.withColumn("_new", first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).filter("_new").drop("_new")


def change_rate(points: DataFrame, by: list[str], value: str, t: str = "t") -> DataFrame:
    """Points, changes between neighbours and their share."""
    changed = (F.col(value) != F.lag(value).over(ordered(by, t))).cast("long")
    out = points.withColumn("_c", changed).groupBy(*by).agg(F.count("*").alias("points"), F.coalesce(F.sum("_c"), F.lit(0)).alias("changes"))
    return out.withColumn("rate", F.when(F.col("points") > 1, F.col("changes") / (F.col("points") - 1)).otherwise(0.0))


def transitions(points: DataFrame, by: list[str], value: str, t: str = "t") -> DataFrame:
    """Count of each step from one value to the next, over all keys, and its share of the steps from there."""
    steps = points.withColumn("to", F.lead(value).over(ordered(by, t))).filter(F.col("to").isNotNull())
    counts = steps.groupBy(F.col(value).alias("from"), "to").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def harmonic_complexity(steps: DataFrame, vocabulary: int = 24) -> DataFrame:
    """Half the share of values used, half the entropy of the steps over the greatest that it can be."""
    used = steps.select(F.explode(F.array("from", "to")).alias("x")).distinct().agg(F.count("*").alias("used"))
    total = steps.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    entropy = steps.crossJoin(total).agg(F.coalesce(-F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") / F.col("total"))), F.lit(0.0)).alias("h"), F.max("kinds").alias("kinds"))
    scaled = F.col("h") / F.log2(F.greatest(F.col("kinds"), F.lit(2)))
    return used.crossJoin(entropy).select("used", scaled.alias("entropy"), S.clip(0.5 * F.col("used") / vocabulary + 0.5 * scaled).alias("complexity"))


def histogram(points: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(by, bin, n) of equal bins, the last one closed; bins without a value are there with 0."""
    x = F.col(value)
    at = F.when(x == high, bins - 1).otherwise(F.floor((x - low) / ((high - low) / bins)))
    counts = points.filter((x >= low) & (x <= high)).groupBy(*by, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    dense = points.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return dense.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def spread_histogram(points: DataFrame, by: list[str], value: str, bins: int = 20) -> DataFrame:
    """(by, bin, n) between each key's least and greatest value."""
    ends = points.groupBy(*by).agg(F.min(value).alias("_l"), F.max(value).alias("_h"))
    x = points.join(ends, by)
    at = F.when(F.col("_h") == F.col("_l"), F.lit(bins // 2)).when(F.col(value) == F.col("_h"), bins - 1).otherwise(F.floor((F.col(value) - F.col("_l")) / ((F.col("_h") - F.col("_l")) / bins)))
    return x.groupBy(*by, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def rhythmic_entropy(hist: DataFrame, by: list[str]) -> DataFrame:
    """Entropy of a histogram's shares, in bits."""
    share = hist.withColumn("_p", F.col("n") / F.sum("n").over(Window.partitionBy(*by))).filter("_p > 0")
    return share.groupBy(*by).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


def mode_of(points: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent value of each key, the least of equals."""
    counts = points.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"))


def nearest(points: DataFrame, others: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """``points`` with the distance to the nearest of ``others`` of the same key, by a merge of both and two looks.

    The union is sorted once for each key; the last of the others before and the first behind are carried over.
    """
    marked = points.withColumn("_o", F.lit(None).cast("double")).withColumn("_is", F.lit(1))
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema if f.name not in (*by, t)]
    theirs = others.select(*by, F.col(t), *extra, F.col(t).cast("double").alias("_o"), F.lit(0).alias("_is")).select(*marked.columns)
    w = ordered(by, t, "_is")
    back = F.last("_o", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_o", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col(t), F.col("_is")).rowsBetween(0, Window.unboundedFollowing))
    out = marked.unionByName(theirs).withColumn("_b", back).withColumn("_a", ahead).filter("_is = 1")
    return out.withColumn("distance", F.least(F.col(t) - F.col("_b"), F.col("_a") - F.col(t))).drop("_o", "_is", "_b", "_a")


def syncopation(onsets: DataFrame, beats: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """Share of onsets farther from a beat than a quarter of the median time between beats."""
    gaps = beats.withColumn("_gap", F.col(t) - F.lag(t).over(ordered(by, t))).groupBy(*by).agg(F.percentile("_gap", 0.5).alias("_ibi"))
    far = (F.col("distance") > 0.25 * F.col("_ibi")).cast("double")
    return nearest(onsets, beats, by, t).join(gaps, by).groupBy(*by).agg(F.avg(far).alias("syncopation"))


def rhythm_block(points: DataFrame, onsets: DataFrame, beats: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row for each key: beats, times between them, regularity, entropy of the values and syncopation; null for under four beats."""
    block = beat_stats(points, by).join(rhythmic_entropy(spread_histogram(points, by, value), by), by, "left").join(syncopation(onsets, beats, by), by, "left")
    measures = ["ibi_mean", "ibi_std", "regularity", "entropy", "syncopation"]
    return block.select(*by, "beats", *[F.when(F.col("beats") >= 4, F.col(c)).alias(c) for c in measures])


def beats_per_bar(beats: DataFrame, downbeats: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """(by, bar, n): beats from each downbeat to the next; the last downbeat opens no bar.

    A running count of downbeats numbers the bars, so nothing is compared pairwise.
    """
    both = beats.select(*by, t, F.lit(1).alias("_is")).union(downbeats.select(*by, t, F.lit(0).alias("_is")))
    bar = F.sum(1 - F.col("_is")).over(ordered(by, t, "_is").rowsBetween(Window.unboundedPreceding, 0))
    last = F.sum(1 - F.col("_is")).over(Window.partitionBy(*by))
    inside = both.withColumn("bar", bar).withColumn("_last", last).filter("bar >= 1 and bar < _last")
    return inside.groupBy(*by, "bar").agg(F.sum("_is").alias("n"))


def interpolate(points: DataFrame, series: DataFrame, by: list[str], t: str = "t", value: str = "value") -> DataFrame:
    """``points`` with the series' value at their time, on a line between neighbours, the end values beyond."""
    names = [c for c in points.columns if c not in (*by, t)]
    a = points.select(*by, t, *names, F.lit(1).alias("_is"), F.lit(None).cast("struct<t:double,v:double>").alias("_s"))
    b = series.select(*by, F.col(t), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in names], F.lit(0).alias("_is"), F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("_s"))
    w = ordered(by, t, "_is")
    both = a.unionByName(b)
    both = both.withColumn("_b", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_a", F.first("_s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).filter("_is = 1")
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col(t) - F.col("_b.t")) / (F.col("_a.t") - F.col("_b.t"))
    got = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_a.t") == F.col("_b.t"), F.col("_b.v")).otherwise(line)
    return both.withColumn(value, got).drop("_is", "_s", "_a", "_b")


def sliding_means(frames: DataFrame, by: list[str], t: str, value: str, size: int, hop: int) -> DataFrame:
    """(by, start, mean, n) of windows of ``size`` every ``hop``; a frame goes to each window that holds it."""
    k = F.explode(F.sequence(F.floor((F.col(t) - size) / hop) + 1, F.floor(F.col(t) / hop)))
    windows = frames.withColumn("_k", k).filter("_k >= 0")
    return windows.groupBy(*by, (F.col("_k") * hop).alias("start")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def modulations(keys: Column, first: Column, least: float = 0.5) -> Column:
    """Changes of key among windows (t, key, confidence), each against the last key that was taken.

    A fold: a window changes the key if it differs from it and is confident enough.
    """
    empty = F.array().cast("array<struct<t:double,before:string,after:string,confidence:double>>")
    start = F.struct(first.cast("string").alias("key"), empty.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        takes = (x["key"] != acc["key"]) & (x["confidence"] > least)
        change = F.struct(x["t"].cast("double").alias("t"), acc["key"].alias("before"), x["key"].alias("after"), x["confidence"].cast("double").alias("confidence"))
        return F.struct(F.when(takes, x["key"]).otherwise(acc["key"]).alias("key"), F.when(takes, F.array_append(acc["found"], change)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(keys, start, step, lambda acc: acc["found"])


SEGMENT = "struct<start:double,end:double,cluster:int,energy:double>"


def merge_short(segments: Column, least: float = 3.0) -> Column:
    """Merge segments (start, end, cluster, energy) shorter than ``least`` into the one before, energies by duration.

    A first one that short is put in front of the next that is long enough.
    """
    empty = F.array().cast(f"array<{SEGMENT}>")
    start = F.struct(empty.alias("out"), F.lit(None).cast("double").alias("head"))

    def step(acc: Column, s: Column) -> Column:
        size = s["end"] - s["start"]
        has, short = F.size(acc["out"]) > 0, size < least
        prev = F.element_at(acc["out"], -1)
        w = prev["end"] - prev["start"]
        joined = F.struct(prev["start"].alias("start"), s["end"].alias("end"), prev["cluster"].alias("cluster"), ((prev["energy"] * w + s["energy"] * size) / (w + size + 1e-9)).alias("energy"))
        begun = F.struct(F.coalesce(acc["head"], s["start"]).alias("start"), s["end"].alias("end"), s["cluster"].alias("cluster"), s["energy"].alias("energy"))
        merged = F.array_append(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), joined)
        alone = ~has & short & (F.size(segments) > 1)
        out = F.when(has & short & acc["head"].isNull(), merged).when(has & short, merged)
        first_short = F.array_append(acc["out"], s)
        replaced = F.array_append(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), begun)
        new = out.when(alone, first_short).when(acc["head"].isNotNull(), replaced).otherwise(F.array_append(acc["out"], s))
        head = F.when(alone, s["start"]).when(has & short, acc["head"])
        return F.struct(new.cast(f"array<{SEGMENT}>").alias("out"), head.cast("double").alias("head"))

    return F.aggregate(segments, start, step, lambda acc: acc["out"])


def repetition(segments: DataFrame, by: list[str]) -> DataFrame:
    """Share of time in clusters that are there more than once; rows (by, start, end, cluster)."""
    n = F.count("*").over(Window.partitionBy(*by, "cluster"))
    size = F.col("end") - F.col("start")
    return segments.withColumn("_n", n).groupBy(*by).agg((F.sum(F.when(F.col("_n") > 1, size).otherwise(0.0)) / F.sum(size)).alias("repetition"))


def label_sections(segments: DataFrame, by: list[str], duration: str = "duration") -> DataFrame:
    """Add label to segments (by, start, end, cluster, energy, duration): intro, outro, chorus, verse, breakdown, solo or bridge."""
    whole, cluster = Window.partitionBy(*by), Window.partitionBy(*by, "cluster")
    w = ordered(by, "start", "end", "cluster", "energy")
    s = segments.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(whole)).withColumn("_count", F.count("*").over(cluster))
    low, high = F.min("energy").over(whole), F.max("energy").over(whole)
    s = s.withColumn("_e", (F.col("energy") - low) / (high - low + 1e-12)).withColumn("_ce", F.avg("_e").over(cluster))
    # Clusters by how often, then how loud they are: the first is the chorus, the second the verse, if they repeat.
    s = s.withColumn("_place", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("_count"), F.round("_ce", 9).desc(), "cluster")))
    d = F.col(duration)
    repeats = F.col("_count") >= 2
    label = (
        F.when((F.col("_i") == 1) & (F.col("end") < d * 0.2), "intro")
        .when((F.col("_i") == F.col("_n")) & (F.col("start") > d * 0.75), "outro")
        .when((F.col("_place") == 1) & repeats, "chorus")
        .when((F.col("_place") == 2) & repeats, "verse")
        .when(F.col("_e") < 0.25, "breakdown")
        .when((F.col("_count") == 1) & (F.col("_e") > 0.8) & (F.col("start") > d * 0.4) & (F.col("start") < d * 0.85), "solo")
        .when(F.col("_count") == 1, "bridge")
        .otherwise("verse")
    )
    return s.withColumn("label", label).select(*segments.columns, "label")
