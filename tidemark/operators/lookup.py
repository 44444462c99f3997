"""Look-ups by key, enrichment from tables that stand in for services, and audits of what came in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(table: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """A row for each of ``requests`` (key, ...) with the columns of ``table``, null where it has no such key, and found."""
    marked = table.withColumn("found", F.lit(True))
    return requests.join(marked, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def get(table: DataFrame, **keys) -> DataFrame:
    """The rows with the given values of some columns; none if there is no such row."""
    return table.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()]))


def lookup_batched(requests: DataFrame, table: DataFrame, key: str, batch: int = 50) -> DataFrame:
    """``lookup`` with the number of the call (long) that a service would be asked in, ``batch`` keys (whole numbers) to a call."""
    asked = requests.withColumn("call", F.floor(F.col(key) / batch))
    return lookup(table, asked, key).withColumn("status", F.when(F.col("found"), "ok").otherwise("not_found"))


def first_hit(requests: DataFrame, hits: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """``requests`` with the hit of the least ``pos`` that has their keys, as a search's first result is taken; null without any."""
    rest = [c for c in hits.columns if c not in keys]
    best = hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), pos).alias("hit"))
    return requests.join(best, keys, "left")


def search(queries: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """(query_id, candidate_id, shared, pos): the names with most words of a query's name, smaller ids first, ``limit`` at most.

    queries: query_id and words; names: candidate_id and words. An inverted index of the words: a name without any of
    the query's words is never looked at. Each query keeps its best by an aggregate, not by sorting all its candidates.
    """
    asked = queries.select("query_id", F.explode("words").alias("word"))
    index = names.select("candidate_id", F.explode("words").alias("word"))
    shared = asked.join(index, "word").groupBy("query_id", "candidate_id").agg(F.count("*").alias("shared"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("shared")).alias("less"), "candidate_id"))), 1, limit)
    ranked = shared.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("pos", "x"))
    return ranked.select("query_id", "x.candidate_id", (-F.col("x.less")).alias("shared"), F.col("pos").cast("long").alias("pos"))


def range_audit(rows: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(field, rows, missing, outside) for each field that must lie in a closed range; one pass over the rows."""
    counts = [x for c, (low, high) in bounds.items() for x in (F.count_if(F.col(c).isNull()).alias(f"m_{c}"), F.count_if(~F.col(c).between(low, high)).alias(f"o_{c}"))]
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col("n").alias("rows"), F.col(f"m_{c}").alias("missing"), F.col(f"o_{c}").alias("outside")) for c in bounds])
    return rows.agg(F.count("*").alias("n"), *counts).select(F.inline(each))


def safe_count(rows) -> int:
    """Rows of what ``rows()`` gives, or 0 if that fails, as a status page counts."""
    try:
        return rows().count()
    except Exception:  # noqa: BLE001  a page shows 0 for a table that is not there
        return 0


# ---- JSON


def merge_patch(old: Column, patch: Column) -> Column:
    """JSON object ``old`` with the fields of ``patch`` in place of its own; a null field of the patch takes one away. Values come out as text."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    fresh = read(patch)
    kept = F.map_filter(read(old), lambda k, _: ~F.map_contains_key(fresh, k))
    return F.to_json(F.map_concat(kept, F.map_filter(fresh, lambda _, v: v.isNotNull())))


#: What of a service's answer about a track is kept.
PAYLOAD = "external_ids struct<isrc:string>, album struct<name:string,release_date:string>, artists array<struct<name:string>>, duration_ms long, popularity int"


def payload(answer: Column) -> Column:
    """Struct of isrc, album, release_year, artists, duration_ms and popularity of an answer's JSON."""
    from tidemark.functions.text import leading_year

    x = F.from_json(answer, PAYLOAD)
    return F.struct(x["external_ids"]["isrc"].alias("isrc"), x["album"]["name"].alias("album"), leading_year(x["album"]["release_date"]).alias("release_year"), x["artists"]["name"].alias("artists"), x["duration_ms"].alias("duration_ms"), x["popularity"].alias("popularity"))


def zip_answers(asked: Column, answers: Column) -> Column:
    """Array of (asked, answer): answers come in the order in which was asked, with a null for each that is not known."""
    return F.zip_with(asked, answers, lambda a, b: F.struct(a.alias("asked"), b.alias("answer")))


# ---- labels


def top_labels(scores: Column, n: int = 10, least: float = 0.05) -> Column:
    """Array of (p, label): places of the n greatest scores above ``least``, the smaller place first of equals."""
    pairs = F.transform(scores, lambda p, i: F.struct((-p).alias("less"), i.alias("label")))
    best = F.slice(F.sort_array(F.filter(pairs, lambda x: -x["less"] > least)), 1, n)
    return F.transform(best, lambda x: F.struct((-x["less"]).alias("p"), x["label"].alias("label")))


def remap_labels(scores: DataFrame, names: DataFrame) -> DataFrame:
    """(id, label, score): scores (id, raw, score) under the names (raw, label) that raw labels go by, the greatest of each."""
    return scores.join(names, "raw").groupBy("id", "label").agg(F.max("score").alias("score"))


def merged_bounds(*arrays: Column) -> Column:
    """All bounds of several arrays, each once, in order."""
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def key_or(deep: Column, fallback: Column) -> Column:
    """A model's key where there is one, else the one by profile."""
    return F.coalesce(deep, fallback)
