"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v, of one type that has an order) but the roots: the smallest node reachable.

    Large-star and small-star steps alternate until nothing changes, however many that takes; their number grows
    with the logarithm of the longest chain. Each is a minimum per node (combined before the shuffle) joined back to
    the links, so that a star with very many leaves is never one row.
    """
    links, before = cut(edges.selectExpr("greatest(u, v) u", "least(u, v) v").filter("u <> v").distinct()), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = links.union(links.selectExpr("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.filter("v > u").join(low, "u").selectExpr("v u", "m v").filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        links = cut(large.join(low, "u").selectExpr("stack(2, v, m, u, m) as (u, v)").filter("u <> v").distinct())
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
