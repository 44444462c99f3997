"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: Added before rounding, so that exact halves are not decided by the last bit.
APART = 3.3e-10


def query(sql: str | None = None, rounded: str = "") -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame by its name, with SQL that DuckDB runs on the same tables.

    ``rounded`` names columns that both sides round to 8 digits, where sums of floats depend on their order.
    """

    def add(fn: Callable) -> Callable:
        def run(spark, sf):
            return fn(spark, sf).withColumns({c: F.round(F.col(c) + APART, 8) + 0.0 for c in rounded.split()})

        QUERIES[fn.__name__] = wraps(fn)(run) if rounded else fn
        if sql:
            ORACLES[fn.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c} + {APART}, 8) + 0.0 AS {c}' for c in rounded.split())}) FROM ({sql})" if rounded else sql
        return fn

    return add


from tidemark.plans import catalog, files, listening, lookups, series, state, streams, vectors  # noqa: E402,F401  they register their queries
