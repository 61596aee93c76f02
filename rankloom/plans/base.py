"""Registration of a query with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from rankloom.sources.relations import Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register f(tables) -> DataFrame under its name; sql is the same result in DuckDB, None for a rows-only check."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql.replace(", 6) AS", ", 6) + 0 AS")  # no negative zero on either side
        return f

    return register


def r6(column, name: str | None = None):
    """Rounded to 6 places, the noise floor of sums in another order."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, 6) + F.lit(0.0)).alias(name or column)
