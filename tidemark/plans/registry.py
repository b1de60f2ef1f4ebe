"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables`; without SQL only its rows are checked."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rnd(expression: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal text, which is how Spark rounds a double."""
    return (
        f"CAST(ROUND(CAST(CAST(CAST(({expression}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), "
        f"{digits}) AS DOUBLE)"
    )


def load_all() -> None:
    """Import every catalog module, which registers its queries."""
    from tidemark.plans import (  # noqa: F401
        catalog_business,
        catalog_charts,
        catalog_data,
        catalog_dates,
        catalog_growth,
        catalog_quality,
    )
