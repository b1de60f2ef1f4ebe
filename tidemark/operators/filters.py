"""Slicers, cross-filters, text search and top-N membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numbers import is_numeric, number


def typed_literal(df: DataFrame, column: str, value) -> Column:
    """The value in the column's own type, null when it cannot be read as one.

    Comparing in the column's type, not as text, lets the predicate reach the file scan.
    """
    return F.lit(str(value)).try_cast(df.schema[column].dataType)


def compares(df: DataFrame, column: str, operator: str, limit: float) -> Column:
    """``gt gte lt lte`` against a number; NaN, like null, passes none of them.

    A numeric column is compared as it is, so the bound reaches the file scan. Spark ranks NaN above
    every number, so only the upward comparisons must rule it out.
    """
    amount = F.col(f"`{column}`") if is_numeric(df, column) else number(df, column)
    test = {
        "gt": amount > limit,
        "gte": amount >= limit,
        "lt": amount < limit,
        "lte": amount <= limit,
    }[operator]
    return test & ~F.isnan(amount) if operator in ("gt", "gte") else test


def slice_filter(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Keep rows that meet every ``{column, operator, value}``.

    Operators: ``eq``, ``in``, ``gte``, ``lte``, ``date_range`` (inclusive; either end may be
    None). A filter on an unknown column, or without a value, is ignored.
    """
    for item in filters:
        column, value = item.get("column"), item.get("value")
        if column not in df.columns or value is None:
            continue
        kept = _predicate(df, column, item.get("operator", "eq"), value)
        if kept is not None:
            df = df.where(kept)
    return df


def _predicate(df: DataFrame, column: str, operator: str, value) -> Column | None:
    field = F.col(f"`{column}`")
    if operator == "eq":
        return field == typed_literal(df, column, value)
    if operator == "in" and isinstance(value, (list, tuple, set)):
        return field.isin([typed_literal(df, column, v) for v in value])
    if operator in ("gte", "lte"):
        return compares(df, column, operator, float(value))
    if operator == "date_range" and len(value) == 2:
        start, end = value
        ends = []
        if start is not None:
            ends.append(field >= typed_literal(df, column, start))
        if end is not None:
            ends.append(field <= typed_literal(df, column, end))
        return reduce(Column.__and__, ends) if ends else None
    return None


def cross_filter(df: DataFrame, column: str, value) -> DataFrame:
    """The one extra equality that a clicked chart mark adds."""
    return slice_filter(df, [{"column": column, "operator": "eq", "value": value}])


def text_search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows where any of the columns contains the text, ignoring case, with no pattern syntax."""
    if not text:
        return df
    needle = F.lit(text.lower())
    hits = [
        F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(needle), F.lit(False))
        for c in columns
    ]
    return df.where(reduce(Column.__or__, hits, F.lit(False)))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties in value order: (column, rows)."""
    counts = df.groupBy(F.col(f"`{column}`").alias(column)).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), F.asc(column)).limit(k)


def keep_top(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows whose value is among the k most frequent ones. The broadcast side has k rows."""
    best = top_values(df, column, k).select(F.col(f"`{column}`").alias("_top"))
    return df.join(F.broadcast(best), df[column].eqNullSafe(F.col("_top")), "left_semi")
