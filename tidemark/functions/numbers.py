"""Numeric views of columns, and the measures that charts aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def parse_number(text: Column) -> Column:
    """Plain decimal text to double, null when it is not a number.

    The pattern keeps out what the cast alone accepts: type suffixes (``10d``) and ``NaN``.
    """
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """The column as a double; NaN and unparseable text become null."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column.cast("double"))
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, T.StringType):
        return parse_number(column)
    return F.lit(None).cast("double")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def percent(part: Column, whole: Column, digits: int, empty: float = 0.0) -> Column:
    """part / whole as a rounded percentage, ``empty`` when the whole is not positive."""
    share = F.round(part / whole * 100, digits)
    return F.when(whole > 0, share).otherwise(F.lit(empty))


def measure(df: DataFrame, metric: str | None, agg: str) -> Column:
    """One aggregate expression for a chart measure.

    ``median`` is not here: an exact one needs :mod:`tidemark.operators.quantiles`.
    An unknown name means ``sum``.
    """
    if metric is None:
        return F.count(F.lit(1)).cast("double")
    column = F.col(f"`{metric}`")
    if agg == "count":
        return F.count(column).cast("double")
    if agg == "distinct_count":
        return F.count_distinct(column).cast("double")
    value = number(df, metric)
    reduce = {"avg": F.avg, "min": F.min, "max": F.max}.get(agg, F.sum)
    return F.coalesce(reduce(value), F.lit(0.0))
