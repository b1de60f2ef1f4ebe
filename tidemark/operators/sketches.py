"""Column profiles as mergeable sketches: a grown table is profiled from its new rows alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numbers import number

#: Size of the distinct sketches (2**12 cells: a relative error of about 1.6 %), and of the quantile sketches (rank error about 0.7 %).
_DISTINCT = 12
_QUANTILES = 400


def column_sketches(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: (column, rows, filled, numbers, total, least, most, distinct, quantiles).

    ``distinct`` and ``quantiles`` are sketches of a fixed size, of the column's values as text and
    of its numbers. Tasks sketch what they read, so only a row per column and task is shuffled.
    Rows of several tables, or of new files of a table, are put together by :func:`merged`.
    """
    used = columns or df.columns
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v"), number(df, c).alias("n")) for c in used]
    return df.select(F.inline(F.array(*cells))).groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("v").alias("filled"),
        F.count("n").alias("numbers"),
        F.sum("n").alias("total"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.hll_sketch_agg("v", F.lit(_DISTINCT)).alias("distinct"),
        F.kll_sketch_agg_double("n", F.lit(_QUANTILES)).alias("quantiles"),
    )


def merged(*sketches: DataFrame) -> DataFrame:
    """The sketches of all rows behind ``sketches``, column by column; a column may be missing in some."""
    both = reduce(DataFrame.unionByName, sketches)
    return both.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in ("rows", "filled", "numbers", "total")],
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def sketch_report(sketches: DataFrame) -> DataFrame:
    """(column, rows, missing, distinct, mean, min, q1, median, q3, max) as the sketches estimate them.

    Counts, mean, min and max are exact. Distinct values are off by a few hundredths, quartiles by a
    hundredth of the ranks. Columns without numbers have null statistics.
    """
    some = F.col("numbers") > 0

    def quantile(rank: float):
        return F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(rank)))

    return sketches.select(
        "column",
        "rows",
        (F.col("rows") - F.col("filled")).alias("missing"),
        F.when(F.col("filled") > 0, F.hll_sketch_estimate("distinct")).otherwise(F.lit(0)).alias("distinct"),
        F.round(F.try_divide("total", "numbers"), 4).alias("mean"),
        F.col("least").alias("min"),
        quantile(0.25).alias("q1"),
        quantile(0.5).alias("median"),
        quantile(0.75).alias("q3"),
        F.col("most").alias("max"),
    )
