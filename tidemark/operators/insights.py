"""Findings worth telling, as typed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.numbers import number
from tidemark.operators.charts import correlations


def long_values(df: DataFrame, columns: Sequence[str], *carry) -> DataFrame:
    """(dimension, label, carried): the columns stacked as text, nulls left out."""
    pairs = [
        F.struct(F.lit(c).alias("dimension"), F.col(f"`{c}`").cast("string").alias("label"))
        for c in columns
    ]
    stacked = df.select(*carry, F.explode(F.array(*pairs)).alias("_p"))
    kept = [c for c in stacked.columns if c != "_p"]
    return stacked.select("_p.dimension", "_p.label", *kept).where("label is not null")


def insight_extremes(
    df: DataFrame, dimensions: Sequence[str], revenue: str | None = None
) -> DataFrame:
    """(dimension, insight, label, value, share_pct): best and worst value of each dimension.

    With a revenue column, the highest and, among more than two values, the lowest sum. Without
    one, the most frequent value and its share of all rows.
    """
    if revenue is None:
        counts = long_values(df, dimensions).groupBy("dimension", "label").agg(
            F.count(F.lit(1)).cast("double").alias("value")
        )
        rows = df.agg(F.count(F.lit(1)).alias("_n"))
        best = counts.groupBy("dimension").agg(
            F.min(F.struct((-F.col("value")).alias("k"), "label", "value")).alias("b")
        )
        share = F.round(F.col("b.value") / F.greatest(F.col("_n"), F.lit(1)) * 100, 1)
        return best.crossJoin(F.broadcast(rows)).select(
            "dimension", F.lit("top").alias("insight"), "b.label", "b.value",
            share.alias("share_pct"),
        )
    sums = (
        long_values(df, dimensions, number(df, revenue).alias("_money"))
        .groupBy("dimension", "label")
        .agg(F.round(F.coalesce(F.sum("_money"), F.lit(0.0)), 2).alias("value"))
    )
    # Least and greatest structs find both ends in one pass, with no ordering of the labels.
    ends = sums.groupBy("dimension").agg(
        F.min(F.struct((-F.col("value")).alias("k"), "label", "value")).alias("hi"),
        F.max(F.struct((-F.col("value")).alias("k"), "label", "value")).alias("lo"),
        F.count(F.lit(1)).alias("groups"),
        F.sum("value").alias("total"),
    )
    both = F.array(
        F.struct(F.lit("highest").alias("insight"), F.col("hi.label"), F.col("hi.value")),
        F.struct(F.lit("lowest").alias("insight"), F.col("lo.label"), F.col("lo.value")),
    )
    found = ends.select("dimension", "groups", "total", F.inline(both))
    share = F.when(F.col("total") != 0, F.round(F.try_divide(F.col("value"), F.col("total")) * 100, 1))
    return found.where("insight = 'highest' or groups > 2").select(
        "dimension", "insight", "label", "value",
        F.coalesce(share, F.lit(0.0)).alias("share_pct"),
    )


def insight_growth(series: DataFrame) -> DataFrame:
    """(insight, from_period, to_period, result): coverage, last change, macro trend.

    ``coverage`` counts the periods. ``last_change`` needs a positive previous period.
    ``macro_trend`` compares the mean of the later half with the earlier one, from four periods
    on and from 10 % either way. A series holds few periods, so one window orders it.
    """
    line = Window.orderBy("period")
    placed = series.select(
        "period", "value", F.row_number().over(line).alias("at"), F.lag("value").over(line).alias("prev"),
        F.lag("period").over(line).alias("prev_period"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"),
    )
    early = F.col("at") <= F.floor(F.col("n") / 2)
    last = F.col("at") == F.col("n")
    facts = placed.agg(
        F.min("period").alias("start"),
        F.max("period").alias("end"),
        F.max("n").alias("n"),
        F.max(F.when(last, F.col("value"))).alias("now"),
        F.max(F.when(last, F.col("prev"))).alias("prev"),
        F.max(F.when(last, F.col("prev_period"))).alias("prev_period"),
        F.avg(F.when(early, F.col("value"))).alias("first_half"),
        F.avg(F.when(~early, F.col("value"))).alias("second_half"),
    )
    change = F.when(F.col("prev") > 0, (F.try_divide(F.col("now"), F.col("prev")) - 1) * 100)
    trend = F.when(
        (F.col("n") >= 4) & (F.col("first_half") > 0),
        (F.try_divide(F.col("second_half"), F.col("first_half")) - 1) * 100,
    )
    found = [
        ("coverage", "start", F.col("n").cast("double")),
        ("last_change", "prev_period", F.round(change, 1)),
        ("macro_trend", "start", F.when(F.abs(trend) >= 10, F.round(trend, 1))),
    ]
    records = F.array(
        *[
            F.struct(
                F.lit(name).alias("insight"),
                F.col(since).alias("from_period"),
                F.col("end").alias("to_period"),
                result.alias("result"),
            )
            for name, since, result in found
        ]
    )
    return facts.where("n > 0").select(F.inline(records)).where("result is not null")


def insight_strong_corr(df: DataFrame, columns: list[str], least: float = 0.7) -> DataFrame:
    """Column pairs with |r| at or above ``least``, and the sign of the relationship."""
    strong = correlations(df, columns).where(F.abs("pearson") >= least)
    sign = F.when(F.col("pearson") > 0, "positive").otherwise("negative")
    return strong.withColumn("direction", sign)


def insight_concentration(
    df: DataFrame, dimensions: Sequence[str], least: float = 80.0
) -> DataFrame:
    """Dimensions whose most frequent value holds at least ``least`` percent of all rows."""
    top = insight_extremes(df, dimensions)
    return top.where(F.col("share_pct") >= least).select("dimension", "label", "value", "share_pct")


def insight_missing(missing: DataFrame, least: float = 2.0) -> DataFrame:
    """One row when at least ``least`` percent of all cells are missing.

    Takes a frame of (column, missing_count, rows).
    """
    cells = F.sum("missing_count")
    share = F.round(F.try_divide(cells, F.sum("rows")) * 100, 2)
    return missing.agg(
        share.alias("missing_pct"),
        F.count(F.when(F.col("missing_count") > 0, 1)).alias("columns"),
    ).where(F.col("missing_pct") >= least)


def insight_outliers(stats: DataFrame, least: float = 3.0) -> DataFrame:
    """Columns where at least ``least`` percent of the values are outliers."""
    share = F.round(F.col("outlier_count") / F.greatest(F.col("count"), F.lit(1)) * 100, 1)
    return stats.select("column", "outlier_count", share.alias("outlier_pct")).where(
        F.col("outlier_pct") >= least
    )
