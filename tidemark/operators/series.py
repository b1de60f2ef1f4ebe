"""Period series from dated rows. The grain follows the span of the dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.dates import (
    FORECAST_GRAINS,
    SERIES_GRAINS,
    choose_grain,
    period_start,
    whole_days,
)
from tidemark.functions.numbers import number


def time_series(
    df: DataFrame,
    date: str,
    metric: str | None = None,
    keys: Sequence[str] = (),
    ladder=SERIES_GRAINS,
    grain: str | None = None,
) -> DataFrame:
    """(keys, grain, period, value): metric sums, or row counts, per period that has rows.

    Rows are folded into per-day sums first, whose number the calendar bounds, and the days into
    periods. The span comes from a scan of the date column alone, as one broadcast row.
    """
    when = F.col(f"`{date}`")
    value = F.count(F.lit(1)).cast("double") if metric is None else F.sum(number(df, metric))
    daily = (
        df.where(when.isNotNull())
        .groupBy(*keys, F.to_date(when).alias("_day"))
        .agg(value.alias("_value"))
    )
    if grain is None:
        span = df.agg(whole_days(F.min(when), F.max(when)).alias("_span"))
        chosen = span.select(choose_grain(F.col("_span"), ladder).alias("grain"))
        daily = daily.crossJoin(F.broadcast(chosen))
    else:
        daily = daily.withColumn("grain", F.lit(grain))
    period = period_start(F.col("_day"), grain or F.col("grain"))
    return daily.groupBy(*keys, "grain", period.alias("period")).agg(
        F.round(F.coalesce(F.sum("_value"), F.lit(0.0)), 2).alias("value")
    )


def forecast_series(
    df: DataFrame, date: str, metric: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """The series that forecasts start from: coarser grains, no yearly one."""
    return time_series(df, date, metric, keys, FORECAST_GRAINS)


def last_two(series: DataFrame) -> DataFrame:
    """One row with the last and the previous period of a single series, none if there is one."""
    pair = F.struct("period", "value")
    latest = series.orderBy(F.desc("period")).limit(2)
    both = latest.agg(F.max(pair).alias("last"), F.min(pair).alias("prev"), F.count("*").alias("n"))
    return both.where("n = 2").select(
        F.col("last.period").alias("period"),
        F.col("last.value").alias("value"),
        F.col("prev.period").alias("prev_period"),
        F.col("prev.value").alias("prev_value"),
    )
