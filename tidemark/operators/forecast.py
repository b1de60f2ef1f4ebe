"""Forecasts of many series at once: each series is one row, each model a column expression.

A series has at most a few thousand periods (the grain coarsens with the span), so its values fit
one array. Fits, holdout errors and the forecast are then per-row expressions: one grouping, no
joins, no windows, and series spread evenly over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.dates import period_after
from tidemark.functions.fixed_values import HOLT, OLS, WMA

ALPHA, BETA = 0.4, 0.2


def as_arrays(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, grain, y, n, train, last_period): the values of each series in period order.

    Series with fewer than three periods are left out. The last fifth is held out.
    """
    points = F.array_sort(F.collect_list(F.struct("period", "value")))
    rows = series.groupBy(*keys, "grain").agg(points.alias("points"))
    sized = rows.select(
        *keys,
        "grain",
        F.col("points.value").alias("y"),
        F.size("points").alias("n"),
        F.element_at("points", -1)["period"].alias("last_period"),
    ).where("n >= 3")
    held = F.when(F.col("n") >= 5, F.greatest(F.lit(2), F.floor(F.col("n") * 4 / 5)))
    return sized.withColumn("train", held.otherwise(F.col("n") - 1).cast("int"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def _mean(values: Column) -> Column:
    return _sum(values) / F.size(values)


def holt(y: Column, m: Column) -> Column:
    """Level and trend after the first ``m`` values, starting from the first step."""
    start = F.struct(
        F.element_at(y, 1).alias("level"), (F.element_at(y, 2) - F.element_at(y, 1)).alias("trend")
    )

    def step(state: Column, value: Column) -> Column:
        level = ALPHA * value + (1 - ALPHA) * (state["level"] + state["trend"])
        trend = BETA * (level - state["level"]) + (1 - BETA) * state["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"))

    return F.aggregate(F.slice(y, F.lit(2), m - 1), start, step)


def ols(y: Column, m: Column) -> Column:
    """Slope and intercept over the positions 0..m-1, and the spread of the positions."""
    values = F.slice(y, F.lit(1), m)
    middle = (m - 1) / 2.0
    spread = m * (m * m - 1) / 12.0
    products = F.transform(values, lambda v, i: (i - middle) * v)
    slope = _sum(products) / spread
    return F.struct(
        slope.alias("slope"),
        (_sum(values) / m - slope * middle).alias("intercept"),
        spread.alias("spread"),
        middle.alias("middle"),
    )


def wma(y: Column, m: Column) -> Column:
    """Weighted mean of the last three of the first ``m`` values, the latest weighing most."""
    used = F.least(F.lit(3), m)
    tail = F.slice(y, m - used + 1, used)
    return _sum(F.transform(tail, lambda v, i: v * (i + 1))) / (used * (used + 1) / 2.0)


def fit_holt(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows = as_arrays(series, keys).withColumn("fit", holt(F.col("y"), F.col("n")))
    return rows.select(*keys, "n", "fit.level", "fit.trend")


def fit_ols(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows = as_arrays(series, keys).withColumn("fit", ols(F.col("y"), F.col("n")))
    rows = rows.withColumn("residual_std", residual_std(F.col("y"), F.col("fit")))
    return rows.select(*keys, "n", "fit.slope", "fit.intercept", "residual_std")


def fit_wma(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows = as_arrays(series, keys)
    return rows.select(*keys, "n", wma(F.col("y"), F.col("n")).alias("flat"))


def residual_std(y: Column, fit: Column) -> Column:
    """Population standard deviation of the residuals of the line."""
    gaps = F.transform(y, lambda v, i: v - (fit["intercept"] + fit["slope"] * i))
    mean = _mean(gaps)
    return F.sqrt(_mean(F.transform(gaps, lambda g: (g - mean) * (g - mean))))


def _errors(actual: Column, predicted: Column) -> list[Column]:
    pairs = F.zip_with(actual, predicted, lambda a, p: F.struct(a.alias("a"), p.alias("p")))
    gaps = F.transform(pairs, lambda x: x["a"] - x["p"])
    mae = _mean(F.transform(gaps, F.abs))
    rmse = F.sqrt(_mean(F.transform(gaps, lambda g: g * g)))
    usable = F.filter(pairs, lambda x: F.abs(x["a"]) > 1e-4)
    ratios = F.transform(usable, lambda x: F.abs((x["a"] - x["p"]) / x["a"]))
    mape = F.when(F.size(ratios) > 0, F.try_divide(_sum(ratios), F.size(ratios)) * 100)
    return [
        F.round(mae, 2).alias("mae"),
        F.round(rmse, 2).alias("rmse"),
        F.round(F.coalesce(mape, F.lit(0.0)), 2).alias("mape"),
    ]


def backtest(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, model, mae, rmse, mape, rank, train, holdout): each model on the held-out periods.

    Rank 1 has the lowest MAPE, then RMSE; a tie goes to Holt, then the line, then the mean.
    """
    rows = as_arrays(series, keys)
    y, m = F.col("y"), F.col("train")
    held = F.col("n") - m
    fitted = rows.select(
        *keys, "n", "train", "y",
        holt(y, m).alias("h"), ols(y, m).alias("o"), wma(y, m).alias("w"),
        F.slice(y, m + 1, held).alias("actual"),
        F.sequence(F.lit(1), held).alias("steps"),
    )
    ahead = {
        HOLT: F.transform("steps", lambda s: F.col("h.level") + s * F.col("h.trend")),
        OLS: F.transform("steps", lambda s: F.col("o.intercept") + F.col("o.slope") * (m + s - 1)),
        WMA: F.transform("steps", lambda s: F.col("w") + F.lit(0.0) * s),
    }
    results = F.array(
        *[
            F.struct(F.lit(i).alias("tie"), F.lit(name).alias("model"), path.alias("path"))
            for i, (name, path) in enumerate(ahead.items())
        ]
    )
    long = fitted.select(*keys, "train", held.alias("holdout"), "actual", F.inline(results))
    scored = long.select(
        *keys, "model", "tie", "train", "holdout", *_errors(F.col("actual"), F.col("path"))
    )
    best_first = Window.partitionBy(*keys).orderBy("mape", "rmse", "tie")  # three rows per series
    return scored.withColumn("rank", F.row_number().over(best_first)).drop("tie")


def champion(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The best model of each series by its holdout errors."""
    return backtest(series, keys).where("rank = 1").drop("rank")


def forecast(series: DataFrame, keys: Sequence[str] = (), horizon: int = 4) -> DataFrame:
    """(keys, model, step, period, value, lower, upper): the champion refitted on all periods.

    Values and lower bounds stop at 0. Bounds are 1.96 residual deviations wide, growing with the
    root of the step, or for the line with the distance from the middle of the history.
    """
    rows = as_arrays(series, keys)
    y, n = F.col("y"), F.col("n")
    fitted = rows.select(
        *keys, "grain", "n", "last_period", "y",
        holt(y, n).alias("h"), ols(y, n).alias("o"), wma(y, n).alias("w"),
    ).withColumn("sigma", residual_std(F.col("y"), F.col("o")))
    best = champion(series, keys).select(
        *[F.col(f"`{k}`").alias(f"_b_{k}") for k in keys], "model"
    )
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"`{key}`").eqNullSafe(F.col(f"_b_{key}"))
    joined = fitted.join(best, same) if keys else fitted.crossJoin(F.broadcast(best))
    steps = joined.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    at = F.col("n") + F.col("step") - 1
    raw = (
        F.when(F.col("model") == HOLT, F.col("h.level") + F.col("step") * F.col("h.trend"))
        .when(F.col("model") == WMA, F.col("w"))
        .otherwise(F.col("o.intercept") + F.col("o.slope") * at)
    )
    gap = at - F.col("o.middle")
    line_width = F.sqrt(1 + 1.0 / F.col("n") + gap * gap / F.greatest(F.col("o.spread"), F.lit(1e-6)))
    width = F.when(F.col("model") == OLS, line_width).otherwise(F.sqrt(F.col("step").cast("double")))
    value = F.greatest(F.lit(0.0), raw)
    margin = 1.96 * F.col("sigma") * width
    return steps.select(
        *keys,
        "model",
        "step",
        period_after(F.col("last_period"), F.col("step"), F.col("grain")).alias("period"),
        F.round(value, 2).alias("value"),
        F.round(F.greatest(F.lit(0.0), value - margin), 2).alias("lower"),
        F.round(value + margin, 2).alias("upper"),
    )
