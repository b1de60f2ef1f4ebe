"""Anomalies in series and columns, their ranking, and alert rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.numbers import number
from tidemark.operators.quantiles import grouped_quantiles

# Band widths by sensitivity.
SIGMA_WIDTH = {"low": 2.5, "medium": 2.0, "high": 1.5}
FENCE_WIDTH = {"low": 2.5, "medium": 2.0, "high": 1.5}
SEVERITY_ORDER = ["critical", "high", "medium", "low"]


def rolling_anomalies(
    series: DataFrame, keys: Sequence[str] = (), sensitivity: str = "medium"
) -> DataFrame:
    """Periods outside the band of the four before them: one row per anomaly.

    The band is mean ± k population deviations, its lower edge not below 0. The first three periods
    are never judged, nor is a series with fewer than four.
    """
    line = Window.partitionBy(*keys).orderBy("period")
    before = line.rowsBetween(-4, -1)
    around = line.rowsBetween(-2, 2)
    # A decimal sum is exact, so a mean halfway between two cents rounds the same everywhere.
    total = F.sum(F.col("value").cast("decimal(30,6)")).over(before).cast("double")
    seen = series.select(
        *keys,
        "period",
        "value",
        F.row_number().over(line).alias("_at"),
        F.try_divide(total, F.count("value").over(before)).alias("mean"),
        F.stddev_pop("value").over(before).alias("std"),
        F.collect_list("value").over(around).alias("neighbours"),
    ).where("_at > 3")
    k = SIGMA_WIDTH.get(sensitivity, 2.0)
    gap = F.col("value") - F.col("mean")
    judged = seen.select(
        "*",
        F.greatest(F.lit(0.0), F.col("mean") - k * F.col("std")).alias("low"),
        (F.col("mean") + k * F.col("std")).alias("high"),
        (gap / F.greatest(F.col("mean"), F.lit(1e-6)) * 100).alias("deviation"),
        F.abs(gap / F.greatest(F.col("std"), F.lit(1e-6))).alias("z"),
    ).where("value < low or value > high")
    off = F.abs("deviation")
    severity = (
        F.when((off >= 50.0) | (F.col("z") >= 3.5), "critical")
        .when((off >= 30.0) | (F.col("z") >= 2.5), "high")
        .when((off >= 15.0) | (F.col("z") >= 1.8), "medium")
        .otherwise("low")
    )
    return judged.select(
        *keys,
        "period",
        F.round("value", 2).alias("observed"),
        F.round("low", 2).alias("expected_low"),
        F.round("high", 2).alias("expected_high"),
        F.round("deviation", 1).alias("deviation_pct"),
        F.round("z", 2).alias("z_score"),
        severity.alias("severity"),
        F.when(F.col("value") > F.col("mean"), "spike").otherwise("drop").alias("direction"),
        F.round("mean", 2).alias("baseline_mean"),
        F.round("std", 2).alias("baseline_std"),
        "neighbours",
    )


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, v): the columns stacked, null and NaN left out."""
    pairs = [F.struct(F.lit(c).alias("column"), number(df, c).alias("v")) for c in columns]
    return df.select(F.inline(F.array(*pairs))).where(F.col("v").isNotNull())


def iqr_anomalies(
    df: DataFrame, columns: Sequence[str], sensitivity: str = "medium"
) -> DataFrame:
    """Columns with values beyond their quartile fences: counts, extreme value, severity.

    Judges the columns that have eight values, four distinct ones and a positive
    IQR. Four distinct values exist exactly when the second smallest is below the second largest,
    which costs no distinct count.
    """
    rows = long_numbers(df, columns)
    k = FENCE_WIDTH.get(sensitivity, 2.0)
    boxes = grouped_quantiles(
        rows,
        ["column"],
        F.col("v"),
        {"q25": 0.25, "q75": 0.75},
        few_groups=True,
    ).where("n >= 8 and q75 > q25")
    iqr = F.col("q75") - F.col("q25")
    fenced = boxes.select(
        F.col("column").alias("_c"), "n", "q25", "q75", "least", "most",
        (F.col("q25") - k * iqr).alias("low"),
        (F.col("q75") + k * iqr).alias("high"),
    )
    v = F.col("v")
    # One fence row per judged column, so no more rows than columns are broadcast.
    found = (
        rows.join(F.broadcast(fenced), F.col("column") == F.col("_c"))
        .groupBy("column", "q25", "q75", "low", "high")
        .agg(
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.count(F.when(v > F.col("high"), 1)).alias("above"),
            F.count(F.when(v < F.col("low"), 1)).alias("below"),
            F.max(F.when(v > F.col("high"), v)).alias("_top"),
            F.min(F.when(v < F.col("low"), v)).alias("_bottom"),
            F.min(F.when(v > F.col("least"), v)).alias("_second"),
            F.max(F.when(v < F.col("most"), v)).alias("_before_last"),
        )
        .where("above + below > 0 and _second < _before_last")
    )
    extreme = F.coalesce("_top", "_bottom")
    score = F.round(F.abs(extreme - F.col("mean")) / F.greatest(F.col("std"), F.lit(1e-6)), 2)
    return found.withColumn("deviation_score", score).select(
        "column",
        F.round(extreme, 2).alias("observed"),
        F.round("low", 2).alias("expected_low"),
        F.round("high", 2).alias("expected_high"),
        "above",
        "below",
        "deviation_score",
        F.when(F.col("deviation_score") >= 4.0, "critical")
        .when(F.col("deviation_score") >= 2.5, "high")
        .otherwise("medium")
        .alias("severity"),
        F.round("q25", 2).alias("q25"),
        F.round("q75", 2).alias("q75"),
        F.round("mean", 2).alias("mean"),
        F.round("std", 2).alias("std"),
    )


def rank_anomalies(anomalies: DataFrame, *then: str) -> DataFrame:
    """Most severe first, then by the given columns; adds the severity's place."""
    place = F
    for i, name in enumerate(SEVERITY_ORDER):
        place = place.when(F.col("severity") == name, i)
    placed = anomalies.withColumn("severity_rank", place.otherwise(2))
    return placed.orderBy("severity_rank", *then)


def anomaly_posture(anomalies: DataFrame) -> DataFrame:
    """One row: severe and mild anomaly counts, and the risk level they add up to."""
    severe = F.count(F.when(F.col("severity").isin("critical", "high"), 1))
    mild = F.count(F.when(F.col("severity").isin("medium", "low"), 1))
    counts = anomalies.agg(severe.alias("severe"), mild.alias("mild"))
    level = F.when(F.col("severe") > 0, "Elevated").when(F.col("mild") > 0, "Moderate")
    return counts.withColumn("risk_level", level.otherwise("Low"))


def evaluate_rules(kpis: DataFrame, rules: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Fired rules with the KPI that fired them: (rule_id, name, severity, label, value).

    A rule ``(rule_id, name, alert_type, metric, condition, threshold, severity)`` of type
    ``anomaly`` fires when there is any anomaly, and its value is their number. ``gt`` and ``lt``
    compare the KPIs whose label holds the metric name, and report the first one that passes;
    ``pct_change`` compares the size of percentage KPIs. The last condition, and ``lt`` on any KPI
    rather than the quality score alone, go beyond the polled rules this stands for.

    KPI rows are a few dozen by construction, so they are the broadcast side of the theta join.
    """
    label = F.lower("label")
    named = F.replace(label, F.lit(" "), F.lit("_")).contains(F.lower("metric")) | label.contains(
        F.lower("metric")
    )
    above = (F.col("condition") == "gt") & (F.col("value") > F.col("threshold"))
    below = (F.col("condition") == "lt") & (F.col("value") < F.col("threshold"))
    moved = (
        (F.col("condition") == "pct_change")
        & (F.col("format") == "percent")
        & (F.abs("value") > F.col("threshold"))
    )
    metric_rules = rules.where("alert_type != 'anomaly' and threshold is not null")
    hits = metric_rules.join(F.broadcast(kpis), named & (above | below | moved))
    first = hits.groupBy("rule_id", "name", "severity").agg(
        F.min(F.struct("position", "label", "value")).alias("hit")
    )
    fired = first.select("rule_id", "name", "severity", "hit.label", "hit.value")
    total = anomalies.agg(F.count(F.lit(1)).cast("double").alias("value")).where("value > 0")
    unusual = (
        rules.where("alert_type = 'anomaly'")
        .crossJoin(F.broadcast(total))
        .select("rule_id", "name", "severity", F.lit("Anomalies").alias("label"), "value")
    )
    return fired.unionByName(unusual)
