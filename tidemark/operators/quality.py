"""Quality scores, missing cells, shape of distributions, drift, and what to do about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.fixed_values import NUMBER_KINDS
from tidemark.functions.numbers import numeric_columns, number, text_columns
from tidemark.functions.text import to_number
from tidemark.operators.anomalies import long_numbers
from tidemark.operators.cleaning import cleaning_diff, coerce, duplicate_groups, trim_nulls
from tidemark.operators.quantiles import grouped_quantiles
from tidemark.operators.selection import half_of


def null_counts(df: DataFrame) -> DataFrame:
    """(column, missing_count, rows): one aggregation, one row per column."""
    counts = [F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    records = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"), F.col("rows"))
        for i, c in enumerate(df.columns)
    ]
    return facts.select(F.inline(F.array(*records)))


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_pct, status), most incomplete first."""
    part = F.coalesce(F.try_divide(F.col("missing_count"), F.col("rows")), F.lit(0.0))
    share = F.round(part * 100, 2)
    status = F.when(F.col("missing_pct") >= 30, "critical").when(
        F.col("missing_pct") >= 10, "warning"
    )
    return (
        null_counts(df)
        .withColumn("missing_pct", share)
        .select("column", "missing_count", "missing_pct", status.otherwise("healthy").alias("status"))
        .orderBy(F.desc("missing_pct"), F.asc("column"))
    )


def quality_report(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row: size, missing, invalid and duplicate counts, five components and their mean.

    Missing cells and duplicates are of the cleaned table; invalid values are those that cleaning
    could not read.
    """
    typed = F.col("kind").isin("datetime", "date", *NUMBER_KINDS)
    filled = F.col("rows") - F.col("missing_after")

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    facts = cleaning_diff(raw, kinds).agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("rows"),
        total("missing_after").alias("missing_values"),
        total("invalid").alias("invalid_values"),
        F.coalesce(F.sum(F.when(typed, filled)), F.lit(0)).alias("_typed"),
    )
    facts = facts.withColumn("columns", F.lit(len(kinds)))
    clean = coerce(trim_nulls(raw), kinds)
    extra = duplicate_groups(clean).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows")
    )
    one = facts.crossJoin(F.broadcast(extra))
    rows = F.greatest(F.col("rows"), F.lit(1))
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1))
    none = F.lit(0)
    parts = {
        "completeness": (cells - F.col("missing_values")) / cells,
        "uniqueness": (F.col("rows") - F.col("duplicate_rows")) / rows,
        "validity": F.greatest(none, cells - F.col("invalid_values")) / cells,
        "consistency": F.greatest(
            none, F.col("rows") - F.col("duplicate_rows") - F.col("invalid_values")
        )
        / rows,
        "type_correctness": F.col("_typed")
        / F.greatest(F.col("_typed") + F.col("invalid_values"), F.lit(1)),
    }
    scored = one.select("*", *[F.round(part * 100, 1).alias(name) for name, part in parts.items()])
    mean = reduce(lambda a, b: a + b, [F.col(name) for name in parts]) / len(parts)
    return scored.withColumn("overall_score", F.round(mean, 1)).drop("_typed")


def schema_health(df: DataFrame) -> DataFrame:
    """One row: share of tidy column names, and text columns where only some values are numbers."""
    tidy = sum(c.replace("_", "").isalnum() for c in df.columns)
    text = text_columns(df)
    flags = []
    for c in text:
        value = F.col(f"`{c}`")
        read = F.count(F.when(to_number(value).isNotNull(), 1))
        flags.append(((read > 0) & (read < F.count(value))).cast("int"))
    mixed = reduce(lambda a, b: a + b, flags, F.lit(0))
    return df.agg(mixed.cast("int").alias("mixed_columns"), F.count(F.lit(1)).alias("rows")).select(
        F.lit(len(df.columns)).alias("columns"),
        F.lit(round(100.0 * tidy / len(df.columns), 1)).alias("naming_score"),
        "mixed_columns",
    )


def outlier_skew(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: outliers beyond 1.5 IQR and bias-corrected skewness.

    A column needs six values and a positive IQR.
    """
    rows = long_numbers(df, columns or numeric_columns(df))
    facts = grouped_quantiles(
        rows,
        ["column"],
        F.col("v"),
        {"q1": 0.25, "q3": 0.75},
        few_groups=True,
    ).where("n >= 6 and q3 > q1")
    iqr = F.col("q3") - F.col("q1")
    fenced = facts.select(
        F.col("column").alias("_c"), "n",
        (F.col("q1") - 1.5 * iqr).alias("_low"), (F.col("q3") + 1.5 * iqr).alias("_high"),
    )
    v = F.col("v")
    counted = (
        rows.join(F.broadcast(fenced), F.col("column") == F.col("_c"))
        .groupBy("column", "n")
        .agg(
            F.count(F.when((v < F.col("_low")) | (v > F.col("_high")), 1)).alias("outlier_count"),
            F.skewness(v).alias("_g1"),
        )
    )
    n = F.col("n")
    skew = F.coalesce(F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0))
    return counted.select(
        "column",
        "outlier_count",
        F.round(F.col("outlier_count") / n * 100, 2).alias("outlier_pct"),
        F.round(skew, 2).alias("skewness"),
        (F.abs(skew) > 1.0).alias("is_skewed"),
    )


def drift(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """Earlier half of the rows against the later half, per numeric column.

    (column, baseline_mean, recent_mean, mean_shift_pct, status, variance_ratio). ``order_by``
    says what earlier means and must be unique. Needs twenty rows, and five values in each half.
    The middle row is found by counting, so no row is sorted.
    """
    total, (late,) = half_of(df, order_by)
    cells = [F.struct(F.lit(c).alias("column"), number(df, c).alias("v")) for c in columns]
    stacked = df.where(F.lit(total >= 20)).select((~late).alias("early"), F.inline(F.array(*cells)))
    halves = stacked.groupBy("column").agg(
        *[
            fold(F.when(half, F.col("v"))).alias(f"{name}_{side}")
            for side, half in (("b", F.col("early")), ("r", ~F.col("early")))
            for name, fold in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp))
        ]
    )
    judged = halves.where("n_b >= 5 and n_r >= 5")
    base = F.greatest(F.abs("mean_b"), F.abs("mean_r"), F.lit(1e-4))
    shift = F.round(F.abs(F.col("mean_r") - F.col("mean_b")) / base * 100, 1)
    status = F.when(F.col("mean_shift_pct") >= 25.0, "High Drift").when(
        F.col("mean_shift_pct") >= 10.0, "Moderate Drift"
    )
    return judged.withColumn("mean_shift_pct", shift).select(
        "column",
        F.round("mean_b", 2).alias("baseline_mean"),
        F.round("mean_r", 2).alias("recent_mean"),
        "mean_shift_pct",
        status.otherwise("Stable").alias("status"),
        F.round(F.col("std_r") / F.greatest(F.col("std_b"), F.lit(1e-6)), 2).alias("variance_ratio"),
    )


def quality_scorecard(
    missing: DataFrame, duplicates: DataFrame, health: DataFrame, drifted: DataFrame
) -> DataFrame:
    """One row: five dimensions, their weighted score, and the tier.

    Takes the null counts, the duplicate row, the schema-health row and the drift rows.
    """
    part = F.coalesce(F.try_divide(F.sum("missing_count"), F.sum("rows")), F.lit(0.0))
    nulls = missing.agg(F.round(part * 100, 2).alias("null_pct"))
    high = drifted.agg(F.count(F.when(F.col("status") == "High Drift", 1)).alias("high_drift"))
    one = (
        nulls.crossJoin(F.broadcast(duplicates.select("duplicate_pct", "duplicate_rows")))
        .crossJoin(F.broadcast(health))
        .crossJoin(F.broadcast(high))
    )
    zero = F.lit(0.0)
    parts = {
        "completeness": (0.30, F.greatest(zero, 100.0 - F.col("null_pct") * 2.0)),
        "uniqueness": (0.20, F.greatest(zero, 100.0 - F.col("duplicate_pct") * 4.0)),
        "validity": (
            0.20,
            F.greatest(F.lit(50.0), 100.0 - F.col("mixed_columns") / F.col("columns") * 30.0),
        ),
        "consistency": (0.15, F.col("naming_score")),
        "stability": (0.15, F.greatest(F.lit(60.0), 100.0 - F.col("high_drift") * 15.0)),
    }
    score = F.round(reduce(lambda a, b: a + b, [part * w for w, part in parts.values()]), 1)
    tier = F.when(F.col("overall_score") >= 90, "Excellent").when(
        F.col("overall_score") >= 75, "Good"
    )
    return one.withColumn("overall_score", score).select(
        "overall_score",
        tier.otherwise("Needs Cleaning").alias("quality_tier"),
        *[F.round(part, 1).alias(name) for name, (_, part) in parts.items()],
        "null_pct",
        "duplicate_pct",
        "duplicate_rows",
        "high_drift",
    )


def quality_actions(scorecard: DataFrame, missing: DataFrame) -> DataFrame:
    """(action, detail, amount): what would raise the score, or that nothing needs doing.

    Takes the scorecard and the rows of :func:`missing_by_column`.
    """
    worst = missing.where("status = 'critical'").agg(
        F.min(F.struct((-F.col("missing_pct")).alias("k"), "column", "missing_pct")).alias("w")
    )
    facts = scorecard.select("duplicate_rows", "high_drift").crossJoin(F.broadcast(worst))
    found = [
        ("remove_duplicates", F.lit("exact duplicate rows"), F.col("duplicate_rows").cast("double")),
        ("handle_missing", F.col("w.column"), F.col("w.missing_pct")),
        ("inspect_drift", F.lit("columns with high drift"), F.col("high_drift").cast("double")),
    ]
    records = F.array(
        *[
            F.struct(F.lit(action).alias("action"), detail.alias("detail"), amount.alias("amount"))
            for action, detail, amount in found
        ]
    )
    wanted = F.filter(records, lambda r: r["amount"] > 0)
    nothing = F.array(
        F.struct(
            F.lit("none").alias("action"), F.lit("healthy").alias("detail"), F.lit(0.0).alias("amount")
        )
    )
    return facts.select(F.inline(F.when(F.size(wanted) > 0, wanted).otherwise(nothing)))
