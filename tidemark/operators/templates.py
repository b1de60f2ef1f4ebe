"""The aggregates behind common questions about a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.numbers import number
from tidemark.operators.charts import correlations, group_counts
from tidemark.operators.quantiles import grouped_quantiles
from tidemark.operators.selection import rows_after
from tidemark.operators.series import last_two


def _sums(df: DataFrame, group: str, metric: str) -> DataFrame:
    return df.groupBy(F.col(f"`{group}`").alias("label")).agg(
        F.round(F.sum(number(df, metric)), 2).alias("value")
    )


def top_by_sum(df: DataFrame, group: str, metric: str, k: int = 10) -> DataFrame:
    return _sums(df, group, metric).orderBy(F.desc("value"), F.asc("label")).limit(k)


def bottom_by_sum(df: DataFrame, group: str, metric: str, k: int = 10) -> DataFrame:
    return _sums(df, group, metric).orderBy(F.asc("value"), F.asc("label")).limit(k)


def total_by_group(df: DataFrame, metric: str, group: str | None = None, k: int = 15) -> DataFrame:
    """Sums per group, largest first, or one overall sum."""
    if group is None:
        return df.agg(F.round(F.sum(number(df, metric)), 2).alias("value"))
    return top_by_sum(df, group, metric, k)


def avg_by_group(df: DataFrame, metric: str, group: str | None = None, k: int = 20) -> DataFrame:
    mean = F.round(F.avg(number(df, metric)), 2).alias("value")
    if group is None:
        return df.agg(mean)
    means = df.groupBy(F.col(f"`{group}`").alias("label")).agg(mean)
    return means.orderBy(F.desc("value"), F.asc("label")).limit(k)


def count_by_group(df: DataFrame, group: str | None = None, k: int = 20) -> DataFrame:
    rows = F.count(F.lit(1)).alias("value")
    if group is None:
        return df.agg(rows)
    counts = df.groupBy(F.col(f"`{group}`").alias("label")).agg(rows)
    return counts.orderBy(F.desc("value"), F.asc("label")).limit(k)


def sample_columns(df: DataFrame, columns: list[str], order_by: list[str], k: int = 20) -> DataFrame:
    """The first rows in a stated order, since a distributed table has no first rows of its own."""
    return df.orderBy(*order_by).select(*columns).limit(k)


_LITERAL = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


def capped_sql(df: DataFrame, text: str, cap: int | None = None) -> DataFrame:
    """The result of a query over the table ``dataset``; with ``cap``, so many rows at most.

    Only one query is accepted: commands and several statements do not parse as one. The word
    ``dataset`` inside a literal is left alone.
    """
    text = text.strip().rstrip(";")
    df.sparkSession._jsparkSession.sessionState().sqlParser().parseQuery(text)
    text = text.replace("{", "{{").replace("}", "}}")
    bound = re.sub(rf"({_LITERAL})|\bdataset\b", lambda m: m[1] or "{dataset}", text)
    result = df.sparkSession.sql(bound, dataset=df)
    return result if cap is None else result.limit(cap)


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: count, sum, mean, median, min and max of a numeric column."""
    value = number(df, column)
    middle = grouped_quantiles(df, [], value, {"median": 0.5}).withColumnsRenamed({"least": "min", "most": "max"})
    facts = middle.crossJoin(F.broadcast(df.agg(F.sum(value).alias("sum"), F.avg(value).alias("avg"))))  # one row each
    rounded = [F.round(c, 2).alias(c) for c in ("sum", "avg", "median", "min", "max")]
    return facts.select(F.col("n").alias("count"), *rounded)


def value_share(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """The most frequent values with their share of all rows, nulls counted in the whole."""
    rows = df.agg(F.count(F.lit(1)).alias("_n"))
    share = F.round(F.col("value") / F.greatest(F.col("_n"), F.lit(1)) * 100, 1)
    counts = group_counts(df, column, k)
    return counts.crossJoin(F.broadcast(rows)).select("label", "value", share.alias("share_pct"))


def pii_distinct(df: DataFrame, column: str) -> DataFrame:
    """Only how many distinct values a sensitive column has; never a value."""
    return df.agg(F.count_distinct(F.col(f"`{column}`")).alias("distinct_values"))


def period_change(df: DataFrame, series: DataFrame, dimension: str, metric: str) -> DataFrame:
    """One row: last and previous period, the change, and the dimension's largest value."""
    change = (F.col("value") - F.col("prev_value")) / F.greatest(F.col("prev_value"), F.lit(1e-6))
    best = top_by_sum(df.where(F.col(f"`{dimension}`").isNotNull()), dimension, metric, 1).select(
        F.col("label").alias("top_label"), F.col("value").alias("top_value")
    )
    return last_two(series).join(F.broadcast(best), F.lit(True), "left").select(
        "period", "value", "prev_period", "prev_value",
        F.round(change * 100, 1).alias("change_pct"),
        "top_label", "top_value",
    )


def strongest_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = correlations(df, columns)
    return pairs.orderBy(F.desc(F.abs("pearson")), F.asc("x"), F.asc("y")).limit(1)


def metric_card(df: DataFrame, metric: str, target_growth: float = 1.12) -> DataFrame:
    """One row: total, mean, target, benchmark and status.

    The target is the total times ``target_growth``; the benchmark is 92 % of the target.
    """
    value = number(df, metric)
    facts = df.agg(F.sum(value).alias("total"), F.avg(value).alias("mean"))
    aimed = facts.withColumn("target", F.round(F.col("total") * target_growth, 2))
    aimed = aimed.withColumn("benchmark", F.round(F.col("target") * 0.92, 2)).withColumn(
        "achievement_pct",
        F.round(F.col("total") / F.greatest(F.col("target"), F.lit(1e-4)) * 100, 1),
    )
    above = (F.col("total") - F.col("benchmark")) / F.greatest(F.col("benchmark"), F.lit(1e-4))
    status = (
        F.when(F.col("achievement_pct") >= 95, "Ahead of Target")
        .when(F.col("achievement_pct") >= 85, "On Track")
        .when(F.col("achievement_pct") >= 70, "Needs Attention")
        .otherwise("Critical Risk")
    )
    return aimed.select(
        F.round("total", 2).alias("total"),
        F.round("mean", 2).alias("mean"),
        "target",
        "benchmark",
        "achievement_pct",
        F.round(above * 100, 1).alias("benchmark_variance_pct"),
        status.alias("status"),
    )


def metric_sparkline(
    df: DataFrame, metric: str, order_by: list[str], pieces: int = 10
) -> DataFrame:
    """(chunk, value): sums of ``pieces`` equal runs of rows; what is left over is not shown.

    Fewer rows than pieces give one row each. The last rows of the runs are found by counting, so no
    row is sorted.
    """
    present = df.where(number(df, metric).isNotNull())
    _, ends = rows_after(
        present, {"runs": order_by}, lambda n: [max(1, n // pieces) * (i + 1) for i in range(pieces)]
    )
    chunk = sum((after.cast("long") for after in ends["runs"]), F.lit(0).cast("long"))
    return (
        present.groupBy(chunk.alias("chunk"))
        .agg(F.round(F.sum(number(df, metric)), 2).alias("value"))
        .where(F.col("chunk") < pieces)
        .orderBy("chunk")
    )


def secondary_card(df: DataFrame, metric: str, target_growth: float = 1.05) -> DataFrame:
    """One row: the average of a second metric and its target."""
    facts = df.agg(F.avg(number(df, metric)).alias("mean"))
    aimed = facts.withColumn("target", F.round(F.col("mean") * target_growth, 2))
    return aimed.select(
        F.round("mean", 2).alias("mean"),
        "target",
        F.round(F.try_divide(F.col("mean"), F.col("target")) * 100, 1).alias("achievement_pct"),
    )


def top_contributor(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """The leader and the runner-up with their share of the total; nothing for one group."""
    present = df.where(F.col(f"`{dimension}`").isNotNull())
    sums = _sums(present, dimension, metric)
    total = sums.agg(F.sum("value").alias("_total"), F.count(F.lit(1)).alias("_groups"))
    best = sums.orderBy(F.desc("value"), F.asc("label")).limit(2)
    line = Window.orderBy(F.desc("value"), F.asc("label"))  # over two rows
    share = F.when(
        F.col("_total") > 0, F.round(F.try_divide(F.col("value"), F.col("_total")) * 100, 1)
    )
    return (
        best.withColumn("place", F.row_number().over(line))
        .crossJoin(F.broadcast(total))
        .where("_groups > 1")
        .select("place", "label", "value", F.coalesce(share, F.lit(0.0)).alias("share_pct"))
    )
