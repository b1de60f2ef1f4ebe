"""KPI rows: (position, label, value, format, calculation), one per headline number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.fixed_values import (
    CATEGORY_LABELS,
    IDENTIFIER_LABELS,
    LEFT_WORDS,
    RECOVERED_WORDS,
)
from tidemark.functions.numbers import number
from tidemark.operators.series import last_two


def as_kpis(one_row: DataFrame, entries: list[tuple[str, Column, str, str]]) -> DataFrame:
    """Turn the columns of a one-row frame into KPI rows; a null value gives none."""
    records = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(label).alias("label"),
            value.cast("double").alias("value"),
            F.lit(kind).alias("format"),
            F.lit(calculation).alias("calculation"),
        )
        for i, (label, value, kind, calculation) in enumerate(entries)
    ]
    return one_row.select(F.inline(F.array(*records))).where("value is not null")


def stack_kpis(*parts: DataFrame) -> DataFrame:
    """KPI frames one after another, positions in that order."""
    shifted = [
        part.withColumn("position", F.col("position") + 100 * i) for i, part in enumerate(parts)
    ]
    return reduce(DataFrame.unionByName, shifted)


def kpi_base(quality: DataFrame) -> DataFrame:
    """Rows, columns, quality score, missing cells and duplicate rows, from a quality report."""
    return as_kpis(
        quality,
        [
            ("Total Records", F.col("rows"), "count", "COUNT(rows)"),
            ("Columns", F.col("columns"), "count", "COUNT(columns)"),
            ("Data Quality", F.col("overall_score"), "percent", "AVG(quality components)"),
            ("Missing Values", F.col("missing_values"), "count", "COUNT(empty cells)"),
            ("Duplicate Records", F.col("duplicate_rows"), "count", "COUNT(exact duplicate rows)"),
        ],
    )


def distinct_labels(column: str, kind: str) -> list[str]:
    """Labels under which a column's distinct count is shown, by its name and meaning."""
    name = column.lower()
    if kind == "identifier":
        return [label for label, tokens in IDENTIFIER_LABELS if any(t in name for t in tokens)]
    if kind == "person":
        return [f"Unique {column}"]
    if kind in ("region", "location"):
        return ["Regions" if "region" in name else "Locations"]
    if kind == "status":
        return ["Statuses"]
    if kind == "delivery_mode":
        return ["Delivery Modes"]
    if kind in ("category", "source"):
        if any(token in name for token in IDENTIFIER_LABELS[0][1]):
            return ["Unique Products"]
        return [CATEGORY_LABELS.get(name, f"{column} Count")]
    return []


def kpi_distinct(df: DataFrame, kinds: dict[str, str], approx: bool = False) -> DataFrame:
    """Distinct counts of the columns whose meaning calls for one.

    Columns are stacked first, so several exact counts share one grouping instead of multiplying
    the rows per count.
    """
    wanted = [(c, k, label) for c, k in kinds.items() for label in distinct_labels(c, k)]
    columns = list(dict.fromkeys(c for c, _, _ in wanted))
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v"))
        for c in columns
    ]
    stacked = df.select(F.inline(F.array(*pairs)))
    count = F.approx_count_distinct("v") if approx else F.count_distinct("v")
    counts = stacked.groupBy("column").agg(count.alias("n"))
    one_row = counts.groupBy().pivot("column", columns).agg(F.first("n"))
    entries = []
    for column, _, label in wanted:
        entries.append((label, F.col(f"`{column}`"), "count", f"COUNT(DISTINCT {column})"))
    return as_kpis(one_row, entries)


def kpi_numeric(df: DataFrame, kinds: dict[str, str], skip: tuple[str, ...] = ()) -> DataFrame:
    """``Total X`` of each currency column, and average age, salary and experience."""
    aggregates, entries = [], []
    for i, (column, kind) in enumerate(kinds.items()):
        value, name = number(df, column), column.lower()
        if kind == "currency" and column not in skip:
            aggregates.append(F.round(F.sum(value), 2).alias(f"t{i}"))
            label = f"Total {column.strip().title()}"
            entries.append((label, F.col(f"t{i}"), "currency", f"SUM({column})"))
        averages = [
            ("Average Age", "number", ["age"]),
            ("Average Salary", "currency", ["salary"]),
            ("Average Experience", "number", ["experience", "tenure"]),
        ]
        shown = next((a for a in averages if any(token in name for token in a[2])), None)
        if kind in ("numeric", "currency", "percentage") and shown:
            aggregates.append(F.round(F.avg(value), 2).alias(f"a{i}"))
            entries.append((shown[0], F.col(f"a{i}"), shown[1], f"AVG({column})"))
    return as_kpis(df.agg(*aggregates), entries)


def kpi_orders(
    df: DataFrame,
    orders: str | None = None,
    order_id: str | None = None,
    customers: str | None = None,
    quantity: str | None = None,
) -> DataFrame:
    """Total orders (a summed column, else distinct ids), customers and quantity."""
    aggregates, entries = [], []
    if orders:
        aggregates.append(F.sum(number(df, orders)).alias("orders"))
        entries.append(("Total Orders", F.floor("orders"), "count", f"SUM({orders})"))
    elif order_id:
        aggregates.append(F.count_distinct(F.col(f"`{order_id}`")).alias("orders"))
        entries.append(("Total Orders", F.col("orders"), "count", f"COUNT(DISTINCT {order_id})"))
    for label, column in (("Total Customers", customers), ("Total Quantity", quantity)):
        if column:
            aggregates.append(F.sum(number(df, column)).alias(label))
            entries.append((label, F.floor(F.col(f"`{label}`")), "count", f"SUM({column})"))
    return as_kpis(df.agg(*aggregates), entries)


def kpi_revenue(
    df: DataFrame,
    revenue: str,
    order_id: str | None = None,
    orders: str | None = None,
    series: DataFrame | None = None,
) -> DataFrame:
    """Total revenue, value per order, and the growth of the last period of the series."""
    income = "income" in revenue
    per_order = F.lit(None).cast("double")
    if orders:
        per_order = F.sum(number(df, orders))
    elif order_id:
        per_order = F.count_distinct(F.col(f"`{order_id}`")).cast("double")
    one_row = df.agg(F.sum(number(df, revenue)).alias("total"), per_order.alias("orders"))
    total = "Total Income" if income else "Total Revenue"
    each = "Average Transaction Value" if income else "Average Order Value"
    value = F.round(F.try_divide(F.col("total"), F.col("orders")), 2)
    entries = [
        (total, F.round("total", 2), "currency", f"SUM({revenue})"),
        (each, value, "currency", f"{total} / {orders or order_id}"),
    ]
    if series is not None:
        one_row = one_row.join(F.broadcast(last_two(series)), F.lit(True), "left")
        growth = F.round((F.try_divide(F.col("value"), F.col("prev_value")) - 1) * 100, 2)
        label = "Income Growth" if income else "Revenue Growth"
        entries.append((label, growth, "percent", "last period / previous period - 1"))
    return as_kpis(one_row, entries)


def kpi_profit(df: DataFrame, profit: str, revenue: str | None = None) -> DataFrame:
    """Total profit, and its share of revenue."""
    money = F.sum(number(df, revenue)) if revenue else F.lit(None).cast("double")
    one_row = df.agg(F.sum(number(df, profit)).alias("profit"), money.alias("revenue"))
    margin = F.round(F.try_divide(F.col("profit"), F.col("revenue")) * 100, 2)
    return as_kpis(
        one_row,
        [
            ("Total Profit", F.round("profit", 2), "currency", f"SUM({profit})"),
            ("Profit Margin", margin, "percent", f"SUM({profit}) / SUM({revenue})"),
        ],
    )


def kpi_rates(
    df: DataFrame, attrition: str | None = None, outcome: str | None = None
) -> DataFrame:
    """Attrition and recovery rates: the share of non-null values that are in a word list."""
    aggregates, entries = [], []
    for label, column, words in (
        ("Attrition Rate", attrition, LEFT_WORDS),
        ("Recovery Rate", outcome, RECOVERED_WORDS),
    ):
        if column:
            word = F.lower(F.trim(F.col(f"`{column}`").cast("string")))
            rate = F.avg(word.isin(words).cast("int")) * 100
            aggregates.append(F.round(rate, 2).alias(label))
            entries.append((label, F.col(f"`{label}`"), "percent", f"share of {column}"))
    return as_kpis(df.agg(*aggregates), entries)


def overview(kpis: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: the headline KPIs side by side, with rows, columns and quality."""
    headline = {
        "revenue": "Total Revenue",
        "orders": "Total Orders",
        "profit": "Total Profit",
        "aov": "Average Order Value",
        "margin": "Profit Margin",
    }
    picks = [
        F.max(F.when(F.col("label") == label, F.col("value"))).alias(name)
        for name, label in headline.items()
    ]
    shape = quality.select(
        F.col("rows").alias("records"), "columns", F.col("overall_score").alias("quality_score")
    )
    return kpis.agg(*picks).crossJoin(F.broadcast(shape))
