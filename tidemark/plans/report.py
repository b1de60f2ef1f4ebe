"""Compositions: the cleaned table, and the set of charts that suits a profiled table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.fixed_values import DIMENSION_KINDS, NUMBER_KINDS
from tidemark.functions.numbers import number
from tidemark.operators import charts, cleaning, profile, series


def clean_table(raw: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Tidy names, trimmed text, typed columns; and the meaning found for each column.

    One job classifies the columns; the cleaned table itself stays lazy.
    """
    trimmed = cleaning.trim_nulls(cleaning.normalize_names(raw))
    kinds = profile.column_kinds(trimmed)
    return cleaning.coerce(trimmed, kinds), kinds


def _marks(
    chart_id: str, kind: str, rows: DataFrame, x: Column, value: Column, series_of: Column | None = None
) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return rows.select(
        F.lit(chart_id).alias("chart_id"),
        F.lit(kind).alias("kind"),
        x.cast("string").alias("x"),
        (nothing if series_of is None else series_of.cast("string")).alias("series"),
        F.round(value.cast("double"), 4).alias("value"),
    )


def _cube(df: DataFrame, sets: list[tuple[str, Column, Column]], numbers: list[str]) -> DataFrame:
    """(part, label, other, rows, and s, n, lo, hi of each number): all groupings of a report in one pass.

    ``sets`` are named pairs of labels. The caller has bounded their values, so the cube is small: it
    comes to the driver and back as a local table, which many charts then read.
    """
    values = [number(df, c).alias(f"v{i}") for i, c in enumerate(numbers)]
    parts = [F.struct(F.lit(name).alias("part"), label.alias("label"), other.alias("other")) for name, label, other in sets]
    facts = [
        fold(f"v{i}").alias(f"{name}{i}")
        for i in range(len(numbers)) for name, fold in (("s", F.sum), ("n", F.count), ("lo", F.min), ("hi", F.max))
    ]
    cube = df.select(*values, F.inline(F.array(*parts))).groupBy("part", "label", "other").agg(
        F.count(F.lit(1)).alias("rows"), *facts
    )
    return df.sparkSession.createDataFrame(cube.collect(), cube.schema)


def auto_charts(
    df: DataFrame,
    kinds: dict[str, str],
    distinct: dict[str, int],
    key: str,
    revenue: str | None = None,
    date: str | None = None,
) -> DataFrame:
    """(chart_id, kind, x, series, value): the charts a profiled table calls for, in long form.

    ``distinct`` holds the distinct counts of the columns, as a profile gives them. The columns
    decide which charts there are. One pass groups the table by every chosen dimension, by the
    first two together and by day; bars, pies, averages, treemap, funnel, combo, stacked bars,
    heatmap, trend and gauge all read that small cube, and it also bounds the histograms. The
    histograms, the correlations and the scatter charts take a pass each, the boxes two.
    """
    numbers = [c for c in kinds if kinds[c] in NUMBER_KINDS]
    wide = [c for c in kinds if kinds[c] in DIMENSION_KINDS and 1 < distinct.get(c, 0) <= 30]
    narrow = [c for c in wide if distinct[c] <= 25]
    metric = revenue or (numbers[0] if numbers else None)
    held = numbers if metric is None or metric in numbers else [*numbers, metric]
    at = {c: i for i, c in enumerate(held)}
    nothing = F.lit(None).cast("string")

    def text(c: str) -> Column:
        return F.col(f"`{c}`").cast("string")

    sets = [("all", nothing, nothing), *[(f"by {c}", text(c), nothing) for c in wide]]
    if len(narrow) >= 2:
        sets.append(("pair", text(narrow[0]), text(narrow[1])))
    if date:
        sets.append(("day", F.to_date(F.col(f"`{date}`")).cast("string"), nothing))
    cube = _cube(df, sets, held)
    parts: list[DataFrame] = []

    def add(chart_id, kind, rows, x, value, series_of=None):
        parts.append(_marks(chart_id, kind, rows, F.col(x), F.col(value), series_of))

    def by(c: str) -> DataFrame:
        return cube.where(F.col("part") == f"by {c}")

    def total(c: str) -> Column:
        return F.coalesce(f"s{at[c]}", F.lit(0.0))

    def ranked(rows: DataFrame, value: Column, most: int) -> DataFrame:
        shown = rows.select("label", value.alias("value")).where(F.col("value").isNotNull())
        return shown.orderBy(F.desc("value"), F.asc("label")).limit(most)

    for c in wide:
        present = by(c).where(F.col("label").isNotNull())
        bars = ranked(present, F.round(total(revenue), 2), 10) if revenue else ranked(present, F.col("rows"), 50)
        add(f"bar_{c}", "bar", bars, "label", "value")
    if date:
        days = cube.where("part = 'day'").select(
            F.to_date("label").alias("day"), (total(revenue) if revenue else F.col("rows").cast("double")).alias("amount")
        )
        add("trend", "line", series.time_series(days, "day", "amount"), "period", "value")
    whole = cube.where("part = 'all'").first()
    limits = {c: (whole[f"n{at[c]}"], whole[f"lo{at[c]}"], whole[f"hi{at[c]}"]) for c in numbers} if whole else {}
    if limits:
        bins = charts.histograms(df, limits, min_bins=5)
        parts.append(bins.select(
            F.concat(F.lit("hist_"), "column").alias("chart_id"), F.lit("histogram").alias("kind"),
            F.col("bin").cast("string").alias("x"), nothing.alias("series"),
            F.round(F.col("count").cast("double"), 4).alias("value"),
        ))
    for c in [c for c in wide if distinct[c] <= 6]:
        add(f"pie_{c}", "pie", ranked(by(c).where(F.col("label").isNotNull()), F.col("rows"), 50), "label", "value")
    if not revenue and numbers:
        for c in narrow:
            i = at[numbers[0]]
            means = by(c).where(F.col("label").isNotNull() & (F.col(f"n{i}") > 0))
            shown = ranked(means, F.round(F.col(f"s{i}") / F.col(f"n{i}"), 3), 10)
            several = shown.withColumn("_groups", F.count(F.lit(1)).over(Window.partitionBy())).where("_groups >= 2")
            add(f"avg_{c}_{numbers[0]}", "bar", several, "label", "value")
    if len(numbers) >= 2:
        strongest = (
            charts.correlations(df, numbers)
            .orderBy(F.desc(F.abs("pearson")), F.asc("x"), F.asc("y"))
            .limit(3)
        ).collect()  # three rows, which choose the columns that are charted
        if strongest:
            local = df.sparkSession.createDataFrame(strongest, "x string, y string, pearson double, sample_size long")
            parts.append(_marks("scatter", "correlation", local, F.col("x"), F.col("pearson"), F.col("y")))
            points = charts.scatter_pairs(df, [(r["x"], r["y"]) for r in strongest], key, points=500)
            names = F.array(*[F.lit(f"scatter_{r['x']}_{r['y']}") for r in strongest])
            parts.append(points.select(
                names[F.col("pair")].alias("chart_id"), F.lit("scatter").alias("kind"), F.col("x").cast("string").alias("x"),
                nothing.alias("series"), F.round("y", 4).alias("value"),
            ))
    if narrow and metric:
        first = narrow[0]
        sums = by(first).select("label", total(metric).alias("metric"), "rows")
        add(f"treemap_{first}", "treemap", charts.treemap(sums, "label", "metric", top_n=8), "label", "value")
        add(f"funnel_{first}", "funnel", charts.funnel(sums, "label", "metric", top_n=5), "stage", "value")
        if distinct[first] >= 3 and len(numbers) >= 2:
            other = next(c for c in numbers if c != metric)
            mean = F.col(f"s{at[other]}") / F.col(f"n{at[other]}")
            pairs = by(first).select("label", total(metric).alias("primary"), mean.alias("secondary"))
            both = charts.combo(pairs, "label", "primary", "secondary", top_n=8)
            add(f"combo_{first}", "combo", both, "label", "primary", F.lit(metric))
            add(f"combo_{first}", "combo", both, "label", "secondary", F.lit(other))
        often = [r["label"] for r in sums.orderBy(F.desc("rows"), F.asc("label")).limit(5).collect()]
        box = charts.box_plot(df, numbers[0], first, categories=often) if numbers else None
        for part in ("min", "q1", "median", "q3", "max") if numbers else ():
            add(f"box_{numbers[0]}", "box_plot", box, "category", part, F.lit(part))
    if len(narrow) >= 2:
        a, b = narrow[:2]
        value = total(metric) if metric else F.col("rows").cast("double")
        cells = cube.where("part = 'pair'").select(
            F.col("label").alias("_x"), F.col("other").alias("_y"), value.alias("value"), F.col("rows").alias("count")
        )
        for chart, kind, top_x, top_y in (("stacked", "stacked_bar", 6, 4), ("heatmap", "heatmap", 6, 5)):
            grid = charts.grid_of(cells, top_x, top_y).withColumn("value", F.round("value", 2))
            add(f"{chart}_{a}_{b}", kind, grid, "x", "value", F.col("y"))
    if metric:
        amount = cube.where("part = 'all'").select(F.col(f"s{at[metric]}").alias("value"))
        for name, factor in (("value", 1.0), ("target", 1.15), ("max", 1.3)):
            rows = amount.withColumn("name", F.lit(name)).withColumn("value", F.round(F.col("value") * factor, 2))
            add(f"gauge_{metric}", "gauge", rows, "name", "value")
    return reduce(DataFrame.unionByName, parts)
