"""Chart queries: filter, bucket, aggregate, rank. One row per mark."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.dates import CHART_GRAINS, chart_label, choose_grain, whole_days
from tidemark.functions.numbers import is_temporal, measure, number, percent
from tidemark.operators.comoments import pair_moments
from tidemark.operators.quantiles import grouped_quantiles
from tidemark.operators.ranks import number_rows
from tidemark.operators.selection import half_of, rows_after


def date_bucket(
    df: DataFrame, column: str, grain: str = "auto", name: str = "label"
) -> DataFrame:
    """Add a period label; rows without a date are dropped.

    ``auto`` picks the grain from the span of the dates. The span is one row, joined in the plan,
    so no job runs before the query itself.
    """
    when = F.col(f"`{column}`")
    dated = df.where(when.isNotNull())
    if grain != "auto":
        return dated.withColumn(name, chart_label(when, grain))
    span = dated.agg(whole_days(F.min(when), F.max(when)).alias("_span"))
    picked = span.select(choose_grain(F.col("_span"), CHART_GRAINS).alias("_grain"))
    joined = dated.crossJoin(F.broadcast(picked))
    return joined.withColumn(name, chart_label(when, F.col("_grain"))).drop("_grain")


def with_label(df: DataFrame, by: str, grain: str = "auto", name: str = "label") -> DataFrame:
    """Add the chart label of a column: its period if it is a date, else its text."""
    if is_temporal(df, by):
        return date_bucket(df, by, grain, name)
    return df.withColumn(name, F.col(f"`{by}`").cast("string"))


def agg_measure(
    df: DataFrame, keys: list[str], metric: str | None = None, agg: str = "sum"
) -> DataFrame:
    """(keys, value, count): one measure per group, and its rows. Empty groups give 0.

    ``sum avg min max median count distinct_count pct``; ``pct`` is the group's share of the total
    over all groups.
    """
    rows = F.count(F.lit(1)).alias("count")
    if metric is not None and agg == "median":
        counts = df.groupBy(*keys).agg(rows)
        middle = grouped_quantiles(df, keys, number(df, metric), {"value": 0.5})
        named = middle.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "value")
        same = F.lit(True)
        for key in keys:
            same = same & counts[key].eqNullSafe(named[f"_m_{key}"])
        joined = counts.join(named, same, "left")
        return joined.select(*keys, F.coalesce("value", F.lit(0.0)).alias("value"), "count")
    grouped = df.groupBy(*keys).agg(measure(df, metric, agg).alias("value"), rows)
    if metric is None or agg != "pct":
        return grouped
    total = grouped.agg(F.sum("value").alias("_total"), F.sum("count").alias("_rows"))
    part = F.try_divide(F.col("value"), F.col("_total")) * 100
    share = F.coalesce(F.when(F.col("_rows") > 0, part), F.lit(0.0))
    return grouped.crossJoin(F.broadcast(total)).select(*keys, share.alias("value"), "count")


def in_order(df: DataFrame, value: str, label: str, sort_by: str, descending: bool) -> DataFrame:
    """Order by value, ties in label order, or by label alone."""
    key = label if sort_by == "label" else value
    first = F.desc(key) if descending else F.asc(key)
    return df.orderBy(first) if key == label else df.orderBy(first, F.asc(label))


def group_measure(
    df: DataFrame,
    by: str,
    metric: str | None = None,
    agg: str = "sum",
    grain: str = "auto",
    sort_by: str = "value",
    descending: bool = True,
    top_n: int | None = None,
) -> DataFrame:
    """Column, bar, line, area, pie, donut and table charts: (label, value, count, percentage).

    The percentage is of the total over all labels, taken before ``top_n``. The total is one row,
    not a window, so the labels are never gathered in one task.
    """
    grouped = agg_measure(with_label(df, by, grain), ["label"], metric, agg)
    rounded = grouped.withColumn("value", F.round("value", 2))
    # Asking for the rows as well keeps both branches on one aggregation, whose shuffle is reused.
    total = rounded.agg(F.sum("value").alias("_total"), F.sum("count").alias("_rows"))
    share = percent(F.col("value"), F.col("_total"), 1)
    shared = rounded.crossJoin(F.broadcast(total)).select(
        "label",
        "value",
        "count",
        F.when(F.col("_rows") > 0, share).otherwise(F.lit(0.0)).alias("percentage"),
    )
    result = in_order(shared, "value", "label", sort_by, descending)
    return result.limit(top_n) if top_n else result


def drill_rollup(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Year, quarter, month and day totals in one result, told apart by ``level``.

    Rows are summed per day first, so the rollup expands days, not rows.
    """
    day = F.to_date(F.col(f"`{date}`"))
    daily = (
        df.where(F.col(f"`{date}`").isNotNull())
        .groupBy(day.alias("day"))
        .agg(F.sum(number(df, metric)).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    )
    parts = daily.select(
        F.year("day").alias("year"),
        F.quarter("day").alias("quarter"),
        F.month("day").alias("month"),
        F.dayofmonth("day").alias("dom"),
        "_sum",
        "_rows",
    )
    rolled = parts.rollup("year", "quarter", "month", "dom").agg(
        F.grouping_id().alias("_gid"),
        F.round(F.sum("_sum"), 2).alias("value"),
        F.sum("_rows").alias("count"),
    )
    level = (
        F.when(F.col("_gid") == 0, "day")
        .when(F.col("_gid") == 1, "month")
        .when(F.col("_gid") == 3, "quarter")
        .when(F.col("_gid") == 7, "year")
        .otherwise("all")
    )
    label = (
        F.when(F.col("_gid") == 0, F.date_format(F.make_date("year", "month", "dom"), "yyyy-MM-dd"))
        .when(F.col("_gid") == 1, F.format_string("%04d-%02d", "year", "month"))
        .when(F.col("_gid") == 3, F.concat(F.col("year").cast("string"), F.lit("-Q"), F.col("quarter").cast("string")))
        .when(F.col("_gid") == 7, F.col("year").cast("string"))
        .otherwise("all")
    )
    return rolled.select(level.alias("level"), label.alias("label"), "value", "count")


def dense_grid(
    df: DataFrame,
    x: str,
    y: str,
    metric: str | None,
    agg: str,
    top_x: int,
    top_y: int,
    grain: str = "auto",
) -> DataFrame:
    """(x, y, value): every pair of the most frequent x and y values, 0 where no row has it.

    One grouping by (x, y) feeds the two rankings and the cells. The grid is built from ``top_x``
    times ``top_y`` rows, so its size is fixed by the arguments. The rankings also sort by the
    value, behind the unique label, and the cells also look at their rows: neither decides
    anything, but so all three need the same columns and reuse one shuffle.
    """
    labelled = with_label(with_label(df, x, grain, "_x"), y, grain, "_y")
    return grid_of(agg_measure(labelled, ["_x", "_y"], metric, agg), top_x, top_y)


def grid_of(cells: DataFrame, top_x: int, top_y: int) -> DataFrame:
    """The dense grid of cells (_x, _y, value, count)."""

    def best(key: str, k: int) -> DataFrame:
        counts = cells.groupBy(key).agg(F.sum("count").alias("_rows"), F.max("value").alias("_v"))
        return counts.orderBy(F.desc("_rows"), F.asc(key), F.asc("_v")).limit(k).select(key)

    pairs = best("_x", top_x).crossJoin(F.broadcast(best("_y", top_y)))
    wanted = pairs.select(F.col("_x").alias("x"), F.col("_y").alias("y"))
    same = wanted["x"].eqNullSafe(cells["_x"]) & wanted["y"].eqNullSafe(cells["_y"])
    found = cells.join(F.broadcast(wanted), same, "right")
    filled = F.when(F.col("count") > 0, F.col("value"))
    return found.select("x", "y", F.coalesce(filled, F.lit(0.0)).alias("value"))


def stacked(
    df: DataFrame,
    x: str,
    legend: str,
    metric: str | None = None,
    agg: str = "sum",
    top_x: int = 10,
    top_legend: int = 6,
    grain: str = "auto",
) -> DataFrame:
    """Stacked bars in long form: (label, series, value, total), 0 for empty cells.

    Labels and series are the most frequent ones by rows. ``total`` is the whole bar.
    """
    grid = dense_grid(df, x, legend, metric, agg, top_x, top_legend, grain)
    bar = Window.partitionBy("x")
    return grid.select(
        F.col("x").alias("label"),
        F.col("y").alias("series"),
        F.round("value", 2).alias("value"),
        F.round(F.sum("value").over(bar), 2).alias("total"),
    )


def stacked_wide(grid: DataFrame, series: list[str]) -> DataFrame:
    """The stacked chart as one row per label, with a column per named series."""
    return (
        grid.groupBy("label", "total")
        .pivot("series", series)
        .agg(F.first("value"))
        .orderBy(F.desc("total"), F.asc("label"))
    )


def heatmap(
    df: DataFrame,
    x: str,
    y: str,
    metric: str | None = None,
    agg: str = "sum",
    top_x: int = 8,
    top_y: int = 8,
) -> DataFrame:
    """Heat cells (x, y, value, intensity); intensity is the place between min and max."""
    grid = dense_grid(df, x, y, metric, agg, top_x, top_y)
    every = Window.partitionBy()
    low, high = F.min("value").over(every), F.max("value").over(every)
    spread = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return grid.select(
        "x",
        "y",
        F.round("value", 2).alias("value"),
        F.round((F.round("value", 2) - low) / spread, 3).alias("intensity"),
    )


def combo(
    df: DataFrame,
    by: str,
    primary: str,
    secondary: str,
    agg: str = "sum",
    grain: str = "auto",
    sort_by: str = "value",
    descending: bool = True,
    top_n: int | None = None,
) -> DataFrame:
    """Bars and a line over one axis: (label, primary, secondary).

    The second measure is an average when the first is a sum.
    """
    base = with_label(df, by, grain)
    other = "avg" if agg == "sum" else agg
    if "median" in (agg, other) or "pct" in (agg, other):
        left = agg_measure(base, ["label"], primary, agg).select("label", F.col("value").alias("primary"))
        right = agg_measure(base, ["label"], secondary, other).select(
            F.col("label").alias("_l"), F.col("value").alias("secondary")
        )
        both = left.join(right, left["label"].eqNullSafe(right["_l"])).drop("_l")
    else:
        both = base.groupBy("label").agg(
            measure(base, primary, agg).alias("primary"),
            measure(base, secondary, other).alias("secondary"),
        )
    rounded = both.select(
        "label", F.round("primary", 2).alias("primary"), F.round("secondary", 2).alias("secondary")
    )
    result = in_order(rounded, "primary", "label", sort_by, descending)
    return result.limit(top_n) if top_n else result


def treemap(
    df: DataFrame,
    by: str,
    metric: str | None = None,
    agg: str = "sum",
    top_n: int | None = None,
) -> DataFrame:
    """(label, value, pct): the share is of the shown boxes, so after ``top_n``."""
    grouped = agg_measure(with_label(df, by), ["label"], metric, agg).select("label", "value")
    shown = in_order(grouped, "value", "label", "value", True)
    shown = shown.limit(top_n) if top_n else shown
    total = shown.agg(F.sum("value").alias("_total"))
    whole = F.when(F.col("_total") != 0, F.col("_total")).otherwise(F.lit(1.0))
    return shown.crossJoin(F.broadcast(total)).select(
        "label",
        F.round("value", 2).alias("value"),
        F.round(F.col("value") / whole * 100, 1).alias("pct"),
    )


def funnel(
    df: DataFrame,
    by: str,
    metric: str | None = None,
    agg: str = "sum",
    top_n: int | None = None,
) -> DataFrame:
    """Stages from largest to smallest: (position, stage, value, pct_of_first, pct_of_prev).

    Without ``top_n`` the number of stages is unknown, so they are numbered in parallel and each
    is joined to the one before it; with it, at most ``top_n`` rows are put in order.
    """
    grouped = agg_measure(with_label(df, by), ["label"], metric, agg).select(
        F.col("label").alias("stage"), "value"
    )
    order = [F.desc("value"), F.asc("stage")]
    if top_n:
        line = Window.orderBy(*order)
        staged = grouped.orderBy(*order).limit(top_n).select(
            F.row_number().over(line).cast("long").alias("position"),
            "stage",
            "value",
            F.lag("value").over(line).alias("_before"),
            F.first("value").over(line).alias("_first"),
        )
    else:
        placed = number_rows(grouped, order, "position")
        earlier = placed.select(
            (F.col("position") + 1).alias("position"), F.col("value").alias("_before")
        )
        first = placed.where(F.col("position") == 1).select(F.col("value").alias("_first"))
        staged = placed.join(earlier, "position", "left").crossJoin(F.broadcast(first))
    base = F.when(F.col("_first") > 0, F.col("_first")).otherwise(F.lit(1.0))
    before = F.coalesce("_before", base)
    return staged.select(
        "position",
        "stage",
        F.round("value", 2).alias("value"),
        F.round(F.col("value") / base * 100, 1).alias("pct_of_first"),
        F.when(before > 0, F.round(F.try_divide(F.col("value"), before) * 100, 1))
        .otherwise(F.lit(100.0))
        .alias("pct_of_prev"),
    )


def box_stats(
    df: DataFrame, value: str, by: str | None = None, top_n: int = 8, min_rows: int = 4,
    categories: list[str | None] | None = None,
) -> DataFrame:
    """Unrounded box of each of the most frequent categories (or of those given), or one over all rows.

    (category, count, low, q1, median, q3, high): the whiskers reach 1.5 IQR beyond the quartiles
    but never past the smallest and largest value.
    """
    if by is None:
        labelled = df.withColumn("category", F.lit(value))
    else:
        labelled = df.withColumn("category", F.col(f"`{by}`").cast("string"))
        if categories is None:
            labelled = _top_category_rows(labelled, top_n)
        else:
            named = F.col("category").isin([c for c in categories if c is not None])
            labelled = labelled.where(named | F.col("category").isNull() if None in categories else named)
    boxes = grouped_quantiles(
        labelled,
        ["category"],
        number(labelled, value),
        {"q1": 0.25, "median": 0.5, "q3": 0.75},
        few_groups=True,
    )
    iqr = F.col("q3") - F.col("q1")
    return boxes.where(F.col("n") >= min_rows).select(
        "category",
        F.col("n").alias("count"),
        F.greatest(F.col("least"), F.col("q1") - 1.5 * iqr).alias("low"),
        "q1",
        "median",
        "q3",
        F.least(F.col("most"), F.col("q3") + 1.5 * iqr).alias("high"),
    )


def _top_category_rows(labelled: DataFrame, top_n: int) -> DataFrame:
    counts = labelled.groupBy("category").agg(F.count(F.lit(1)).alias("_rows"))
    best = counts.orderBy(F.desc("_rows"), F.asc("category")).limit(top_n)
    best = best.select(F.col("category").alias("_best"))
    return labelled.join(
        F.broadcast(best), F.col("category").eqNullSafe(F.col("_best")), "left_semi"
    )


def box_plot(
    df: DataFrame, value: str, by: str | None = None, top_n: int = 8, categories: list[str | None] | None = None
) -> DataFrame:
    """Rounded boxes: (category, count, min, q1, median, q3, max)."""
    boxes = box_stats(df, value, by, top_n, categories=categories)
    return boxes.select(
        "category",
        "count",
        F.round("low", 2).alias("min"),
        F.round("q1", 2).alias("q1"),
        F.round("median", 2).alias("median"),
        F.round("q3", 2).alias("q3"),
        F.round("high", 2).alias("max"),
    )


def box_outliers(
    df: DataFrame, value: str, by: str | None = None, top_n: int = 8, keep: int = 20
) -> DataFrame:
    """The ``keep`` smallest values outside each box's whiskers: (category, position, value).

    Row-number-at-most-k is cut to k rows per category before the shuffle.
    """
    boxes = box_stats(df, value, by, top_n).select("category", "low", "high")
    label = F.lit(value) if by is None else F.col(f"`{by}`").cast("string")
    rows = df.select(label.alias("category"), number(df, value).alias("value"))
    bounded = rows.join(
        F.broadcast(boxes.withColumnRenamed("category", "_c")),
        F.col("category").eqNullSafe(F.col("_c")),
    )
    outside = bounded.where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
    line = Window.partitionBy("category").orderBy("value")
    numbered = outside.withColumn("position", F.row_number().over(line))
    return numbered.where(F.col("position") <= keep).select(
        "category", F.col("position").cast("long").alias("position"), "value"
    )


def histogram(df: DataFrame, value: str, min_bins: int = 6, max_bins: int = 20) -> DataFrame:
    """Equal-width bins (bin, lower, upper, count, frequency), empty ones included.

    The bin count grows with log2 of the rows. A column with fewer than two distinct values has no
    histogram, so it gives no rows.
    """
    values = df.select(number(df, value).alias("v")).where(F.col("v").isNotNull())
    limits = values.agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    ).where(F.col("lo") < F.col("hi"))
    wanted = F.ceil(F.log2("n") + 1).cast("int")
    limits = limits.withColumn("b", F.least(F.lit(max_bins), F.greatest(F.lit(min_bins), wanted)))
    width = (F.col("hi") - F.col("lo")) / F.col("b")
    place = F.floor((F.col("v") - F.col("lo")) * F.col("b") / (F.col("hi") - F.col("lo")))
    counts = (
        values.crossJoin(F.broadcast(limits))
        .groupBy(F.least(place, F.col("b") - 1).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    bins = limits.select("*", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("bin"))
    count = F.coalesce("hits", F.lit(0))
    return (
        bins.join(counts, "bin", "left")
        .select(
            "bin",
            F.round(F.col("lo") + width * F.col("bin"), 6).alias("lower"),
            F.round(F.col("lo") + width * (F.col("bin") + 1), 6).alias("upper"),
            count.alias("count"),
            F.round(count / F.col("n") * 100, 1).alias("frequency"),
        )
        .orderBy("bin")
    )


def histograms(df: DataFrame, limits: dict[str, tuple[int, float, float]], min_bins: int = 6, max_bins: int = 20) -> DataFrame:
    """(column, bin, count) for many columns in one pass, empty bins included.

    ``limits`` gives each column's number of values, smallest and largest value, as a profile knows
    them; the bins are those of :func:`histogram`.
    """
    used = {c: (n, lo, hi) for c, (n, lo, hi) in limits.items() if n and lo < hi}
    bins = {c: min(max_bins, max(min_bins, math.ceil(math.log2(n) + 1))) for c, (n, _, _) in used.items()}
    cells, every = [], []
    for c, (_, lo, hi) in used.items():
        place = F.floor((number(df, c) - lo) * bins[c] / (hi - lo))
        cells.append(F.struct(F.lit(c).alias("column"), F.least(place, F.lit(bins[c] - 1)).cast("int").alias("bin")))
        every += [(c, i) for i in range(bins[c])]
    schema = "column string, bin int"
    if not used:
        return df.sparkSession.createDataFrame([], schema + ", count long")
    hits = df.select(F.inline(F.array(*cells))).where("bin IS NOT NULL").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("hits"))
    whole = df.sparkSession.createDataFrame(every, schema)
    return whole.join(hits, ["column", "bin"], "left").select("column", "bin", F.coalesce("hits", F.lit(0)).alias("count"))


def scatter_pairs(df: DataFrame, pairs: list[tuple[str, str]], key: str, points: int = 600) -> DataFrame:
    """(pair, x, y): for each pair of columns a reproducible sample of its points, all in one pass.

    As in :func:`scatter`, rows are taken in the order of a hash of their key, ties by the point;
    each task keeps ``points`` rows a pair before the shuffle.
    """
    key_text = F.col(f"`{key}`").cast("string")
    stacked = df.select(F.md5(key_text.cast("binary")).alias("_h"), key_text.alias("_k"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("pair"), number(df, x).alias("x"), number(df, y).alias("y")) for i, (x, y) in enumerate(pairs)
    ]))).where("x IS NOT NULL AND y IS NOT NULL")
    line = Window.partitionBy("pair").orderBy("_h", "_k", "x", "y")
    return stacked.withColumn("_at", F.row_number().over(line)).where(F.col("_at") <= points).select("pair", "x", "y")


def scatter(
    df: DataFrame, x: str, y: str, key: str, size: str | None = None, points: int = 600
) -> DataFrame:
    """A reproducible sample of the rows with both numbers: (x, y, size).

    Rows are taken in the order of a hash of their key, so the same table gives the same sample
    however it is partitioned. Without a size column every mark has size 10.
    """
    mark = number(df, size) if size else F.lit(10.0)
    pairs = df.select(
        number(df, x).alias("x"),
        number(df, y).alias("y"),
        F.coalesce(mark, F.lit(10.0)).alias("size"),
        F.col(f"`{key}`").alias("_key"),
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    order = [F.md5(F.col("_key").cast("string").cast("binary")), F.col("_key")]
    return pairs.orderBy(*order).limit(points).select("x", "y", "size")


def gauge(df: DataFrame, metric: str, agg: str = "sum") -> DataFrame:
    """One row: value, min, max, target (80 % of max) and the value's place in the range."""
    value = number(df, metric)
    if agg == "median":
        core = grouped_quantiles(df, [], value, {"value": 0.5}).withColumnsRenamed({"least": "_lo", "most": "_hi"})
    elif agg == "pct":
        core = df.agg(
            F.when(F.sum(value) != 0, F.lit(100.0)).otherwise(F.lit(0.0)).alias("value"),
            F.min(value).alias("_lo"),
            F.max(value).alias("_hi"),
        )
    else:
        core = df.agg(
            measure(df, metric, agg).alias("value"),
            F.min(value).alias("_lo"),
            F.max(value).alias("_hi"),
        )
    low = F.coalesce("_lo", F.lit(0.0)) if agg in ("min", "avg") else F.lit(0.0)
    if agg == "pct":
        high = F.lit(100.0)
    else:
        high = F.coalesce("_hi", F.greatest(F.col("value") * 1.3, F.lit(100.0)))
    ranged = core.select("value", low.alias("min"), high.alias("max"))
    spread = F.col("max") - F.col("min")
    place = F.when(spread > 0, F.round((F.col("value") - F.col("min")) / spread * 100, 1))
    return ranged.select(
        F.round("value", 2).alias("value"),
        F.round("min", 2).alias("min"),
        F.round("max", 2).alias("max"),
        F.round(F.col("max") * 0.8, 2).alias("target"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(place, F.lit(50.0)))).alias("pct"),
    )


def kpi_card(df: DataFrame, metric: str, order_by: list[str], agg: str = "sum") -> DataFrame:
    """The value over all rows against the same measure over the earlier half of them.

    ``order_by`` is the date column followed by the columns that make the order unique. The prior
    value needs four dated rows; the variance is of its magnitude. The target is 15 % above.
    The middle row is found by counting, so no row is sorted.
    """
    dated = df.where(F.col(f"`{order_by[0]}`").isNotNull())
    total, (late,) = half_of(dated, order_by)
    prior = dated.where(~late & F.lit(total >= 4)).select(number(df, metric).alias("_m"), F.lit(1).alias("_one"))
    now = agg_measure(df.withColumn("_one", F.lit(1)), ["_one"], metric, agg)
    before = agg_measure(prior, ["_one"], "_m", agg).select(
        "_one", F.col("value").alias("prior")
    )
    both = now.join(F.broadcast(before), "_one", "left")
    gap = F.col("value") - F.col("prior")
    moved = F.col("prior") != 0
    target = F.round(F.col("value") * 1.15, 2)
    return both.select(
        F.round("value", 2).alias("value"),
        F.round("prior", 2).alias("prior_value"),
        F.when(moved, F.round(gap / F.abs("prior") * 100, 2)).alias("variance_pct"),
        F.when(moved, F.round(gap, 2)).alias("variance_abs"),
        target.alias("target"),
        F.when(target != 0, F.round(F.try_divide(F.col("value"), target) * 100, 1))
        .otherwise(F.lit(100.0))
        .alias("achievement_pct"),
        F.col("count").alias("total_rows"),
    )


def kpi_sparkline(
    df: DataFrame, metric: str, order_by: list[str], agg: str = "sum", pieces: int = 8
) -> DataFrame:
    """The measure over consecutive chunks of rows: (chunk, period, value).

    Chunks hold floor(n / pieces) rows, so a short last one follows when n does not divide. With
    fewer than four dated rows there is no sparkline. The last rows of the chunks, fewer than twice
    the pieces, are found by counting, so no row is sorted.
    """
    date = F.col(f"`{order_by[0]}`")
    dated = df.where(date.isNotNull())

    def ends(rows: int) -> list[int]:
        length = max(1, rows // pieces)
        return list(range(length, rows, length))

    total, found = rows_after(dated, {"chunks": order_by}, ends)
    chunk = sum((after.cast("long") for after in found["chunks"]), F.lit(0).cast("long"))
    chunked = dated.where(F.lit(total >= 4)).select(
        chunk.alias("chunk"), date.alias("_date"), number(df, metric).alias("_m")
    )
    values = agg_measure(chunked, ["chunk"], "_m", agg)
    starts = chunked.groupBy("chunk").agg(F.to_date(F.min("_date")).alias("period"))
    return (
        values.join(starts, "chunk")
        .select("chunk", "period", F.round("value", 2).alias("value"))
        .orderBy("chunk")
    )


def group_counts(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """The most frequent non-null values: (label, value)."""
    present = df.where(F.col(f"`{column}`").isNotNull())
    counts = present.groupBy(F.col(f"`{column}`").cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("value")
    )
    return counts.orderBy(F.desc("value"), F.asc("label")).limit(limit)


def group_sums(df: DataFrame, dimension: str, metric: str, limit: int = 10) -> DataFrame:
    """The largest metric sums over non-null dimension values: (label, value)."""
    present = df.where(F.col(f"`{dimension}`").isNotNull())
    sums = present.groupBy(F.col(f"`{dimension}`").cast("string").alias("label")).agg(
        F.round(F.coalesce(F.sum(number(df, metric)), F.lit(0.0)), 2).alias("value")
    )
    return sums.orderBy(F.desc("value"), F.asc("label")).limit(limit)


def metric_by_dimension(df: DataFrame, dimension: str, metric: str, limit: int = 10) -> DataFrame:
    """The largest averages over non-null dimension values; nothing for a single group."""
    present = df.where(F.col(f"`{dimension}`").isNotNull())
    means = (
        present.groupBy(F.col(f"`{dimension}`").cast("string").alias("label"))
        .agg(F.round(F.avg(number(df, metric)), 3).alias("value"))
        .where(F.col("value").isNotNull())
    )
    shown = means.orderBy(F.desc("value"), F.asc("label")).limit(limit)
    groups = shown.agg(F.count(F.lit(1)).alias("_groups"))
    return shown.crossJoin(F.broadcast(groups)).where("_groups >= 2").drop("_groups")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of each pair of columns: (x, y, pearson, sample_size).

    One pass over the columns serves all pairs (see :mod:`tidemark.operators.comoments`). A pair
    needs three rows with both numbers and two distinct values on each side among them.
    """
    facts = pair_moments(df, columns).where("varied and n >= 3")
    names = F.array(*[F.lit(c) for c in columns])
    spread = F.sqrt("var_i") * F.sqrt("var_j")
    return facts.select(
        names[F.col("i")].alias("x"),
        names[F.col("j")].alias("y"),
        F.round(F.try_divide(F.col("cov"), spread), 4).alias("pearson"),
        F.col("n").alias("sample_size"),
    )
