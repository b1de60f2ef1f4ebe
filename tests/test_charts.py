import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import charts, filters

SCHEMA = "k string, v double, d date"


@pytest.fixture()
def messy(spark):
    rows = [
        ("a", 1.0, "2024-01-01"), ("a", 3.0, "2024-02-01"), ("b", math.nan, "2024-02-03"),
        ("b", None, None), (None, 5.0, "2024-03-01"), ("c", -2.0, "2024-03-02"),
    ]
    return spark.createDataFrame(rows, "k string, v double, d string").withColumn(
        "d", F.to_date("d")
    )


def as_dict(df, key="label", value="value"):
    return {r[key]: r[value] for r in df.collect()}


def test_null_labels_stay_and_nan_is_missing(messy):
    got = as_dict(charts.group_measure(messy, "k", "v"))
    assert got == {"a": 4.0, "b": 0.0, None: 5.0, "c": -2.0}


def test_count_and_distinct_count(messy):
    assert as_dict(charts.group_measure(messy, "k", "v", "distinct_count"))["a"] == 2.0
    assert as_dict(charts.group_measure(messy, "k"))["b"] == 2.0


def test_zero_total_has_no_share(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", -2.0)], "k string, v double")
    assert as_dict(charts.group_measure(df, "k", "v"), value="percentage") == {"a": 0.0, "b": 0.0}
    assert as_dict(charts.group_measure(df, "k", "v", "pct")) == {"a": 0.0, "b": 0.0}


def test_ties_keep_label_order_and_top_n_comes_last(spark):
    df = spark.createDataFrame([(k, 1.0) for k in "dbca"], "k string, v double")
    rows = charts.group_measure(df, "k", "v", top_n=2).collect()
    assert [(r["label"], r["percentage"]) for r in rows] == [("a", 25.0), ("b", 25.0)]


def test_rows_without_a_date_are_dropped(messy):
    got = as_dict(charts.group_measure(messy, "d", "v", grain="month"), value="count")
    assert got == {"2024-01": 1, "2024-02": 2, "2024-03": 2}


@pytest.mark.parametrize(
    "days, label", [(10, "2024-01-01"), (100, "2024-01"), (300, "2024-Q1"), (900, "2024")]
)
def test_auto_grain_follows_the_span(spark, days, label):
    df = spark.createDataFrame([(0,), (days,)], "n int").select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("d")
    )
    assert label in as_dict(charts.group_measure(df, "d"))


def test_unknown_filter_columns_and_open_ends(messy):
    kept = filters.slice_filter(messy, [
        {"column": "nowhere", "operator": "eq", "value": 1},
        {"column": "v", "operator": "gte", "value": None},
        {"column": "d", "operator": "date_range", "value": ["2024-02-01", None]},
    ])
    assert kept.count() == 4
    assert filters.slice_filter(messy, [{"column": "v", "operator": "eq", "value": "x"}]).count() == 0


def test_funnel_without_limit_equals_funnel_with_one(spark):
    df = spark.createDataFrame([(f"s{i % 7}", float(i)) for i in range(100)], "k string, v double")
    free = charts.funnel(df, "k", "v").orderBy("position").collect()
    held = charts.funnel(df, "k", "v", top_n=50).orderBy("position").collect()
    assert free == held
    assert free[0]["pct_of_first"] == 100.0


def test_funnel_of_zeros(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "k string, v double")
    rows = charts.funnel(df, "k", "v", top_n=5).collect()
    assert [(r["pct_of_first"], r["pct_of_prev"]) for r in rows] == [(0.0, 0.0), (0.0, 100.0)]


def test_grid_is_dense(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0), (None, "x", 3.0)], "k string, l string, v double")
    rows = charts.stacked(df, "k", "l", "v").collect()
    assert len(rows) == 6
    assert {(r["label"], r["series"]): r["value"] for r in rows}[("a", "y")] == 0.0
    heat = {(r["x"], r["y"]): r["intensity"] for r in charts.heatmap(df, "k", "l", "v").collect()}
    assert heat[(None, "x")] == 1.0 and heat[("b", "x")] == 0.0


def test_boxes_need_four_values(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(4)] + [("b", 1.0)], "k string, v double")
    assert [r["category"] for r in charts.box_plot(df, "v", "k").collect()] == ["a"]


def test_outlier_list_is_cut_to_the_smallest(spark):
    rows = [("a", float(i % 5)) for i in range(200)] + [("a", 1000.0 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = charts.box_outliers(df, "v", "k").orderBy("position").collect()
    assert [r["value"] for r in got] == [1000.0 + i for i in range(20)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    rows = charts.histogram(df, "v").collect()
    assert len(rows) == 6 and sum(r["count"] for r in rows) == 11
    assert rows[-1]["upper"] == 10.0 and rows[-1]["count"] == 2
    assert charts.histogram(df.withColumn("v", F.lit(3.0)), "v").collect() == []


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(12)], "a double, b double, c double")
    rows = charts.correlations(df, ["a", "b", "c"]).collect()
    assert [(r["x"], r["y"], r["pearson"], r["sample_size"]) for r in rows] == [("a", "b", 1.0, 12)]


def test_kpi_card_needs_four_dated_rows(spark):
    three = spark.createDataFrame([(i, float(i)) for i in range(3)], "id int, v double")
    row = charts.kpi_card(three, "v", ["id"]).first()
    assert row["prior_value"] is None and row["value"] == 3.0
    ten = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, v double").withColumn(
        "d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id"))
    )
    row = charts.kpi_card(ten, "v", ["d", "id"]).first()
    assert (row["value"], row["prior_value"], row["variance_pct"]) == (45.0, 10.0, 350.0)
    assert [r["value"] for r in charts.kpi_sparkline(ten, "v", ["d", "id"]).collect()] == [
        float(i) for i in range(10)
    ]


def test_gauge_share_is_of_everything(spark):
    df = spark.createDataFrame([(2.0,), (3.0,)], "v double")
    row = charts.gauge(df, "v", "pct").first()
    assert (row["value"], row["max"], row["pct"]) == (100.0, 100.0, 100.0)
    assert charts.gauge(df, "v", "median").first()["value"] == 2.5


def test_correlations_of_a_hundred_columns_in_one_pass(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(400, 100)) + 1e6
    values[:, 1] = 3 * values[:, 0] + rng.normal(size=400)
    values[rng.random(values.shape) < 0.2] = np.nan
    values[:, 7] = 4.25
    pdf = pd.DataFrame(values, columns=[f"c{i}" for i in range(100)])
    df = spark.createDataFrame(pdf).repartition(5)
    rows = {(r.x, r.y): r for r in charts.correlations(df, pdf.columns.tolist()).collect()}
    want, seen = pdf.corr(), pdf.notna().astype(int)
    assert len(rows) == 99 * 98 // 2 and not any("c7" in pair for pair in rows)
    for (x, y), r in rows.items():
        assert r.sample_size == (seen[x] * seen[y]).sum()
        assert r.pearson == pytest.approx(want.loc[x, y], abs=6e-5)
    text = charts.correlations(df, ["c0", "c1"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in text and "stack" not in text


def test_pair_moments_far_from_zero_and_empty(spark):
    df = spark.range(1000).select((F.col("id") + 10**12).cast("double").alias("a"), (F.col("id") * 2).alias("b"), F.lit(None).cast("double").alias("z"))
    assert [(r.x, r.y, r.pearson, r.sample_size) for r in charts.correlations(df, ["a", "b", "z"]).collect()] == [("a", "b", 1.0, 1000)]
    assert charts.correlations(df.limit(0), ["a", "b"]).collect() == []
    assert charts.correlations(df, ["a"]).collect() == []
