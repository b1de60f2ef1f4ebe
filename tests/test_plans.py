"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import charts, filters, quantiles, transforms
from tidemark.plans.tables import Tables

CHART_QUERIES = [
    "group_measure", "date_bucket_auto", "drill_rollup", "combo", "treemap", "histogram", "scatter",
    "gauge", "group_counts", "group_sums", "metric_by_dimension", "correlations", "time_series",
    "top_by_sum", "value_share", "cohort_counts", "clv_churn", "unit_economics", "pii_content",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ran(df):
    """The final plan, after adaptive execution."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", CHART_QUERIES)
def test_rows_are_never_windowed_in_one_task_or_sent_to_python(spark, folder, name):
    text = plan(entry.queries()[name](spark, folder))
    assert "CartesianProduct" not in text and "InPandas" not in text and "ArrowEval" not in text
    for line in text.splitlines():
        if re.search(r"\bWindow \[", line):
            assert re.search(r"\], \[\w+#\d+", line), line


def test_filters_reach_the_scan(spark, folder):
    orders = Tables(spark, folder).orders
    kept = filters.slice_filter(orders, [
        {"column": "o_orderdate", "operator": "date_range", "value": ["1996-01-01", "1996-12-31"]},
        {"column": "o_totalprice", "operator": "gte", "value": 1000},
        {"column": "o_orderstatus", "operator": "in", "value": ["F"]},
    ])
    metadata = kept._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = next(l for l in metadata.splitlines() if l.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in pushed
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThanOrEqual(o_orderdate" in pushed


def test_only_needed_columns_are_read(spark, folder):
    text = plan(charts.group_measure(Tables(spark, folder).lineitem, "l_returnflag", "l_quantity"))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert schema == "l_quantity:double,l_returnflag:string"


def test_totals_and_grids_reuse_one_shuffle(spark, folder):
    orders = Tables(spark, folder).orders
    bars = ran(charts.group_measure(orders, "o_orderpriority", "o_totalprice"))
    assert bars.count("FileScan") == 1
    grid = ran(charts.dense_grid(orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "sum", 8, 8))
    assert grid.count("FileScan") == 1


def test_first_of_duplicates_folds_before_the_shuffle(spark, folder):
    text = plan(transforms.remove_duplicates(Tables(spark, folder).orders, ["o_custkey"], ["o_orderkey"]))
    assert text.count("partial_min") == 1 and "Window" not in text


def test_the_last_quantile_pass_counts_few_rows(spark, monkeypatch):
    """Cells of a continuous column are cut until few rows are counted one by one, at any size."""
    monkeypatch.setattr(quantiles, "_BOUNDED", 500)
    monkeypatch.setattr(quantiles, "_CELLS", 4)
    seen, keep = [], quantiles._as_local

    def watched(state, ranks):
        kept = keep(state, ranks)
        seen.append(kept[1])
        return kept

    monkeypatch.setattr(quantiles, "_as_local", watched)
    df = spark.range(200_000).select((1e6 + F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    got = quantiles.grouped_quantiles(df, [], F.col("v"), {"m": 0.5})
    assert got.first()["m"] == df.selectExpr("percentile(v, 0.5)").first()[0]
    assert len(seen) >= 4 and seen == sorted(seen, reverse=True) and seen[-2] <= 500 and seen[-1] == 0


def test_a_column_of_few_values_needs_one_pass(spark):
    df = spark.range(10_000).select((F.col("id") % 50).cast("double").alias("v"))
    got = quantiles.grouped_quantiles(df, [], F.col("v"), {"q1": 0.25, "m": 0.5})
    assert "Exchange" not in plan(got) and tuple(got.first())[3:] == (12.0, 24.5)
