import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomalies, forecast, growth, insights, kpis, series, templates

DAY = dt.date(2024, 1, 1)


def sales(spark, rows):
    return spark.createDataFrame(rows, "who string, day date, amount double")


def test_one_customer(spark):
    df = sales(spark, [("a", DAY, 10.0), ("a", dt.date(2024, 2, 1), 20.0)])
    row = growth.rfm_segments(growth.rfm_scores(df, "who", "day", "amount")).first()
    assert (row["recency_days"], row["frequency"], row["monetary"], row["rfm_score"]) == (1, 2, 30.0, "111")
    assert row["segment"] == "Hibernating"
    assert growth.clv_summary(growth.clv_churn(df, "who", "day", "amount")).first()["whale_share_pct"] == 100.0


def test_no_customers(spark):
    df = sales(spark, [])
    assert growth.rfm_scores(df, "who", "day", "amount").collect() == []
    assert growth.clv_summary(growth.clv_churn(df, "who", "day", "amount")).collect() == []


def test_segment_ladder_covers_all_scores(spark):
    grid = spark.range(125).select(
        (F.col("id") % 5 + 1).alias("r"), (F.floor(F.col("id") / 5) % 5 + 1).alias("f"),
        (F.floor(F.col("id") / 25) + 1).alias("m"),
    )
    named = grid.select("*", growth.segment_of(F.col("r"), F.col("f"), F.col("m")).alias("s")).collect()
    found = {(r["r"], r["f"], r["m"]): r["s"] for r in named}
    assert found[(5, 5, 5)] == "Champions" and found[(5, 1, 1)] == "New Customers"
    assert found[(1, 5, 1)] == "At Risk" and found[(1, 1, 5)] == "Can't Lose Them"
    assert None not in found.values()


def test_cohort_month_with_nobody_is_null(spark):
    df = sales(spark, [("a", DAY, 1.0), ("b", DAY, 1.0), ("a", dt.date(2024, 3, 9), 1.0)])
    wide = growth.cohort_table(growth.cohort_matrix(growth.cohort_counts(df, "who", "day"))).first()
    assert (wide["m0"], wide["m1"], wide["m2"]) == (100.0, None, 50.0)


def test_roles(spark):
    df = spark.createDataFrame([], "total string, order_date date, customer_id long, revenue double, qty int")
    assert growth.detect_roles(df) == {
        "customer": "customer_id", "date": "order_date", "monetary": "revenue", "quantity": "qty",
        "category": None,
    }


def holt(y):
    level, trend = y[0], y[1] - y[0]
    for value in y[1:]:
        new = 0.4 * value + 0.6 * (level + trend)
        level, trend = new, 0.2 * (new - level) + 0.8 * trend
    return level, trend


def line(spark, values, key="k"):
    rows = [(key, "month", dt.date(2020 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "s string, grain string, period date, value double")


def test_fits_match_plain_loops(spark):
    y = [3, 5, 4, 8, 9, 7, 12, 11, 15, 13]
    both = line(spark, y).unionByName(line(spark, [2, 2, 2], "flat"))
    fits = {r["s"]: r for r in forecast.fit_holt(both, ["s"]).collect()}
    assert (fits["k"]["level"], fits["k"]["trend"]) == pytest.approx(holt(y))
    assert (fits["flat"]["level"], fits["flat"]["trend"]) == (2.0, 0.0)
    assert {r["s"]: r["flat"] for r in forecast.fit_wma(both, ["s"]).collect()}["k"] == pytest.approx(
        (11 + 2 * 15 + 3 * 13) / 6
    )
    ols = {r["s"]: r for r in forecast.fit_ols(both, ["s"]).collect()}["k"]
    n, mx, my = len(y), (len(y) - 1) / 2, sum(y) / len(y)
    slope = sum((i - mx) * (v - my) for i, v in enumerate(y)) / sum((i - mx) ** 2 for i in range(n))
    assert ols["slope"] == pytest.approx(slope)
    gaps = [v - (my + slope * (i - mx)) for i, v in enumerate(y)]
    assert ols["residual_std"] == pytest.approx(math.sqrt(sum(g * g for g in gaps) / n))


def test_two_periods_are_not_enough(spark):
    assert forecast.forecast(line(spark, [1, 2]), ["s"]).collect() == []


def test_flat_series_ties_go_to_holt_and_zero_actuals_give_no_mape(spark):
    rows = forecast.backtest(line(spark, [0, 0, 0, 0, 0, 0]), ["s"]).orderBy("rank").collect()
    assert rows[0]["model"].startswith("Holt") and rows[0]["mape"] == 0.0


def test_forecast_never_goes_below_zero_and_steps_by_month(spark):
    rows = forecast.forecast(line(spark, [50, 40, 30, 20, 10]), ["s"]).orderBy("step").collect()
    assert [r["period"] for r in rows][0] == dt.date(2020, 6, 1) and rows[-1]["period"] == dt.date(2020, 9, 1)
    assert all(r["value"] >= 0 and r["lower"] >= 0 for r in rows) and rows[-1]["value"] == 0.0


def test_rolling_band(spark):
    rows = anomalies.rolling_anomalies(line(spark, [10, 12, 11, 13, 40, 12]), ["s"]).collect()
    spike = [r for r in rows if r["observed"] == 40.0][0]
    mean = (10 + 12 + 11 + 13) / 4
    assert spike["direction"] == "spike" and spike["baseline_mean"] == mean
    assert spike["deviation_pct"] == pytest.approx((40 - mean) / mean * 100, abs=0.05)
    assert spike["neighbours"] == [11.0, 13.0, 40.0, 12.0]
    assert anomalies.rolling_anomalies(line(spark, [1, 2, 90]), ["s"]).collect() == []


def test_column_fences_need_four_distinct_values(spark):
    rows = [(1.0,)] * 5 + [(2.0,)] * 5 + [(90.0,)]
    df = spark.createDataFrame(rows, "v double")
    assert anomalies.iqr_anomalies(df, ["v"]).collect() == []
    more = df.unionByName(spark.createDataFrame([(1.5,)], "v double"))
    assert anomalies.iqr_anomalies(more, ["v"]).first()["observed"] == 90.0


def test_overlapping_rules_each_report_the_first_hit(spark):
    rows = [(0, "Total Revenue", 10.0, "currency", ""), (1, "Total Profit", 20.0, "currency", "")]
    numbers = spark.createDataFrame(rows, "position int, label string, value double, format string, calculation string")
    rules = spark.createDataFrame(
        [(1, "a", "threshold", "total", "gt", 5.0, "low"), (2, "b", "threshold", "TOTAL", "gt", 15.0, "low"),
         (3, "c", "anomaly", "x", None, None, "high")],
        "rule_id int, name string, alert_type string, metric string, condition string, threshold double, severity string",
    )
    none = spark.createDataFrame([], "severity string")
    fired = {r["rule_id"]: r["label"] for r in anomalies.evaluate_rules(numbers, rules, none).collect()}
    assert fired == {1: "Total Revenue", 2: "Total Profit"}


def test_series_grain_and_gaps(spark):
    df = sales(spark, [("a", DAY, 1.0), ("a", dt.date(2024, 1, 3), 2.0), ("a", DAY, None)])
    rows = series.time_series(df, "day", "amount").orderBy("period").collect()
    assert [(r["grain"], r["period"].day, r["value"]) for r in rows] == [("day", 1, 1.0), ("day", 3, 2.0)]
    assert insights.insight_growth(series.time_series(df, "day", "amount")).count() == 2


def test_last_two_periods_of_one(spark):
    df = sales(spark, [("a", DAY, 1.0)])
    assert series.last_two(series.time_series(df, "day", "amount")).collect() == []
    rows = kpis.kpi_revenue(df, "amount", series=series.time_series(df, "day", "amount")).collect()
    assert [r["label"] for r in rows] == ["Total Revenue"]


def test_known_shop_values(spark):
    """Prices and quantities of a small shop, whose revenue is known to be 1023.5."""
    lines = [
        (48.0, 2), (8.5, 4), (48.0, 1), (72.0, 1), (8.5, 6), (64.0, 2), (64.0, 1), (72.0, 2),
        (48.0, 3), (8.5, 5), (64.0, 2), (72.0, 1),
    ]
    df = spark.createDataFrame(lines, "price double, quantity int")
    from tidemark.operators import cleaning

    kinds = {"price": "currency", "quantity": "numeric"}
    assert cleaning.derived_revenue(df, kinds).agg(F.sum("revenue")).first()[0] == 1023.5


def test_rates(spark):
    outcomes = ["Recovered", "improved ", "Stable", "RECOVERED", None, "Stable"]
    df = spark.createDataFrame([(o,) for o in outcomes], "outcome string")
    assert kpis.kpi_rates(df, outcome="outcome").first()["value"] == 60.0


def test_sql_cap(spark):
    df = spark.range(2000)
    assert templates.capped_sql(df, "SELECT * FROM dataset", 500).count() == 500
    assert templates.capped_sql(df, "SELECT * FROM dataset LIMIT 700").count() == 700
    assert templates.capped_sql(df, "SELECT * FROM dataset LIMIT 5000;").count() == df.count()
    assert templates.capped_sql(df, "SELECT 'the dataset {x}' AS c FROM dataset").first()["c"] == "the dataset {x}"
    for command in ("SET spark.zzz.abc=1", "DROP TABLE dataset", "SELECT 1; SELECT 2"):
        with pytest.raises(Exception):
            templates.capped_sql(df, command)
