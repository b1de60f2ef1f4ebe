"""Profiles from sketches: halves put together against the whole, and both against exact values."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import sketches


def test_two_halves_make_the_whole(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"v": rng.normal(size=20_000) * 100, "k": rng.integers(0, 5000, 20_000), "t": [f"t{i % 7}" for i in range(20_000)]})
    pdf.loc[::10, "v"] = np.nan
    df = spark.createDataFrame(pdf.astype({"v": object}).where(pdf.notna(), None), "v double, k long, t string")
    half = F.col("k") < 2500
    whole = {r["column"]: r for r in sketches.sketch_report(sketches.column_sketches(df)).collect()}
    parts = sketches.merged(sketches.column_sketches(df.where(half)), sketches.column_sketches(df.where(~half)))
    got = {r["column"]: r for r in sketches.sketch_report(parts).collect()}
    assert set(got) == {"v", "k", "t"}
    values = np.sort(pdf["v"].dropna().to_numpy())
    for found in (whole, got):
        assert (found["v"]["rows"], found["v"]["missing"], found["t"]["distinct"]) == (20_000, 2000, 7)
        assert abs(found["k"]["distinct"] / pdf["k"].nunique() - 1) < 0.05
        assert (found["v"]["min"], found["v"]["max"]) == (values[0], values[-1])
        assert found["v"]["mean"] == round(values.mean(), 4)
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert abs(np.searchsorted(values, found["v"][name]) / len(values) - p) < 0.02
    assert got["t"]["median"] is None and got["t"]["mean"] is None


def test_new_columns_and_empty_tables(spark):
    old = sketches.column_sketches(spark.createDataFrame([(1, None)], "a int, b string"))
    new = sketches.column_sketches(spark.createDataFrame([(2, 0.5)], "a int, c double"))
    rows = {r["column"]: r for r in sketches.sketch_report(sketches.merged(old, new)).collect()}
    assert {c: (r["rows"], r["missing"], r["distinct"], r["max"]) for c, r in rows.items()} == {
        "a": (2, 0, 2, 2.0), "b": (1, 1, 0, None), "c": (1, 0, 1, 0.5)}
    empty = sketches.column_sketches(spark.createDataFrame([], "a int"))
    assert sketches.sketch_report(sketches.merged(old, empty)).count() == 2
