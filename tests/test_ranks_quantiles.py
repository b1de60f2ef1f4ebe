import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles
from tidemark.operators.ranks import number_rows, score_cuts


def test_positions_with_heavy_ties(spark):
    rows = [(1 if i % 3 else i % 7, i) for i in range(3000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "v long, id long").repartition(7)
    placed = number_rows(df, [F.desc("v"), F.asc("id")])
    got = {r["id"]: r["row_number"] for r in placed.collect()}
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert got == {key: i + 1 for i, (_, key) in enumerate(want)}
    assert {r["row_total"] for r in placed.collect()} == {3000}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_positions_of_few_rows(spark, n):
    df = spark.range(n).repartition(8)
    assert sorted(r["row_number"] for r in number_rows(df, ["id"]).collect()) == list(range(1, n + 1))


def test_nulls_come_first(spark):
    df = spark.createDataFrame([(None, 1), (5.0, 2), (None, 3)], "v double, id long")
    got = {r["id"]: r["row_number"] for r in number_rows(df, ["v", "id"]).collect()}
    assert got == {1: 1, 3: 2, 2: 3}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9, 11, 101])
def test_scores_are_equal_frequency_cuts(n):
    ranks = pd.Series(range(1, n + 1))
    want = list(pd.qcut(ranks, q=min(5, n), labels=False, duplicates="drop") + 1)
    assert [1 + sum(p > cut for cut in score_cuts(n)) for p in ranks] == want


def make_values(spark):
    rng = np.random.default_rng(3)
    parts = [
        ("wide", rng.normal(size=4000)),
        ("ties", rng.integers(0, 3, 3000).astype(float)),
        ("one", np.array([7.5])),
        ("two", np.array([1.0, 2.0])),
        (None, rng.exponential(size=500)),
    ]
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in parts])
    return pdf, spark.createDataFrame(
        [(g, float(v)) for g, v in zip(pdf["g"], pdf["v"])] + [("wide", None), ("gone", None)],
        "g string, v double",
    )


@pytest.mark.parametrize("bounded, cells, few", [(65_536, 65_536, True), (65_536, 65_536, False), (10, 8, True), (3, 2, False)])
def test_group_quantiles_are_exact(spark, monkeypatch, bounded, cells, few):
    """In one pass and in many, with cells as literals and as a written table."""
    monkeypatch.setattr(quantiles, "_BOUNDED", bounded)
    monkeypatch.setattr(quantiles, "_CELLS", cells)
    pdf, df = make_values(spark)
    wanted = {"a": 0.1, "q1": 0.25, "m": 0.5, "q3": 0.75}
    got = quantiles.grouped_quantiles(df, ["g"], F.col("v"), wanted, few_groups=few).collect()
    assert {r["g"] for r in got} == {"wide", "ties", "one", "two", None}
    for row in got:
        part = pdf[pdf["g"].isna() if row["g"] is None else pdf["g"] == row["g"]]["v"].to_numpy()
        assert row["n"] == len(part)
        assert (row["least"], row["most"]) == (part.min(), part.max())
        for name, p in wanted.items():
            assert row[name] == pytest.approx(np.quantile(part, p), abs=1e-12)


def test_overall_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert quantiles.grouped_quantiles(df, [], F.col("v"), {"m": 0.5}).collect() == []
