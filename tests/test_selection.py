"""Positions found by counting against a sort."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection
from tidemark.operators.selection import rows_after


def placed(spark, df, order, positions, key="id"):
    """For each position the keys of the rows that come after it."""
    total, found = rows_after(df, {"o": order}, lambda n: positions)
    rows = df.select(key, *[c.alias(f"p{i}") for i, c in enumerate(found["o"])]).collect()
    return total, [{r[key] for r in rows if r[f"p{i}"]} for i in range(len(positions))]


def sort_key(value, descending):
    """Spark's order: nulls first, or last if descending; NaN is the largest number."""
    nan = isinstance(value, float) and math.isnan(value)
    if value is None:
        return (1 if descending else -1, 0)
    number = (1, 0) if nan else (0, value)
    return (0, Reverse(number) if descending else number)


class Reverse:
    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return self.value == other.value


KINDS = {
    "long": lambda r: r.choice([0, 1, -1, 2**62, -(2**62), 7, r.randint(-1000, 1000), r.randint(-(10**15), 10**15)]),
    "double": lambda r: r.choice([0.0, -0.0, math.inf, -math.inf, math.nan, 1e-300, r.random(), -r.random() * 1e9, 3.5]),
    "string": lambda r: r.choice(["", "a", "Customer#00017", f"Customer#{r.randint(0, 400):05d}", "é" * r.randint(0, 3), "中", "zz\\x00"]),
    "date": lambda r: dt.date(2024, 1, 1) + dt.timedelta(days=r.randint(-20000, 400)),
    "timestamp_ntz": lambda r: dt.datetime(1969, 12, 31) + dt.timedelta(microseconds=r.randint(0, 10**15)),
    "decimal(12,2)": lambda r: __import__("decimal").Decimal(r.randint(-(10**6), 10**6)) / 100,
    "boolean": lambda r: r.random() < 0.5,
}


@pytest.mark.parametrize("bounded", [4096, 20])
@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("descending", [False, True])
def test_positions_of_every_kind(spark, monkeypatch, kind, descending, bounded):
    monkeypatch.setattr(selection, "_BOUNDED", bounded)
    monkeypatch.setattr(selection, "FINER_CELLS", 16)
    rng = random.Random(f"{kind}{descending}")
    rows = [(i, None if rng.random() < 0.1 else KINDS[kind](rng)) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"id long, k {kind}").repartition(3)
    order = sorted(rows, key=lambda r: (*sort_key(r[1], descending), r[0]))
    wanted = [0, 1, 2, 60, 150, 299, 300, 999]
    total, after = placed(spark, df, [("k", descending), "id"], wanted)
    assert total == 300
    assert after == [{r[0] for r in order[p:]} for p in wanted]


def test_a_third_on_one_value_is_cut_by_the_later_keys(spark, monkeypatch):
    monkeypatch.setattr(selection, "_BOUNDED", 50)
    rng = random.Random(3)
    rows = [(i, "2024-03-01" if i % 3 else f"2024-{1 + i % 12:02d}-02", f"K{rng.randint(0, 9)}") for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, d string, k string").withColumn("d", F.to_date("d"))
    order = sorted(rows, key=lambda r: (r[1], Reverse(r[2]), r[0]))
    wanted = [600, 2999, 3000, 5400]
    total, after = placed(spark, df, ["d", ("k", True), "id"], wanted)
    assert after == [{r[0] for r in order[p:]} for p in wanted]


def test_several_orders_share_the_passes(spark):
    df = spark.range(10_000).select("id", (F.col("id") * 7919 % 10_007).alias("a"), (F.col("id") % 3).alias("b"))
    rows = [tuple(r) for r in df.collect()]
    total, found = rows_after(df, {"a": ["a"], "b": [("b", True), "a"]}, lambda n: [n // 2, n - 1])
    got = df.select("id", found["a"][0].alias("x"), found["b"][0].alias("y"), found["b"][1].alias("z")).collect()
    by_a = sorted(rows, key=lambda r: r[1])
    by_b = sorted(rows, key=lambda r: (-r[2], r[1]))
    assert {r.id for r in got if r.x} == {r[0] for r in by_a[5000:]}
    assert {r.id for r in got if r.y} == {r[0] for r in by_b[5000:]}
    assert {r.id for r in got if r.z} == {by_b[-1][0]}


def test_equal_rows_stay_on_one_side(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (2,), (3,)], "k long")
    _, found = rows_after(df, {"o": ["k"]}, lambda n: [3])
    assert sorted((r.k, r.a) for r in df.select("k", found["o"][0].alias("a")).collect()) == [
        (1, False), (2, False), (2, False), (2, False), (3, True)]


def test_no_rows(spark):
    df = spark.createDataFrame([], "k long")
    total, found = rows_after(df, {"o": ["k"]}, lambda n: [0, 1])
    assert total == 0 and df.where(found["o"][0] | found["o"][1]).count() == 0
