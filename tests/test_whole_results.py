"""Results that were cut: every category, spelling, long value and column counts."""

from tidemark.operators import cleaning, kpis, profile
from tidemark.plans import report


def test_categories_of_many_values_are_counted(spark):
    df = spark.createDataFrame([(f"c{i}",) for i in range(150)], "category string")
    assert [r["value"] for r in kpis.kpi_distinct(df, {"category": "category"}).collect()] == [150]


def test_every_spelling_and_long_values(spark):
    short = ["".join(c.upper() if i >> k & 1 else c for k, c in enumerate("abcd")) for i in range(16)]
    long = ["word " * 40 + "END", "word " * 40 + "end"]
    df = spark.createDataFrame([(v,) for v in short + long + ["x", " " * 140, " " * 141]], "k string")
    counts = profile.value_histogram(df)
    rows = cleaning.case_spellings(counts).collect()
    assert sorted(r["value"] for r in rows if r["normalized"] == "abcd") == sorted(short) and len(rows) == 18
    assert sorted(r["spellings"] for r in cleaning.case_variants(counts).collect()) == [2, 16]


def test_dates_and_phones_in_long_values(spark):
    pad = " " * 130
    rows = [(f"2024-01-{i:02d}" + pad, f"+49 30 1234567{i:02d}" + pad, "true" + pad) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert profile.column_kinds(df) == {"a": "datetime", "b": "phone", "c": "boolean"}


def test_every_qualifying_column_is_charted(spark):
    numbers, groups = [f"n{i}" for i in range(8)], [f"g{i}" for i in range(4)]
    rows = [tuple(float(i * k % 11) for k in range(1, 9)) + tuple(str(i % 3) for _ in groups) + (i,) for i in range(40)]
    df = spark.createDataFrame(rows, [*numbers, *groups, "key"])
    kinds = dict.fromkeys(numbers, "numeric") | dict.fromkeys(groups, "category")
    parts = {r[0] for r in report.auto_charts(df, kinds, dict.fromkeys(groups, 3), "key").select("chart_id").distinct().collect()}
    assert parts >= {f"hist_{c}" for c in numbers} | {f"pie_{c}" for c in groups} | {f"avg_{c}_n0" for c in groups}
