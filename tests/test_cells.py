"""Reports read from one histogram of the cells against the reports of the table itself."""

import pytest

from tidemark.operators import cells, cleaning, profile, quality

KINDS = {"email": "email", "price": "currency", "day": "datetime", "note": "text", "count": "numeric", "flag": "boolean"}
LONG = "a very long note " * 20
ROWS = [
    ("a@x.org", " $1,200.50", "2024-01-05", LONG, 3, "yes"), ("a@x.org ", "(50)", "5 Jan 2024", LONG + " ", 3, "no"),
    ("bad", "oops", "not-a-date", "n/a", None, "maybe"), (None, "--", None, " ", 7, None), ("b@x.org", "12", "2024-02-30", "x", 900, "Yes"),
    ("a@x.org", " $1,200.50", "2024-01-05", LONG, 3, "yes"), ("c@x.org", "13", "1/5/24", "X", 4, "0"), ("d@x.org", "14", "1/5/24", "y", 5, "1"),
]


@pytest.fixture()
def raw(spark):
    return spark.createDataFrame(ROWS, "email string, price string, day string, note string, count int, flag string")


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


def test_reports_from_the_histogram(raw):
    counted = cells.written_cells(raw, KINDS)
    assert rows(cells.diff_of(counted)) == rows(cleaning.cleaning_diff(raw, KINDS))
    trimmed = cleaning.trim_nulls(raw)
    clean = cleaning.coerce(trimmed, KINDS)
    assert rows(cells.null_counts_of(counted)) == rows(quality.null_counts(clean))
    assert rows(cells.numeric_stats_of(counted)) == rows(profile.numeric_stats(clean, ["price", "count"]))
    values = profile.value_histogram(trimmed)
    assert rows(cells.histogram_of(counted)) == rows(values.groupBy("column", "value").agg({"hits": "sum"}).toDF("column", "value", "hits"))
    assert rows(cleaning.duplicate_ids(cells.histogram_of(counted), ["email"])) == rows(cleaning.duplicate_ids(values, ["email"]))
    got = cells.schema_health_of(counted.where("column <> 'count'"), raw.columns).first()
    assert got["mixed_columns"] == quality.schema_health(trimmed).first()["mixed_columns"]


def test_no_rows(raw):
    counted = cells.written_cells(raw.limit(0), KINDS)
    assert cells.diff_of(counted).count() == cells.numeric_stats_of(counted).count() == 0
    assert cells.schema_health_of(counted, raw.columns).first()["mixed_columns"] == 0


def test_duplicate_rows_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, None), (None, None), (0, 0), (None, None)], "a long, b long")
    row = cleaning.duplicate_rows(df).first()
    assert (row["rows"], row["duplicate_rows"]) == (6, 2)
    assert cleaning.duplicate_rows(spark.createDataFrame([(0.0, "x"), (-0.0, "x"), (float("nan"), ""), (float("nan"), "")], "a double, b string")).first()["duplicate_rows"] == 2
