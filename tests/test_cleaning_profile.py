import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import date_grammar, text
from tidemark.operators import cleaning, insights, privacy, profile, quality, transforms
from tidemark.plans import report


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_names_collide_after_normalising():
    names = [" Order ID ", "order-id", "ORDER__ID", "??", "", "Total (₹)"]
    assert cleaning.normal_names(names) == [
        "order_id", "order_id_2", "order_id_3", "column", "column_2", "total",
    ]


def test_blank_tokens_are_case_sensitive(spark):
    got = one(spark, text.blank_to_null, " N/A ", "n/a", "N/a", "-", " x\t", "", None, "null ", "Null")
    assert got == [None, None, "N/a", None, "x", None, None, None, "Null"]


def test_numbers(spark):
    got = one(spark, text.to_number, "$1,200.50", "(50)", "12%", "₹ 7", "1e3", "10d", "abc", "(x)", "-.5", None)
    assert got == [1200.5, -50.0, 12.0, 7.0, 1000.0, None, None, None, -0.5, None]


def test_dates(spark):
    day = dt.datetime(2024, 2, 13)
    values = ["2024-02-13", "2024/2/13", "2/13/2024", "13/02/2024", "13 Feb 2024", "Feb 13, 2024",
              "February 13, 2024", "20240213", "2024-02-13T00:00:00"]
    assert one(spark, text.to_timestamp_mixed, *values) == [day] * len(values)
    assert one(spark, text.to_timestamp_mixed, "not-a-date", "2024-02-31", "12", "31/02/2024", None) == [None] * 5


def test_dates_as_people_type_them(spark):
    shapes = {
        "1/5/2024 9:30": (2024, 1, 5, 9, 30), "1/5/2024 9:30 AM": (2024, 1, 5, 9, 30), "1/5/2024 12:05 am": (2024, 1, 5, 0, 5),
        "1/5/2024 9:30PM": (2024, 1, 5, 21, 30), "01/05/24": (2024, 1, 5), "2024-01": (2024, 1, 1), "Jan 5 2024": (2024, 1, 5),
        "5.1.2024 9:30": (2024, 1, 5, 9, 30), "2024/1/5 9:30": (2024, 1, 5, 9, 30), "5-Jan-2024": (2024, 1, 5),
        "13-1-2024 9:30:00": (2024, 1, 13, 9, 30), "January 5, 2024 09:30": (2024, 1, 5, 9, 30), "Sept 3rd, 2024": (2024, 9, 3),
        "Fri, 5 Jan 2024 09:30:15": (2024, 1, 5, 9, 30, 15), "2024-Jan-05": (2024, 1, 5), "Jan 2024": (2024, 1, 1),
        "5.13.2024": (2024, 5, 13), "1/5/69": (1969, 1, 5), "2024-01-05 9:30 PM": (2024, 1, 5, 21, 30), "1/5/2024, 9 pm": (2024, 1, 5, 21),
        "JANUARY 5, 2024": (2024, 1, 5), "1/5/2024 23:59:59.25": (2024, 1, 5, 23, 59, 59, 250000),
    }
    assert one(spark, text.to_timestamp_mixed, *shapes) == [dt.datetime(*parts) for parts in shapes.values()]
    bad = ["13/13/2024", "Jan 32 2024", "1/5/2024 25:00", "1/5/2024 13:00 PM", "1/5/2024 0:10 AM", "Janet 5 2024", "5 2024", "1/5-2024",
           "12:30", "on 5", "1/5/2024 9:60", "Feb 30, 2024", "", " "]
    assert one(spark, text.to_timestamp_mixed, *bad) == [None] * len(bad)


def test_the_order_of_day_and_month_comes_from_the_column(spark):
    rows = [("3/4/2024", "3/4/2024", "3/4/2024", "x"), ("25/4/2024", "4/25/2024", "5/4/2024", None), (None, "1/1/2024", "4/4/2024", "y")]
    df = spark.createDataFrame(rows, "eu string, us string, open string, words string")
    orders = {r["column"]: r for r in date_grammar.date_order(df, df.columns).collect()}
    assert [orders[c]["date_order"] for c in df.columns] == ["day first", "month first", "ambiguous", "clear"]
    assert orders["open"].asDict() == {"column": "open", "filled": 3, "parsed": 3, "day_first": 0, "month_first": 0, "either": 2, "date_order": "ambiguous"}
    first = date_grammar.with_dates(df, ["eu", "us", "open"]).first()
    assert (first["eu"].month, first["us"].month, first["open"].month, first["words"]) == (4, 3, 3, "x")
    shapes = {r["shape"]: r["values"] for r in date_grammar.date_shapes(df, "eu").collect()}
    assert shapes == {"9/9/9999": 1, "99/9/9999": 1}
    assert date_grammar.date_order(df.limit(0), ["eu"]).first()["date_order"] == "clear"


def test_booleans_and_masks(spark):
    assert one(spark, text.to_boolean, " YES", "0", "maybe", None) == [True, False, None, None]
    assert one(spark, text.mask_email, "alice@x.org", "al@x.org", "nobody", None) == [
        "al***@x.org", "al**@x.org", "n***", None,
    ]
    assert one(spark, text.mask_phone, "+1 555-010-1234", "12", "none") == ["*******1234", "12", "***"]
    assert one(spark, text.escape_formula, "=1+1", "  @x", "plain", "-5") == ["'=1+1", "'  @x", "plain", "'-5"]


def test_duplicates_treat_null_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (None, None), (None, None), (None, None)], "a int, b string")
    row = cleaning.duplicate_rows(df).first()
    assert (row["rows"], row["duplicate_rows"], row["duplicate_pct"]) == (6, 3, 50.0)
    assert cleaning.duplicate_rows(df.limit(0)).first()["duplicate_rows"] == 0


KINDS = {"email": "email", "mobile": "phone", "metric": "numeric"}


@pytest.fixture()
def small(spark):
    rows = [("a@x.io", "5550101", "1"), ("bad", "123", "2"), (None, "5550103", "3"),
            ("a@x.io", "5550101", "1"), ("c@x.io", "5550105", "100")]
    return spark.createDataFrame(rows, "email string, mobile string, metric string")


def test_quality_of_the_small_table(small):
    row = quality.quality_report(small, KINDS).first()
    assert (row["missing_values"], row["duplicate_rows"], row["invalid_values"]) == (1, 1, 2)
    parts = ["completeness", "uniqueness", "validity", "consistency", "type_correctness"]
    assert row["overall_score"] == pytest.approx(sum(row[p] for p in parts) / 5, abs=0.05)


def test_all_values_invalid_keeps_scores_in_range(spark):
    df = spark.createDataFrame([("nope", "x"), ("never", "y")], "created string, revenue string")
    row = quality.quality_report(df, {"created": "datetime", "revenue": "currency"}).first()
    assert row["invalid_values"] == 4
    for part in ["completeness", "validity", "consistency", "type_correctness", "overall_score"]:
        assert 0 <= row[part] <= 100


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert quality.quality_report(df, {"a": "text", "b": "numeric"}).first()["rows"] == 0
    assert [r["missing_pct"] for r in quality.missing_by_column(df).collect()] == [0.0, 0.0]
    assert insights.insight_missing(quality.null_counts(df)).collect() == []
    assert profile.numeric_stats(df, ["b"]).collect() == []


def test_classifier_reads_content(spark):
    rows = [(f"u{i}@mail.com", f"+1 555 010 {1000 + i}", f"2024-01-{i + 1:02d}", f"{i}.5", "yes", f"free text {i}", "red", None)
            for i in range(20)]
    df = spark.createDataFrame(rows, "contact_info string, reach_me string, w string, m string, b string, t string, c string, e string")
    kinds = profile.column_kinds(df.withColumnRenamed("contact_info", "info"))
    assert kinds == {"info": "email", "reach_me": "phone", "w": "datetime", "m": "numeric",
                     "b": "boolean", "t": "text", "c": "category", "e": "unknown"}


def test_names_decide_first():
    assert profile.name_semantics("Order Count") == ("numeric", 0.84)
    assert profile.name_semantics("total_revenue") == ("currency", 0.96)
    assert profile.name_semantics("home_phone_2") == ("phone", 0.9)
    assert profile.name_semantics("ship_state") == ("region", 0.84)
    assert profile.name_semantics("has_car") == ("boolean", 0.78)
    assert profile.name_semantics("zzz") == (None, 0.0)


def test_long_values_are_keyed_by_hash_and_still_judged(spark):
    long_mail = "x" * 200 + "@mail.com"
    df = spark.createDataFrame([(long_mail,), (long_mail,), ("y" * 300,)], "v string")
    facts = profile.classify_columns(df).first()
    assert facts["unique_count"] == 2 and facts["semantic_type"] == "category"
    assert profile.classify_columns(df.limit(2)).first()["semantic_type"] == "email"


def test_stats_of_one_row_and_a_constant(spark):
    df = spark.createDataFrame([(4.0, 1.0)], "a double, b double").unionByName(
        spark.createDataFrame([(None, 1.0), (float("nan"), 1.0)], "a double, b double"))
    rows = {r["column"]: r for r in profile.numeric_stats(df, ["a", "b"]).collect()}
    assert (rows["a"]["count"], rows["a"]["std"], rows["a"]["median"]) == (1, 0.0, 4.0)
    assert (rows["b"]["count"], rows["b"]["outlier_count"]) == (3, 0)


@pytest.mark.parametrize("names, label", [
    (["employee_id", "salary"], "HR / Workforce"), (["patient_id", "treatment"], "Healthcare"),
    (["order_id", "customer_id", "product"], "E-commerce"), (["income", "account"], "Finance"),
    (["sku", "warehouse"], "Inventory / Operations"), (["a"], "General Dataset"),
])
def test_domains(names, label):
    kinds = {n: profile.name_semantics(n)[0] or "text" for n in names}
    assert profile.domain_of(kinds)[0] == label


def test_header_tokens_are_whole_words():
    assert privacy.header_finding("company") is None
    assert privacy.header_finding("PAN") is not None
    assert privacy.header_finding("Work E-Mail")[0] == "Direct PII (Email)"


def test_content_beats_header_only_when_critical(spark):
    df = spark.createDataFrame([("ssn 123-45-6789", "call 555-123-4567")], "mobile string, note string")
    rows = privacy.pii_findings(privacy.pii_headers(df), privacy.pii_content(df, df.columns)).collect()
    found = {r["column"]: (r["category"], r["severity"]) for r in rows}
    assert found["note"] == ("Direct PII", "High")
    assert found["mobile"] == ("National Identifier", "Critical")


def test_null_rules_of_filters(spark):
    df = spark.createDataFrame([("a",), ("B",), (None,)], "v string")

    def kept(op, value):
        return [r[0] for r in transforms.filter_rows(df, "v", op, value).collect()]

    assert kept("ne", "a") == ["B", None]
    assert kept("not_contains", "b") == ["a", None]
    assert kept("contains", "b") == ["B"]
    assert kept("gt", 0) == []


def test_filling(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (2.005, None), (None, None)], "n double, s string")
    fill = transforms.handle_missing
    assert [r["n"] for r in fill(df, "n", "mean").collect()] == [1.0, 1.5, 2.005, 1.5]
    assert [r["s"] for r in fill(df, "s", "mode").collect()] == ["b", "a", "a", "a"]
    empty = df.select(F.lit(None).cast("double").alias("n"), F.lit(None).cast("string").alias("s"))
    assert {r["n"] for r in fill(empty, "n", "median").collect()} == {0.0}
    assert {r["s"] for r in fill(empty, "s", "mode").collect()} == {"Unknown"}


def test_first_of_duplicates(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 4, "w")], "k string, t int, v string")
    got = transforms.remove_duplicates(df, ["k"], ["t"]).collect()
    assert sorted((r["t"], r["v"]) for r in got) == [(1, "y"), (4, "w")]
    assert got[0].asDict().keys() == {"k", "t", "v"}


def test_calculations_with_zero_and_null(spark):
    df = spark.createDataFrame([(6.0, 0.0), (None, 3.0), (6.0, 4.0)], "a double, b double")

    def run(op, **kw):
        return [r["c"] for r in transforms.calculated_column(df, "c", "a", op, **kw).collect()]

    assert run("/", right="b") == [0.0, 0.0, 1.5]
    assert run("%", right="b") == [0.0, 0.0, 150.0]
    assert run("/", value=0) == [0.0, 0.0, 0.0]
    assert run("-", value=1) == [5.0, -1.0, 5.0]


def test_a_failing_step_is_noted_and_the_rest_go_on(spark):
    df = spark.createDataFrame([("x", 40.0), ("y", 20.0), ("x", None)], "department string, salary double")
    ops = [
        {"type": "rename_column", "old_name": "department", "new_name": "team"},
        {"type": "filter_rows", "column": "salary", "operator": "gt", "value": "lots"},
        {"type": "filter_rows", "column": "salary", "operator": "gt", "value": 30},
        {"type": "convert_type", "column": "gone"},
        {"type": "remove_duplicates", "subset": ["team"]},
        {"type": "calculated_column", "new_column": "bonus", "col1": "salary", "operator": "*", "value": 0.1},
    ]
    assert transforms.apply_recipe(df, ops).columns == ["team", "salary", "bonus"]
    audit = transforms.pipeline_audit(df, ops).orderBy("step").collect()
    assert [(r["step"], r["status"], r["affected"]) for r in audit] == [
        (1, "success", 0), (2, "error", 0), (3, "success", 2), (5, "error", 0), (6, "success", 0),
    ]


def test_clean_table_end_to_end(spark):
    df = spark.createDataFrame(
        [("1", " Ann ", "2024-01-05", "$1,200.50", "Yes"), ("2", "N/A", "invalid-date", "(50)", "no")],
        "ID string, ` Name ` string, `Created Date` string, Price string, `Is Active` string",
    )
    clean, kinds = report.clean_table(df)
    assert kinds == {"id": "identifier", "name": "person", "created_date": "datetime",
                     "price": "currency", "is_active": "boolean"}
    rows = clean.orderBy("id").collect()
    assert rows[0].asDict() == {"id": "1", "name": "Ann", "created_date": dt.datetime(2024, 1, 5), "price": 1200.5, "is_active": True}
    assert rows[1].asDict() == {"id": "2", "name": None, "created_date": None, "price": -50.0, "is_active": False}


def test_long_texts_show_their_start(spark):
    long = ["x" * 100 + "a" * 50, "x" * 100 + "b" * 50]
    df = spark.createDataFrame([(long[0],), (long[1],), (long[1],), ("short",)], "category string")
    row = profile.column_profile(df).first()
    assert row["samples"] == " | ".join(["short", "x" * 80, "x" * 80])  # masks keep 80 characters
    labels = [(r["label"], r["value"]) for r in profile.dimensions(df, {"category": "category"}).orderBy("place").collect()]
    assert labels[0][1] == 2 and len({label for label, _ in labels}) == 3
    assert all(len(label) in (5, 91) for label, _ in labels)
