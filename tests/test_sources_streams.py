import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.session import literal_rows
from tidemark.sources import browse, delimited, records, sinks
from tidemark.streaming import windows


def write(folder, name, data: bytes):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder)


def test_dialects_of_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", "name,city\nAnn,\"x;y;z\"\n".encode())
    write(folder, "b.csv", "name;city\nJosé;Köln\n".encode("cp1252"))
    write(folder, "c.csv", b"\xef\xbb\xbfname\tcity\nA\tB\n")
    write(folder, "d.csv", b"name|city\nA\x81|B\n")
    write(folder, "e.csv", b"lonely\n1\n")
    write(folder, "f.csv", b"\xff\xfe" + "name;city\nA;B\n".encode("utf-16-le"))
    rows = delimited.csv_dialects(spark, str(folder)).collect()
    got = {r["path"].rsplit("/", 1)[1][0]: (r["encoding"], r["sep"]) for r in rows}
    assert got == {
        "a": ("utf-8-sig", ","), "b": ("cp1252", ";"), "c": ("utf-8-sig", "\t"),
        "d": ("latin-1", "|"), "e": ("utf-8-sig", ","), "f": ("utf-16-le", ";"),
    }


def test_a_mixed_folder_becomes_one_table(spark, tmp_path):
    folder = tmp_path / "mix"
    write(folder, "a.csv", b"name,city\nAnn,Oslo\n")
    write(folder, "b.csv", "name;price\nJosé – x;5 €\n".encode("cp1252"))
    rows = delimited.csv_folder(spark, str(folder)).collect()
    assert sorted((r["name"], r["city"], r["price"]) for r in rows) == [
        ("Ann", "Oslo", None), ("José – x", None, "5 €"),
    ]


def test_headers_in_another_order_and_quoted_line_breaks(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", b"id,name\n1,ant\n")
    write(folder, "b.csv", b"name,id\ncat,3\n")
    write(folder, "c.csv", b'id,name\n5,"a\nb"\n')
    rows = delimited.csv_folder(spark, str(folder)).collect()
    assert {(r["id"], r["name"]) for r in rows} == {("1", "ant"), ("3", "cat"), ("5", "a\nb")}


def test_windows_dash_far_into_the_file(spark, tmp_path):
    lines = ["order_id,region_range,sales"] + [f"{i},North,{i}" for i in range(6000)]
    data = ("\n".join(lines) + "\n6001,North \x96 South,5\n").encode("latin-1")
    path = write(tmp_path / "big", "a.csv", data)
    found = delimited.csv_dialects(spark, path).first()
    assert (found["encoding"], found["sep"]) == ("cp1252", ",")
    rows = delimited.csv_source(spark, path, encoding="cp1252")
    assert rows.count() == 6001
    assert rows.where("order_id = '6001'").first()["region_range"] == "North – South"


def test_short_lines_are_padded_and_long_ones_skipped(spark, tmp_path):
    path = write(tmp_path / "rag", "a.csv", b'a,b,c\n1,2,3\n4,5\n6,7,8,9\n6,7,8,\n"x, y",NA,""\n')
    rows = [tuple(r) for r in delimited.csv_source(spark, path).collect()]
    assert rows == [("1", "2", "3"), ("4", "5", None), ("x, y", None, None)]


def test_undecodable_bytes_are_replaced(spark, tmp_path):
    path = write(tmp_path / "bad", "a.csv", b"a,b\nx\xff,1\n")
    assert delimited.csv_source(spark, path).first()["a"] == "x�"


def test_wide_characters(spark, tmp_path):
    path = write(tmp_path / "wide", "a.csv", b"\xff\xfe" + "name;n\nÅsa;1\n".encode("utf-16-le"))
    row = delimited.csv_source(spark, path, ";", "utf-16-le").first()
    assert row.asDict() == {"name": "Åsa", "n": "1"}


def test_export_escapes_and_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 'say "hi", you', -5), ("@x", None, 1)], "c string, d string, n int")
    sinks.safe_export(df, str(tmp_path / "out"))
    rows = sorted(tuple(r) for r in delimited.csv_source(spark, str(tmp_path / "out")).collect())
    assert rows == [("'=1+1", 'say "hi", you', "-5"), ("'@x", None, "1")]


def test_pages(spark):
    df = spark.createDataFrame([(i, f"name{i % 3}", None if i == 4 else float(i), f"u{i}@x.io") for i in range(10)],
                               "id int, name string, v double, email string")
    kinds = {"email": "email"}
    page = browse.page_rows(df, kinds, ["id"], sort_by="v", descending=True, page=2, size=4).collect()
    assert [r["id"] for r in page] == [5, 3, 2, 1]
    assert page[0]["email"] == "u5**@x.io"
    last = browse.page_rows(df, kinds, ["id"], sort_by="v", page=5, size=2).collect()
    assert [r["id"] for r in last] == [9, 4]
    assert browse.page_total(df, kinds, "x.io").first()["total"] == 0
    assert browse.page_total(df, kinds, "NAME1").first()["total"] == 3
    with pytest.raises(ValueError):
        browse.page_rows(df, kinds, ["id"], size=101)


def events(start, rows):
    base = dt.datetime(2024, 1, 1)
    return [(base + dt.timedelta(minutes=m), k, v) for m, k, v in rows]


def test_late_rows_are_dropped_and_closed_windows_equal_the_table(spark, tmp_path):
    schema = "ts timestamp, kind string, v double"
    first = [(m, "a", 1.0) for m in range(0, 180, 10)]
    second = [(200, "a", 1.0)]
    third = [(5, "a", 100.0), (300, "b", 2.0)]
    folder = tmp_path / "events"
    for rows in (first, second, third):
        spark.createDataFrame(events(0, rows), schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # a newer file is a later batch
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = windows.run_available(windows.stream_kpis(stream, "ts", "v", "kind"), str(tmp_path / "late")).collect()
    table = spark.createDataFrame(events(0, first + second + third[1:]), schema)
    batch = windows.stream_kpis(table, "ts", "v", "kind").where(
        F.col("window_end") <= F.lit("2024-01-01 04:50:00").cast("timestamp")
    ).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
    assert max(r["total"] for r in got) == 6.0


def test_sliding_windows_count_each_row_in_each(spark):
    df = spark.createDataFrame(events(0, [(30, "a", 2.0)]), "ts timestamp, kind string, v double")
    rows = windows.stream_kpis(df, "ts", "v", "kind", "1 hour", "15 minutes").collect()
    assert len(rows) == 4 and {r["total"] for r in rows} == {2.0}


def test_rules_on_windows(spark):
    df = spark.createDataFrame(events(0, [(0, "a", 5.0), (1, "a", 7.0)]), "ts timestamp, kind string, v double")
    rules = literal_rows(spark, [(1, "total", "gt", 10.0, "high"), (2, "events", "lt", 2.0, "low"), (3, "mean", "gt", 5.5, "low")],
                         "rule_id int,metric string,condition string,threshold double,severity string")
    rows = windows.stream_rule_alerts(windows.stream_kpis(df, "ts", "v", "kind"), rules).collect()
    assert {r["rule_id"]: r["observed"] for r in rows} == {1: 12.0, 3: 6.0}


def test_quotes_open_at_the_start_of_a_value():
    for line, before, after in [
        (b"a,b", False, False), (b'a,"b', False, True), (b'"a', False, True), (b'a"b,c', False, False), (b'5" pipe,"x"', False, False),
        (b'"a ""b"" c",d', False, False), (b'"a ""b', False, True), (b'end",x', True, False), (b'still "" open', True, True),
        (b'end","again', True, True), (b'""', False, False), (b'"""', False, True), (b'"', True, False), (b"", True, True),
    ]:
        assert records.quote_open(line, b",", before) is after, line


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_large_files_with_quoted_breaks_are_read_in_splits(spark, tmp_path, ending):
    rng, rows = random.Random(4), []
    for i in range(3000):
        note = rng.choice(["plain", 'in "quotes"', "two\nlines", "a\n\nb, c", "x" * rng.randint(0, 300), '\n"\n', ""])
        rows.append((str(i), note, str(i * 7)))
    body = "id,note,n" + ending
    for row in rows:
        body += ",".join('"' + v.replace('"', '""') + '"' if any(c in v for c in '\n",') else v for v in row) + ending
    path = write(tmp_path / "in", "a.csv", body.encode())
    write(tmp_path / "in", "b.csv", f"id,note,n{ending}x,5\" pipe,1{ending}y,\"open{ending}end\",2{ending}1,2,3,4{ending}".encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = delimited.csv_source(spark, path, multiline=True)
        got = {r["id"]: (r["note"], r["n"]) for r in frame.collect()}
        assert records._lines(spark, path).select("path", "block").distinct().count() > 5
        counts = delimited.csv_line_counts(spark, path, multiline=True).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {k: v for k, v in got.items() if k.isdigit()} == {i: (note or None, n) for i, note, n in rows}
    assert got["x"] == ('5" pipe', "1") and got["y"] == (f"open{ending}end", "2")
    assert tuple(counts) == (3003, 3002, 0, 1)


def test_lines_of_the_wrong_length_are_counted(spark, tmp_path):
    path = write(tmp_path / "rag", "a.csv", b'a,b,c\n1,2,3\n4,5\n6,7,8,9\n6,7,8,\n"x, y",NA,""\n')
    assert delimited.csv_line_counts(spark, path).first().asDict() == {"records": 5, "read": 3, "padded": 1, "skipped": 2}
    assert delimited.csv_line_counts(spark, path, multiline=True).first().asDict() == {"records": 5, "read": 3, "padded": 1, "skipped": 2}


def test_a_stopped_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "at timestamp, kind string, v double"
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(400)]
    source = tmp_path / "events"

    def arrive(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))

    def kpis():
        stream = spark.readStream.schema(schema).parquet(str(source))
        return windows.stream_kpis(stream, "at", "v", "kind", "1 hour")

    folder = str(tmp_path / "run")
    seen = []
    for part in (rows[:150], rows[150:151], rows[151:]):
        arrive(part)
        seen.append(windows.run_available(kpis(), folder).count())
    assert 0 < seen[0] < seen[-1]
    got = windows.run_available(kpis(), folder)
    whole = windows.stream_kpis(spark.createDataFrame(rows, schema), "at", "v", "kind", "1 hour")
    closed = whole.where(F.col("window_end") <= F.lit(rows[-1][0] - dt.timedelta(minutes=10)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))
    rules = literal_rows(spark, [(i, m, c, 150.0, "low") for i, (m, c) in enumerate([("total", "gt"), ("events", "lt"), ("mean", "gt"), ("x", "gt"), ("mean", "eq")])],
                         "rule_id int, metric string, condition string, threshold double, severity string")
    alerts = windows.stream_rule_alerts(whole, rules)
    assert "NestedLoop" not in alerts._jdf.queryExecution().executedPlan().toString()
    values = [r.asDict() for r in whole.collect()]
    want = sum(r["total"] > 150 for r in values) + sum(r["events"] < 150 for r in values) + sum(r["mean"] > 150 for r in values)
    assert alerts.count() == want
