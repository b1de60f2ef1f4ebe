"""Run named queries next to their SQL: ``python -m tests.compare [--sf 0.01] [--time] [names]``."""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

import __spark_entry__ as entry
from tidemark.session import session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def cell(value) -> str:
    """One comparable text per value: numbers by value, missing as one mark."""
    if value is None:
        return "null"
    if isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value) + 0.0)
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(cell(row[i]) for i in order) for row in rows)


def differences(spark, db, name: str, folder: str) -> list[str]:
    """What separates the query from its SQL; empty when they agree."""
    frame = entry.queries()[name](spark, folder)
    left = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return [] if left[1] else ["no rows"]
    cursor = db.execute(sql)
    right = canonical([d[0] for d in cursor.description], cursor.fetchall())
    found = []
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    wide = {c: k for c, k in kinds.items() if k.startswith(("DECIMAL", "HUGEINT"))}
    if wide:
        found.append(f"types only the SQL has: {wide}")
    if left[0] != right[0]:
        found.append(f"columns {left[0]} against {right[0]}")
    if len(left[1]) != len(right[1]):
        found.append(f"{len(left[1])} rows against {len(right[1])}")
    if not left[1]:
        found.append("no rows")
    for a, b in [(a, b) for a, b in zip(left[1], right[1]) if a != b][:3]:
        found.append(f"{a} against {b}")
    return found


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    db = connect(folder)
    chosen = [n for n in entry.queries() if not args.names or any(n.startswith(p) for p in args.names)]
    bad = 0
    for name in chosen:
        begun = time.time()
        try:
            found = differences(spark, db, name, folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'ok ' if not found else 'BAD'} {kind:4} {name} {time.time() - begun:.2f}s", flush=True)
        for line in found:
            print("     ", line, flush=True)
        bad += bool(found)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
