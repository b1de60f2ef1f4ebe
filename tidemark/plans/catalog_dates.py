"""Queries on typed dates and on folders of delimited files in several dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import date_grammar
from tidemark.operators import charts, sketches
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import delimited

NAMES = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
]
MONTH = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES, 1)) + " END"
SHORT = f"substr({MONTH}, 1, 3)"


def text(number: str, width: int = 0) -> str:
    """A whole number as text, in both engines; padded with zeros to a width."""
    plain = f"CAST({number} AS STRING)"
    return f"lpad({plain}, {width}, '0')" if width else plain


Y, M, D = (text(f"{part}(o_orderdate)") for part in ("year", "month", "day"))
HOUR, MINUTE = "o_orderkey % 24", "o_orderkey % 60"
CLOCK = f"{text(HOUR)} || ':' || {text(MINUTE, 2)}"
HALF_DAY = (
    f"{text(f'({HOUR} + 11) % 12 + 1')} || ':' || {text(MINUTE, 2)} || CASE WHEN {HOUR} < 12 THEN ' AM' ELSE ' PM' END"
)

#: What people type, by the key's remainder, and how much of day and time it holds.
SHAPES = [
    (f"{Y} || '-' || {text('month(o_orderdate)', 2)} || '-' || {text('day(o_orderdate)', 2)}", "day"),
    (f"{M} || '/' || {D} || '/' || {Y} || ' ' || {CLOCK}", "minute"),
    (f"{M} || '/' || {D} || '/' || {Y} || ' ' || {HALF_DAY}", "minute"),
    (f"{text('month(o_orderdate)', 2)} || '/' || {text('day(o_orderdate)', 2)} || '/' || substr({Y}, 3, 2)", "day"),
    (f"{Y} || '-' || {text('month(o_orderdate)', 2)}", "month"),
    (f"{SHORT} || ' ' || {D} || ' ' || {Y}", "day"),
    (f"{D} || '.' || {M} || '.' || {Y} || ' ' || {CLOCK}", "minute"),
    (f"{Y} || '/' || {M} || '/' || {D} || ' ' || {CLOCK}", "minute"),
    (f"{D} || '-' || {SHORT} || '-' || {Y}", "day"),
    (f"{MONTH} || ' ' || {D} || ', ' || {Y} || ' ' || {text(HOUR, 2)} || ':' || {text(MINUTE, 2)}", "minute"),
    (f"CASE WHEN day(o_orderdate) > 12 THEN {D} || '-' || {M} || '-' || {Y} || ' ' || {CLOCK} || ':00' END", "minute"),
    ("'on ' || " + D, None),
    (f"upper({SHORT}) || '. ' || {D} || 'th, ' || {Y}", "day"),
]
RAW = f"CASE o_orderkey % {len(SHAPES)} " + " ".join(f"WHEN {i} THEN {s}" for i, (s, _) in enumerate(SHAPES)) + " END"
TYPED_ROWS = f"SELECT o_orderkey, {RAW} AS raw FROM {{orders}}"

DAY = "make_timestamp(year(o_orderdate), month(o_orderdate), {day}, {hour}, {minute}, 0)"
TRUTH = {
    "minute": DAY.format(day="day(o_orderdate)", hour=HOUR, minute=MINUTE),
    "day": DAY.format(day="day(o_orderdate)", hour="0", minute="0"),
    "month": DAY.format(day="1", hour="0", minute="0"),
    None: "NULL",
}
TRUE = (
    f"CASE WHEN ({RAW}) IS NULL THEN NULL ELSE CASE o_orderkey % {len(SHAPES)} "
    + " ".join(f"WHEN {i} THEN {TRUTH[part]}" for i, (_, part) in enumerate(SHAPES)) + " END END"
)


def typed_rows(t):
    return t.spark.sql(TYPED_ROWS, orders=t.orders)


@query("dates_as_typed", f"SELECT o_orderkey, {RAW} AS raw, {TRUE} AS typed FROM orders")
def dates_as_typed(t):
    return typed_rows(t).withColumn("typed", date_grammar.to_timestamp_mixed(F.col("raw")))


ANY_MONTH = "|".join([*NAMES, *[n[:3] for n in NAMES]])


@query(
    "date_shapes",
    f"""WITH r AS (SELECT ({RAW}) AS raw, ({TRUE}) AS typed, o_orderkey FROM orders)
    SELECT CASE WHEN typed IS NOT NULL THEN regexp_replace(regexp_replace(regexp_replace(raw,
        '(?i)({ANY_MONTH})\\.?', 'Mon', 'g'), ' (AM|PM)$', ' AM'), '[0-9]', '9', 'g') END AS shape,
      count(*) AS "values", count(typed) AS parsed, min(typed) AS "first", max(typed) AS "last"
    FROM r WHERE raw IS NOT NULL GROUP BY 1""",
)
def date_shapes(t):
    return date_grammar.date_shapes(typed_rows(t), "raw")


def slashed(first: str, second: str, where: str = "TRUE") -> str:
    return f"CASE WHEN {where} THEN {first} || '/' || {second} || '/' || {Y} END"


ORDERED = {
    "european": slashed(D, M),
    "american": slashed(M, D),
    "unclear": slashed(D, M, "day(o_orderdate) <= 12"),
    "turns": f"CASE WHEN o_orderkey % 2 = 0 THEN {slashed(D, M)} ELSE {slashed(M, D)} END",
    "iso": f"{Y} || '-' || {M} || '-' || {D}",
    "prose": "'order ' || CAST(o_orderkey AS STRING)",
}
ORDERED_ROWS = "SELECT o_orderkey, " + ", ".join(f"{s} AS {c}" for c, s in ORDERED.items()) + " FROM {orders}"


def order_sql(column: str, verdict: str, sure_first: str, sure_month: str, either: str, parsed: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count({column}) AS filled, count(*) FILTER ({parsed}) AS parsed, "
        f"count(*) FILTER ({sure_first}) AS day_first, count(*) FILTER ({sure_month}) AS month_first, "
        f"count(*) FILTER ({either}) AS either, '{verdict}' AS date_order FROM r"
    )


LATE, SAME = "day(o_orderdate) > 12", "day(o_orderdate) = month(o_orderdate)"
OPEN = f"NOT ({LATE}) AND NOT ({SAME})"


@query(
    "date_order",
    f"WITH r AS (SELECT o_orderkey, o_orderdate, {', '.join(f'{s} AS {c}' for c, s in ORDERED.items())} FROM orders) "
    + " UNION ALL ".join([
        order_sql("european", "day first", LATE, "false", OPEN, "true"),
        order_sql("american", "month first", "false", LATE, OPEN, "true"),
        order_sql("unclear", "ambiguous", "false", "false", OPEN, "unclear IS NOT NULL"),
        order_sql("turns", "mixed", f"{LATE} AND o_orderkey % 2 = 0", f"{LATE} AND o_orderkey % 2 <> 0", OPEN, "true"),
        order_sql("iso", "clear", "false", "false", "false", "true"),
        order_sql("prose", "clear", "false", "false", "false", "false"),
    ]),
)
def date_order(t):
    return date_grammar.date_order(t.spark.sql(ORDERED_ROWS, orders=t.orders), list(ORDERED))


@query("with_dates", f"SELECT o_orderkey, {TRUTH['day']} AS european, {TRUTH['day']} AS american, {TRUTH['day']} AS iso FROM orders")
def with_dates(t):
    """Day-first and month-first columns both read right, because each shows its own order."""
    rows = t.spark.sql(ORDERED_ROWS, orders=t.orders).select("o_orderkey", "european", "american", "iso")
    return date_grammar.with_dates(rows, ["european", "american", "iso"])


# Folders of files in several dialects -----------------------------------------------------------

#: Separator, encoding, and columns of each kind of file, by the key's remainder.
DIALECTS = [
    (",", "UTF-8", ["o_orderkey", "label", "o_totalprice"]),
    (";", "ISO-8859-1", ["label", "o_orderkey", "o_totalprice"]),
    ("\t", "UTF-8", ["o_totalprice", "o_orderkey", "label", "note"]),
    ("|", "ISO-8859-1", ["o_orderkey", "note", "label"]),
]
#: A label beyond ASCII, and a note with quotes and, in one row of five, a line break.
DIALECT_ROWS = """SELECT CAST(o_orderkey AS STRING) AS o_orderkey, 'Größe ' || o_orderpriority AS label,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS o_totalprice,
  CASE WHEN o_orderkey % 5 = 0 THEN 'first' || chr(10) || 'second, "quoted"' ELSE 'plain ' || o_orderstatus END AS note,
  o_orderkey % 4 AS kind FROM {orders}"""


def write_dialects(t, name: str) -> str:
    """The orders in four dialects, one folder each, in as many files as the table has partitions."""
    path = scratch_path(t.spark, name)
    rows = t.spark.sql(DIALECT_ROWS, orders=t.orders)
    for kind, (sep, encoding, columns) in enumerate(DIALECTS):
        rows.where(F.col("kind") == kind).select(*columns).write.csv(
            f"{path}/kind{kind}", header=True, sep=sep, encoding=encoding, escape='"'
        )
    return path


@query(
    "csv_dialects",
    """SELECT kind, encoding, sep FROM (VALUES ('kind0', 'utf-8-sig', ','), ('kind1', 'cp1252', ';'),
      ('kind2', 'utf-8-sig', chr(9)), ('kind3', 'cp1252', '|')) v(kind, encoding, sep)
    WHERE (SELECT count(*) FROM orders) > 0""",
)
def csv_dialects(t):
    """The dialects found in a folder of files in four dialects."""
    found = delimited.csv_dialects(t.spark, write_dialects(t, "dialects") + "/*")
    kind = F.regexp_extract("path", r"/(kind\d)/", 1)
    return found.select(kind.alias("kind"), "encoding", "sep").distinct()


@query(
    "csv_folder",
    f"""SELECT o_orderkey, label, CASE WHEN kind < 3 THEN o_totalprice END AS o_totalprice,
      CASE WHEN kind >= 2 THEN note END AS note FROM ({DIALECT_ROWS.format(orders='orders')})""",
)
def csv_folder(t):
    """Every value of that folder, read back as one table."""
    return delimited.csv_folder(t.spark, write_dialects(t, "folder") + "/*")


#: Lines of two, three and four values below a header of three, by the key's remainder.
RAGGED = """SELECT CASE o_orderkey % 7
    WHEN 0 THEN CAST(o_orderkey AS STRING) || ',short'
    WHEN 1 THEN CAST(o_orderkey AS STRING) || ',x,y,too long'
    ELSE CAST(o_orderkey AS STRING) || ',"a, b",' || o_orderstatus END AS line, o_orderkey FROM {orders}"""


@query(
    "csv_line_counts",
    """SELECT count(*) AS records, count(*) FILTER (o_orderkey % 7 <> 1) AS "read",
      count(*) FILTER (o_orderkey % 7 = 0) AS padded, count(*) FILTER (o_orderkey % 7 = 1) AS skipped FROM orders""",
)
def csv_line_counts(t):
    """How many lines of the wrong length a file holds, and what became of them."""
    path = scratch_path(t.spark, "ragged")
    rows = t.spark.sql(RAGGED, orders=t.orders)
    head = F.lit("o_orderkey,text,status")
    first = rows.select(F.spark_partition_id().alias("part"), "line", "o_orderkey")
    # Each part file starts with the header.
    lines = first.groupBy("part").agg(F.min("o_orderkey").alias("at")).select("part", F.lit(0).alias("place"), head.alias("line"))
    body = first.select("part", F.lit(1).alias("place"), "line")
    lines.unionAll(body).repartition("part").sortWithinPartitions("part", "place").select("line").write.text(path)
    return delimited.csv_line_counts(t.spark, path)


@query(
    "correlations_wide",
    "WITH l AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t, "
    "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice * l_discount END AS r FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, CAST(ROUND(CAST(corr({a}, {b}) AS DECIMAL(38,18)), 4) AS DOUBLE) AS pearson, "
        f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS sample_size FROM l"
        for i, a in enumerate("qpdtr") for b in "qpdtr"[i + 1:]
    ),
)
def correlations_wide(t):
    """Correlations where one column has gaps."""
    missing = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice") * F.col("l_discount"))
    wide = t.lineitem.select(
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"),
        F.col("l_tax").alias("t"), missing.alias("r"),
    )
    return charts.correlations(wide, list("qpdtr"))


SKETCHED = ["l_quantity", "l_extendedprice", "l_partkey", "l_shipdate"]


def sketched_sql(c: str) -> str:
    number = "NULL::DOUBLE" if c == "l_shipdate" else f"{c}::DOUBLE"
    return f"""SELECT '{c}' AS "column", count(*) AS rows, CAST(count(*) - count({c}) AS BIGINT) AS missing,
      min({number}) AS "min", max({number}) AS "max", true AS distinct_close, true AS median_close FROM lineitem"""


@query("sketched_profile", " UNION ALL ".join(map(sketched_sql, SKETCHED)))
def sketched_profile(t):
    """A profile merged from the sketches of two halves, with its estimates held against exact values."""
    rows, half = t.lineitem.select(*SKETCHED), F.col("l_quantity") <= 20
    parts = sketches.merged(sketches.column_sketches(rows.where(half)), sketches.column_sketches(rows.where(~half)))
    found = sketches.sketch_report(parts)
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in SKETCHED]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("_c"), F.col(c).alias("_n")) for c in SKETCHED
    ])))
    named = [F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in SKETCHED[:-1]]
    medians = found.select(F.col("column").alias("_c"), "median")
    below = rows.select(F.inline(F.array(*named))).join(F.broadcast(medians), "_c").groupBy("_c").agg(
        F.avg((F.col("_v") < F.col("median")).cast("double")).alias("_low"),
        F.avg((F.col("_v") <= F.col("median")).cast("double")).alias("_high"),
    )
    held = found.join(exact, F.col("column") == F.col("_c")).drop("_c").join(below, F.col("column") == F.col("_c"), "left")
    return held.select(
        "column", "rows", "missing", "min", "max",
        (F.abs(F.col("distinct") / F.col("_n") - 1) < 0.08).alias("distinct_close"),
        F.coalesce((F.col("_low") < 0.52) & (F.col("_high") > 0.48), F.lit(True)).alias("median_close"),
    )
