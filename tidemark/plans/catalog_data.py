"""Transform, source, sink, stream and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cleaning, transforms
from tidemark.plans import report
from tidemark.plans.catalog_business import series_sql
from tidemark.plans.catalog_charts import (
    box_sql,
    funnel_sql,
    heat_sql,
    histogram_sql,
    stacked_sql,
)
from tidemark.plans.catalog_quality import (
    BOOLEAN,
    CUSTOMER_FACTS,
    DATE,
    EMAIL_MASK,
    KINDS,
    LEADS_SQL,
    PHONE_MASK,
    TRIMMED,
    leads,
)
from tidemark.plans.registry import query, rnd
from tidemark.session import literal_rows, scratch_path
from tidemark.sources import browse, delimited, sinks
from tidemark.streaming import windows


def trimmed(t):
    return cleaning.trim_nulls(leads(t))


@query("rename_column", "SELECT o_orderkey AS id, o_totalprice, o_orderpriority FROM orders")
def rename_column(t):
    part = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    return transforms.rename_column(part, "o_orderkey", "id")


@query("remove_column", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def remove_column(t):
    return transforms.remove_column(t.customer, "c_acctbal")


FILTERS = {
    "eq": ("segment", "BUILDING", "segment = 'BUILDING'"),
    "ne": ("segment", "BUILDING", "segment IS DISTINCT FROM 'BUILDING'"),
    "contains": ("full_name", "ER#00000001", "contains(lower(full_name), 'er#00000001')"),
    "not_contains": ("full_name", "1", "NOT coalesce(contains(full_name, '1'), false)"),
    "gt": ("quantity", 5, "try_cast(quantity AS DOUBLE) > 5"),
    "gte": ("quantity", 5, "try_cast(quantity AS DOUBLE) >= 5"),
    "lte": ("quantity", 3, "try_cast(quantity AS DOUBLE) <= 3"),
    "lt": ("quantity", 3, "try_cast(quantity AS DOUBLE) < 3"),
}


def _filter_query(operator: str, column: str, value, test: str) -> None:
    sql = f"SELECT lead_id, full_name, quantity, segment FROM ({TRIMMED}) WHERE {test}"

    @query(f"filter_rows_{operator}", sql)
    def build(t):
        part = trimmed(t).select("lead_id", "full_name", "quantity", "segment")
        return transforms.filter_rows(part, column, operator, value)


for _operator, (_column, _value, _test) in FILTERS.items():
    _filter_query(_operator, _column, _value, _test)


@query(
    "replace_value",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE o_orderstatus END
      AS o_orderstatus FROM orders""",
)
def replace_value(t):
    part = t.orders.select("o_orderkey", "o_orderstatus")
    return transforms.replace_value(part, "o_orderstatus", "P", "PENDING")


TYPED = f"""SELECT lead_id, full_name, segment, try_cast(quantity AS DOUBLE) AS quantity
  FROM ({TRIMMED})"""


def typed(t):
    part = trimmed(t).select("lead_id", "full_name", "segment", "quantity")
    return transforms.convert_type(part, "quantity", "numeric")


def _missing_query(strategy: str, sql: str, column: str = "quantity", constant="") -> None:
    @query(f"handle_missing_{strategy}", sql)
    def build(t):
        return transforms.handle_missing(typed(t), column, strategy, constant)


_missing_query("drop", f"SELECT * FROM ({TYPED}) WHERE quantity IS NOT NULL")
_missing_query(
    "mean",
    f"""SELECT lead_id, full_name, segment, coalesce(quantity,
      (SELECT {rnd('avg(quantity)', 2)} FROM ({TYPED}))) AS quantity FROM ({TYPED})""",
)
_missing_query(
    "median",
    f"""SELECT lead_id, full_name, segment, coalesce(quantity,
      (SELECT {rnd('median(quantity)', 2)} FROM ({TYPED}))) AS quantity FROM ({TYPED})""",
)
_missing_query(
    "mode",
    f"""SELECT lead_id, coalesce(full_name, (SELECT full_name FROM ({TYPED})
      WHERE full_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS full_name,
      segment, quantity FROM ({TYPED})""",
    "full_name",
)
_missing_query(
    "constant",
    f"""SELECT lead_id, coalesce(full_name, 'nobody') AS full_name, segment, quantity
    FROM ({TYPED})""",
    "full_name",
    "nobody",
)


@query(
    "remove_duplicates",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus
      ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""",
)
def remove_duplicates(t):
    return transforms.remove_duplicates(
        t.orders, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]
    )


@query(
    "convert_type",
    f"""SELECT lead_id, try_cast(regexp_replace(price, '[, $₹€£%¥]', '', 'g') AS DOUBLE) AS price,
      {DATE.format(c='created_date')} AS created_date, {BOOLEAN.format(c='is_active')} AS is_active
    FROM ({TRIMMED})""",
)
def convert_type(t):
    part = trimmed(t).select("lead_id", "price", "created_date", "is_active")
    part = transforms.convert_type(part, "price", "numeric")
    part = transforms.convert_type(part, "created_date", "datetime")
    return transforms.convert_type(part, "is_active", "boolean")


@query(
    "calculated_column",
    f"""SELECT l_orderkey, l_linenumber, {rnd('l_extendedprice * l_discount', 4)} AS cut,
      {rnd('coalesce(l_discount / nullif(l_tax, 0), 0)', 6)} AS ratio,
      {rnd('coalesce(l_tax / nullif(l_discount, 0), 0) * 100', 6)} AS pct,
      {rnd('l_quantity - 10', 4)} AS off FROM lineitem""",
)
def calculated_column(t):
    df = transforms.calculated_column(t.lineitem, "cut", "l_extendedprice", "*", "l_discount")
    df = transforms.calculated_column(df, "ratio", "l_discount", "/", "l_tax")
    df = transforms.calculated_column(df, "pct", "l_tax", "%", "l_discount")
    df = transforms.calculated_column(df, "off", "l_quantity", "-", value=10)
    digits = {"cut": 4, "ratio": 6, "pct": 6, "off": 4}
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, d).alias(c) for c, d in digits.items()])


RECIPE = [
    {"type": "rename_column", "old_name": "o_totalprice", "new_name": "amount"},
    {"type": "filter_rows", "column": "amount", "operator": "gt", "value": 100000},
    {"type": "filter_rows", "column": "amount", "operator": "gt", "value": "many"},
    {"type": "remove_column", "column": "nowhere"},
    {"type": "replace_value", "column": "o_orderstatus", "find": "P", "replace": "O"},
    {"type": "calculated_column", "new_column": "fee", "col1": "amount", "operator": "*", "value": 0.1},
    {"type": "remove_duplicates", "subset": ["o_custkey"]},
    {"type": "remove_column", "column": "o_orderpriority"},
]
KEPT = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_totalprice > 100000"


@query(
    "apply_recipe",
    f"""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END
      AS o_orderstatus, o_totalprice AS amount, o_orderdate, {rnd('o_totalprice * 0.1', 4)} AS fee
    FROM ({KEPT}) WHERE r = 1""",
)
def apply_recipe(t):
    done = transforms.apply_recipe(t.orders, RECIPE, ["o_orderdate", "o_orderkey"])
    return done.withColumn("fee", F.round("fee", 4))


@query(
    "pipeline_audit",
    f"""WITH k AS ({KEPT}) SELECT 1 AS step, 'rename_column' AS operation, 'success' AS status,
      0 AS affected
    UNION ALL SELECT 2, 'filter_rows', 'success', count(*) FROM orders WHERE NOT o_totalprice > 100000
    UNION ALL SELECT 3, 'filter_rows', 'error', 0
    UNION ALL SELECT 5, 'replace_value', 'success', count(*) FROM k WHERE o_orderstatus = 'P'
    UNION ALL SELECT 6, 'calculated_column', 'success', 0
    UNION ALL SELECT 7, 'remove_duplicates', 'success', count(*) FROM k WHERE r > 1
    UNION ALL SELECT 8, 'remove_column', 'success', 0""",
)
def pipeline_audit(t):
    audit = transforms.pipeline_audit(t.orders, RECIPE, ["o_orderdate", "o_orderkey"])
    return audit.select("step", "operation", "status", "affected")


# Sources and sinks ------------------------------------------------------------------------------


@query(
    "preview",
    f"""SELECT left(lead_id, 120) AS lead_id, {EMAIL_MASK.format(v='email')} AS email,
      {PHONE_MASK.format(v='mobile')} AS mobile, left(price, 120) AS price
    FROM ({TRIMMED}) ORDER BY length(lead_id), lead_id, full_name, mobile LIMIT 10""",
)
def preview(t):
    frame = trimmed(t).withColumn("_n", F.length("lead_id"))
    shown = browse.preview(frame, KINDS, ["_n", "lead_id", "full_name", "mobile"])
    return shown.select("lead_id", "email", "mobile", "price")


FIRST_ROWS = "FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 15)"


@query("preview_schema", CUSTOMER_FACTS.replace("FROM customer", FIRST_ROWS))
def preview_schema(t):
    return browse.preview_schema(t.customer, ["c_custkey"])


PAGE = """SELECT * FROM customer WHERE contains(lower(c_name), '11') OR contains(lower(c_mktsegment), '11')
  OR contains(CAST(c_custkey AS VARCHAR), '11') OR contains(CAST(c_nationkey AS VARCHAR), '11')
  OR contains(CAST(c_acctbal AS VARCHAR), '11')"""


@query("page_rows", f"{PAGE} ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 20")
def page_rows(t):
    return browse.page_rows(
        t.customer, {}, ["c_custkey"], "11", "c_acctbal", descending=True, page=2, size=20
    )


@query("page_total", f"SELECT count(*) AS total FROM ({PAGE})")
def page_total(t):
    return browse.page_total(t.customer, {}, "11")


FORMULAS = """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '=1+' || c_name
    WHEN c_custkey % 4 = 1 THEN ' @' || c_name WHEN c_custkey % 4 = 2 THEN '"q", ' || c_name
    ELSE c_name END AS c_name, c_mktsegment FROM {customer}"""


@query(
    "safe_export",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN regexp_matches(c_name, '^\\s*[=+\\-@]')
      THEN '''' || c_name ELSE c_name END AS c_name, c_mktsegment
    FROM ({FORMULAS.format(customer='customer')})""",
)
def safe_export(t):
    """Written with formulas escaped, then read back."""
    path = scratch_path(t.spark, "export")
    sinks.safe_export(t.spark.sql(FORMULAS, customer=t.customer), path)
    return delimited.csv_source(t.spark, path)


@query(
    "csv_source",
    f"""SELECT {", ".join(
        f"CASE WHEN {c} IN ('', 'NULL', 'null', 'None', 'NaN', 'nan', 'N/A', 'n/a', 'NA') THEN NULL ELSE {c} END AS {c}"
        for c in KINDS)} FROM ({LEADS_SQL})""",
)
def csv_source(t):
    """The leads written as separated text and read back as all-text columns."""
    path = scratch_path(t.spark, "leads")
    leads(t).write.option("header", True).option("sep", ";").option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return delimited.csv_source(t.spark, path, sep=";")


@query(
    "persist_clean",
    f"""SELECT lead_id, try_cast(quantity AS DOUBLE) AS quantity, {DATE.format(c='created_date')}
      AS created_date FROM ({TRIMMED})""",
)
def persist_clean(t):
    clean = cleaning.coerce(trimmed(t), KINDS).select("lead_id", "quantity", "created_date")
    return sinks.persist_clean(clean, scratch_path(t.spark, "clean"))


# Streams ----------------------------------------------------------------------------------------

CLOSED = f"""w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type,
    count(*) AS events, {rnd('sum(value)', 2)} AS total, {rnd(rnd('sum(value)', 6) + ' / count(value)', 4)} AS mean
    FROM events GROUP BY 1, 2),
  closed AS (SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, events,
    total, mean FROM w
    WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events))"""


def event_stream(t):
    return (
        t.spark.readStream.schema(t.events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(t.folder)
    )


def daily_windows(t):
    return windows.stream_kpis(event_stream(t), "ts", "value", "event_type", "1 day")


@query("stream_kpis", f"WITH {CLOSED} SELECT * FROM closed")
def stream_kpis(t):
    found = windows.run_available(daily_windows(t), scratch_path(t.spark, "kpis"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn(
        "window_end", F.col("window_end").cast("timestamp_ntz")
    )


STREAM_RULES = [
    (1, "total", "gt", 3500.0, "high"),
    (2, "events", "lt", 60.0, "medium"),
    (3, "mean", "gt", 55.0, "low"),
]
STREAM_RULE_VALUES = ", ".join(
    f"({i}, '{m}', '{c}', {v}::DOUBLE, '{s}')" for i, m, c, v, s in STREAM_RULES
)


@query(
    "stream_rule_alerts",
    f"""WITH {CLOSED}, l AS (SELECT *, CASE metric WHEN 'events' THEN events WHEN 'total' THEN total
      ELSE mean END AS observed FROM closed, (VALUES {STREAM_RULE_VALUES})
      AS r(rule_id, metric, condition, threshold, severity))
    SELECT window_start, window_end, event_type, rule_id, severity, observed, threshold FROM l
    WHERE CASE condition WHEN 'gt' THEN observed > threshold ELSE observed < threshold END""",
)
def stream_rule_alerts(t):
    schema = "rule_id int, metric string, condition string, threshold double, severity string"
    rules = literal_rows(t.spark, STREAM_RULES, schema)
    alerts = windows.stream_rule_alerts(daily_windows(t), rules)
    found = windows.run_available(alerts, scratch_path(t.spark, "alerts"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn(
        "window_end", F.col("window_end").cast("timestamp_ntz")
    )


# Reports ----------------------------------------------------------------------------------------

CHART_KINDS = {
    "o_orderkey": "identifier",
    "o_totalprice": "currency",
    "o_orderpriority": "category",
    "o_orderstatus": "status",
    "o_orderdate": "datetime",
}


def mark(chart_id: str, kind: str, sql: str, x: str, value: str, series: str = "NULL") -> str:
    return f"""SELECT '{chart_id}' AS chart_id, '{kind}' AS kind, CAST({x} AS VARCHAR) AS x,
      CAST({series} AS VARCHAR) AS series, {rnd(value, 4)} AS value FROM ({sql})"""


def bar_sql(c: str) -> str:
    return f"""SELECT {c} AS label, {rnd('sum(o_totalprice)', 2)} AS value FROM orders GROUP BY 1
      ORDER BY value DESC, label LIMIT 10"""


def pie_sql(c: str) -> str:
    return f"SELECT {c} AS label, count(*) AS value FROM orders GROUP BY 1"


ORDERS = "SELECT * FROM orders"
FIRST, SECOND = "o_orderpriority", "o_orderstatus"
TREE = f"SELECT {FIRST} AS label, {rnd('sum(o_totalprice)', 2)} AS value FROM orders GROUP BY 1"
TOTAL = "SELECT sum(o_totalprice) AS v FROM orders"
AUTO = [
    mark(f"bar_{FIRST}", "bar", bar_sql(FIRST), "label", "value"),
    mark(f"bar_{SECOND}", "bar", bar_sql(SECOND), "label", "value"),
    mark("trend", "line", series_sql("orders", "o_orderdate", "sum(o_totalprice)"), "period", "value"),
    mark("hist_o_totalprice", "histogram", histogram_sql("orders", "o_totalprice", 5), "bin", "count"),
    mark(f"pie_{FIRST}", "pie", pie_sql(FIRST), "label", "value"),
    mark(f"pie_{SECOND}", "pie", pie_sql(SECOND), "label", "value"),
    mark(f"treemap_{FIRST}", "treemap", TREE, "label", "value"),
    mark(f"funnel_{FIRST}", "funnel", funnel_sql(ORDERS, FIRST, "sum(o_totalprice)", "LIMIT 5"),
         "stage", "value"),
    *[
        mark("box_o_totalprice", "box_plot", box_sql(ORDERS, FIRST, "o_totalprice", 5), "category",
             part, f"'{part}'")
        for part in ("min", "q1", "median", "q3", "max")
    ],
    mark(f"stacked_{FIRST}_{SECOND}", "stacked_bar",
         stacked_sql(ORDERS, FIRST, SECOND, "sum(o_totalprice)", 6, 4), "label", "value", "series"),
    mark(f"heatmap_{FIRST}_{SECOND}", "heatmap",
         heat_sql(ORDERS, FIRST, SECOND, "sum(o_totalprice)", 6, 5), "x", "value", "y"),
    *[
        mark("gauge_o_totalprice", "gauge", TOTAL, f"'{name}'", rnd(f"v * {factor}", 2))
        for name, factor in (("value", "1.0"), ("target", "1.15"), ("max", "1.3"))
    ],
]


@query("auto_charts", " UNION ALL ".join(AUTO))
def auto_charts(t):
    distinct = {"o_orderpriority": 5, "o_orderstatus": 3}
    return report.auto_charts(
        t.orders, CHART_KINDS, distinct, "o_orderkey", revenue="o_totalprice", date="o_orderdate"
    )


LINES, FLAG, STATUS = "SELECT * FROM lineitem", "l_returnflag", "l_linestatus"
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def count_sql(c: str) -> str:
    return f"SELECT {c} AS label, count(*) AS value FROM lineitem GROUP BY 1"


def mean_sql(c: str) -> str:
    return f"SELECT {c} AS label, {rnd('avg(l_quantity)', 3)} AS value FROM lineitem GROUP BY 1"


def points_sql(x: str, y: str) -> str:
    return f"""SELECT {x} AS x, {y} AS y FROM lineitem
      ORDER BY md5(CAST(l_orderkey AS VARCHAR)), CAST(l_orderkey AS VARCHAR), {x}, {y} LIMIT 500"""


LINE_PAIRS = """SELECT x, y, pearson FROM (SELECT *, row_number() OVER (ORDER BY abs(pearson) DESC, x, y) AS r FROM ("""
LINE_PAIRS += " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {rnd(f'corr({a}, {b})', 4)} AS pearson FROM lineitem"
    for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]
) + ")) WHERE r <= 3"
AUTO_LINES = [
    *[mark(f"bar_{c}", "bar", count_sql(c), "label", "value") for c in (FLAG, STATUS)],
    mark("trend", "line", series_sql("lineitem", "l_shipdate", "count(*)"), "period", "value"),
    *[mark(f"hist_{c}", "histogram", histogram_sql("lineitem", c, 5), "bin", "count") for c in LINE_NUMBERS],
    *[mark(f"pie_{c}", "pie", count_sql(c), "label", "value") for c in (FLAG, STATUS)],
    *[mark(f"avg_{c}_l_quantity", "bar", mean_sql(c), "label", "value") for c in (FLAG, STATUS)],
    mark("scatter", "correlation", LINE_PAIRS, "x", "pearson", "y"),
    *[
        mark(f"scatter_{a}_{b}", "scatter", points_sql(a, b), "x", "y")
        for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]
    ],
    mark(f"treemap_{FLAG}", "treemap",
         f"SELECT {FLAG} AS label, {rnd('sum(l_quantity)', 2)} AS value FROM lineitem GROUP BY 1", "label", "value"),
    mark(f"funnel_{FLAG}", "funnel", funnel_sql(LINES, FLAG, "sum(l_quantity)", "LIMIT 5"), "stage", "value"),
    *[
        mark(f"combo_{FLAG}", "combo",
             f"SELECT {FLAG} AS label, {rnd(agg, 2)} AS value FROM lineitem GROUP BY 1", "label", "value", f"'{c}'")
        for c, agg in (("l_quantity", "sum(l_quantity)"), ("l_extendedprice", "avg(l_extendedprice)"))
    ],
    *[
        mark("box_l_quantity", "box_plot", box_sql(LINES, FLAG, "l_quantity", 5), "category", part, f"'{part}'")
        for part in ("min", "q1", "median", "q3", "max")
    ],
    mark(f"stacked_{FLAG}_{STATUS}", "stacked_bar", stacked_sql(LINES, FLAG, STATUS, "sum(l_quantity)", 6, 4),
         "label", "value", "series"),
    mark(f"heatmap_{FLAG}_{STATUS}", "heatmap", heat_sql(LINES, FLAG, STATUS, "sum(l_quantity)", 6, 5), "x", "value", "y"),
    *[
        mark("gauge_l_quantity", "gauge", "SELECT sum(l_quantity) AS v FROM lineitem", f"'{name}'", rnd(f"v * {factor}", 2))
        for name, factor in (("value", "1.0"), ("target", "1.15"), ("max", "1.3"))
    ],
]


@query("auto_charts_lineitem", " UNION ALL ".join(AUTO_LINES))
def auto_charts_lineitem(t):
    """The chart set of a table with several numbers and no revenue column."""
    kinds = {
        "l_returnflag": "category",
        "l_linestatus": "status",
        "l_quantity": "numeric",
        "l_extendedprice": "currency",
        "l_discount": "percentage",
    }
    distinct = {"l_returnflag": 3, "l_linestatus": 2}
    return report.auto_charts(t.lineitem, kinds, distinct, "l_orderkey", date="l_shipdate")
