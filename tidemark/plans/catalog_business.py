"""Series, KPI, insight and template queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.dates import FORECAST_GRAINS, SERIES_GRAINS
from tidemark.operators import insights, kpis, series, templates
from tidemark.plans.catalog_charts import LINE_NUMBERS, correlations_sql
from tidemark.plans.registry import query, rnd
from tidemark.plans.tables import SALES_SQL

ITEMS_SQL = "SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey"


def grain_sql(table: str, date: str, ladder) -> str:
    *steps, (_, finest) = ladder
    cases = " ".join(f"WHEN d > {days} THEN '{grain}'" for days, grain in steps)
    return f"""(SELECT CASE {cases} ELSE '{finest}' END FROM
      (SELECT datesub('day', min({date}), max({date})) AS d FROM {table}))"""


def series_sql(table: str, date: str, value: str, keys: str = "", ladder=SERIES_GRAINS) -> str:
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}grain, CAST(date_trunc(grain, {date}) AS DATE) AS period,
      {rnd(value, 2)} AS value
    FROM {table}, (SELECT {grain_sql(table, date, ladder)} AS grain) GROUP BY ALL"""


@query("time_series", series_sql("orders", "o_orderdate", "sum(o_totalprice)"))
def time_series(t):
    return series.time_series(t.orders, "o_orderdate", "o_totalprice")


@query("time_series_by_key", series_sql("events", "ts", "sum(value)", "event_type"))
def time_series_by_key(t):
    return series.time_series(t.events, "ts", "value", ["event_type"])


@query("time_series_counts", series_sql("lineitem", "l_shipdate", "count(*)"))
def time_series_counts(t):
    return series.time_series(t.lineitem, "l_shipdate")


@query("forecast_series", series_sql("orders", "o_orderdate", "sum(o_totalprice)",
                                     "o_orderpriority", FORECAST_GRAINS))
def forecast_series(t):
    return series.forecast_series(t.orders, "o_orderdate", "o_totalprice", ["o_orderpriority"])


# KPI rows ---------------------------------------------------------------------------------------

CUSTOMER_KINDS = {
    "c_custkey": "identifier",
    "n_name": "region",
    "r_name": "region",
    "o_orderstatus": "status",
    "c_mktsegment": "category",
    "c_name": "person",
}


def kpi_rows(entries: list[tuple[int, str, str, str]], source: str) -> str:
    """Rows of (position, label, value, format) from one aggregate each; nulls are left out."""
    rows = " UNION ALL ".join(
        f"SELECT {p} AS position, '{label}' AS label, CAST({value} AS DOUBLE) AS value, "
        f"'{kind}' AS format FROM s"
        for p, label, value, kind in entries
    )
    return f"WITH s AS ({source}) SELECT * FROM ({rows}) WHERE value IS NOT NULL"


SALES_FOR_KPIS = """SELECT c_custkey AS customer_id, n_name AS country, r_name AS region,
  o_orderstatus AS order_status, c_mktsegment AS category, o_orderpriority AS sales_agent,
  o_orderkey AS order_id, o_totalprice AS revenue, c_acctbal AS account_cost
  FROM ({sales})"""
SALES_KINDS = {
    "customer_id": "identifier",
    "country": "location",
    "region": "region",
    "order_status": "status",
    "category": "category",
    "sales_agent": "person",
}


def kpi_table(t):
    """The sales table under the column names that KPI labels are made from."""
    return t.sales().select(
        F.col("c_custkey").alias("customer_id"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("c_mktsegment").alias("category"),
        F.col("o_orderpriority").alias("sales_agent"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("revenue"),
        F.col("c_acctbal").alias("account_cost"),
    )


def shown(frame):
    return frame.drop("calculation")


KPI_SOURCE = SALES_FOR_KPIS.format(sales=SALES_SQL)


@query(
    "kpi_distinct",
    kpi_rows(
        [
            (0, "Unique Customers", "count(DISTINCT customer_id)", "count"),
            (1, "Locations", "count(DISTINCT country)", "count"),
            (2, "Regions", "count(DISTINCT region)", "count"),
            (3, "Statuses", "count(DISTINCT order_status)", "count"),
            (4, "Categories", "count(DISTINCT category)", "count"),
            (5, "Unique sales_agent", "count(DISTINCT sales_agent)", "count"),
        ],
        KPI_SOURCE,
    ),
)
def kpi_distinct(t):
    return shown(kpis.kpi_distinct(kpi_table(t), SALES_KINDS))


PART_KINDS = {"p_retailprice": "currency", "p_size_tenure": "numeric", "p_age": "numeric"}


@query(
    "kpi_numeric",
    kpi_rows(
        [
            (0, "Total P_Retailprice", rnd("sum(p_retailprice)", 2), "currency"),
            (1, "Average Experience", rnd("avg(p_size)", 2), "number"),
            (2, "Average Age", rnd("avg(p_size)", 2), "number"),
        ],
        "SELECT * FROM part",
    ),
)
def kpi_numeric(t):
    named = t.part.select(
        "p_retailprice", F.col("p_size").alias("p_size_tenure"), F.col("p_size").alias("p_age")
    )
    return shown(kpis.kpi_numeric(named, PART_KINDS))


@query(
    "kpi_orders",
    kpi_rows(
        [
            (0, "Total Orders", "count(DISTINCT l_orderkey)", "count"),
            (1, "Total Quantity", "floor(sum(l_quantity))", "count"),
        ],
        "SELECT * FROM lineitem",
    ),
)
def kpi_orders(t):
    return shown(kpis.kpi_orders(t.lineitem, order_id="l_orderkey", quantity="l_quantity"))


ORDER_SERIES = f"ser AS ({series_sql('orders', 'o_orderdate', 'sum(o_totalprice)')})"
LAST_TWO = "last2 AS (SELECT *, row_number() OVER (ORDER BY period DESC) AS r FROM ser)"
GROWTH = rnd("((SELECT value FROM last2 WHERE r = 1) / (SELECT value FROM last2 WHERE r = 2) - 1) * 100", 2)


@query(
    "kpi_revenue",
    f"""WITH {ORDER_SERIES}, {LAST_TWO}
    SELECT 0 AS position, 'Total Revenue' AS label, {rnd('sum(o_totalprice)', 2)} AS value,
      'currency' AS format FROM orders
    UNION ALL SELECT 1, 'Average Order Value',
      {rnd('sum(o_totalprice) / count(DISTINCT o_orderkey)', 2)}, 'currency' FROM orders
    UNION ALL SELECT 2, 'Revenue Growth', {GROWTH}, 'percent'""",
)
def kpi_revenue(t):
    frame = t.orders.withColumnRenamed("o_totalprice", "revenue")
    line = series.time_series(frame, "o_orderdate", "revenue")
    return shown(kpis.kpi_revenue(frame, "revenue", order_id="o_orderkey", series=line))


@query(
    "kpi_profit",
    kpi_rows(
        [
            (0, "Total Profit", rnd("sum(l_extendedprice * l_discount)", 2), "currency"),
            (1, "Profit Margin",
             rnd("sum(l_extendedprice * l_discount) / sum(l_extendedprice) * 100", 2), "percent"),
        ],
        "SELECT * FROM lineitem",
    ),
)
def kpi_profit(t):
    frame = t.lineitem.withColumn("profit", F.col("l_extendedprice") * F.col("l_discount"))
    return shown(kpis.kpi_profit(frame, "profit", "l_extendedprice"))


@query(
    "kpi_rates",
    kpi_rows(
        [
            (0, "Attrition Rate",
             rnd("avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) * 100", 2), "percent"),
            (1, "Recovery Rate",
             rnd("avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) * 100", 2), "percent"),
        ],
        "SELECT * FROM lineitem",
    ),
)
def kpi_rates(t):
    frame = t.lineitem.select(
        F.when(F.col("l_returnflag") == "R", " Left ").otherwise("stays").alias("attrition"),
        F.when(F.col("l_linestatus") == "F", "Recovered").otherwise("open").alias("outcome"),
    )
    return shown(kpis.kpi_rates(frame, "attrition", "outcome"))


# Insights ---------------------------------------------------------------------------------------

TEXT_NUMBERS = ["n_chars", "blanks", "doc_id"]
DIMENSIONS = ["n_name", "r_name", "c_mktsegment", "o_orderpriority"]


def dimension_rows(columns: list[str], source: str, value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS label, {value} AS value "
        f"FROM ({source}) WHERE {c} IS NOT NULL GROUP BY 2"
        for c in columns
    )


@query(
    "insight_extremes",
    f"""WITH g AS ({dimension_rows(DIMENSIONS, SALES_SQL, rnd('sum(o_totalprice)', 2))}),
    r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY value DESC, label) AS hi,
      row_number() OVER (PARTITION BY dimension ORDER BY value, label DESC) AS lo,
      count(*) OVER (PARTITION BY dimension) AS groups,
      sum(value) OVER (PARTITION BY dimension) AS total FROM g)
    SELECT dimension, 'highest' AS insight, label, value, {rnd('value / total * 100', 1)} AS share_pct
    FROM r WHERE hi = 1
    UNION ALL SELECT dimension, 'lowest', label, value, {rnd('value / total * 100', 1)}
    FROM r WHERE lo = 1 AND groups > 2""",
)
def insight_extremes(t):
    return insights.insight_extremes(t.sales(), DIMENSIONS, "o_totalprice")


TOP_SHARE = """WITH g AS ({rows}),
  r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY value DESC, label) AS hi FROM g)
  SELECT {head} dimension, label, CAST(value AS DOUBLE) AS value,
    {share} AS share_pct FROM r WHERE hi = 1 {tail}"""


@query(
    "insight_extremes_counts",
    TOP_SHARE.format(
        rows=dimension_rows(DIMENSIONS, SALES_SQL, "count(*)"),
        head="'top' AS insight,",
        share=rnd(f"value / (SELECT count(*) FROM ({SALES_SQL})) * 100", 1),
        tail="",
    ),
)
def insight_extremes_counts(t):
    return insights.insight_extremes(t.sales(), DIMENSIONS)


@query(
    "insight_concentration",
    "SELECT * FROM ("
    + TOP_SHARE.format(
        rows=dimension_rows(["toxic", "quality"], "SELECT * FROM labels", "count(*)"),
        head="",
        share=rnd("value / (SELECT count(*) FROM labels) * 100", 1),
        tail="",
    )
    + ") WHERE share_pct >= 50",
)
def insight_concentration(t):
    return insights.insight_concentration(t.labels, ["toxic", "quality"], 50.0)


@query(
    "insight_growth",
    f"""WITH {ORDER_SERIES},
    p AS (SELECT *, row_number() OVER (ORDER BY period) AS pos, count(*) OVER () AS n,
      lag(value) OVER (ORDER BY period) AS prev, lag(period) OVER (ORDER BY period) AS prev_period
      FROM ser),
    halves AS (SELECT avg(value) FILTER (pos <= n // 2) AS a, avg(value) FILTER (pos > n // 2) AS b,
      min(period) AS lo, max(period) AS hi, max(n) AS n FROM p)
    SELECT * FROM (
      SELECT 'coverage' AS insight, lo AS from_period, hi AS to_period, CAST(n AS DOUBLE) AS result
      FROM halves
      UNION ALL SELECT 'last_change', prev_period, period, {rnd('(value / prev - 1) * 100', 1)}
      FROM p WHERE pos = n AND prev > 0
      UNION ALL SELECT 'macro_trend', lo, hi, {rnd('(b / a - 1) * 100', 1)}
      FROM halves WHERE n >= 4 AND a > 0 AND abs((b / a - 1) * 100) >= 10)""",
)
def insight_growth(t):
    return insights.insight_growth(series.time_series(t.orders, "o_orderdate", "o_totalprice"))


@query(
    "insight_strong_corr",
    f"""SELECT *, CASE WHEN pearson > 0 THEN 'positive' ELSE 'negative' END AS direction
    FROM ({correlations_sql(
        "(SELECT *, length(text) - length(replace(text, ' ', '')) AS blanks FROM documents)",
        TEXT_NUMBERS)}) WHERE abs(pearson) >= 0.7""",
)
def insight_strong_corr(t):
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    measured = t.documents.select("doc_id", "n_chars", blanks.alias("blanks"))
    return insights.insight_strong_corr(measured, TEXT_NUMBERS)


# Templates --------------------------------------------------------------------------------------


def sums_sql(order: str, k: int) -> str:
    return f"""SELECT p_brand AS label, {rnd('sum(l_extendedprice)', 2)} AS value
    FROM ({ITEMS_SQL}) GROUP BY 1 ORDER BY value {order}, label LIMIT {k}"""


@query("top_by_sum", sums_sql("DESC", 10))
def top_by_sum(t):
    return templates.top_by_sum(t.items(), "p_brand", "l_extendedprice")


@query("bottom_by_sum", sums_sql("ASC", 10))
def bottom_by_sum(t):
    return templates.bottom_by_sum(t.items(), "p_brand", "l_extendedprice")


@query("total_by_group", sums_sql("DESC", 15))
def total_by_group(t):
    return templates.total_by_group(t.items(), "l_extendedprice", "p_brand")


@query("total_overall", f"SELECT {rnd('sum(l_extendedprice)', 2)} AS value FROM lineitem")
def total_overall(t):
    return templates.total_by_group(t.lineitem, "l_extendedprice")


@query(
    "avg_by_group",
    f"""SELECT p_type AS label, {rnd('avg(l_quantity)', 2)} AS value FROM ({ITEMS_SQL})
    GROUP BY 1 ORDER BY value DESC, label LIMIT 20""",
)
def avg_by_group(t):
    return templates.avg_by_group(t.items(), "l_quantity", "p_type")


@query("avg_overall", f"SELECT {rnd('avg(l_quantity)', 2)} AS value FROM lineitem")
def avg_overall(t):
    return templates.avg_by_group(t.lineitem, "l_quantity")


@query(
    "count_by_group",
    """SELECT user_id AS label, count(*) AS value FROM events GROUP BY 1
    ORDER BY value DESC, label LIMIT 20""",
)
def count_by_group(t):
    return templates.count_by_group(t.events, "user_id")


@query("count_overall", "SELECT count(*) AS value FROM events")
def count_overall(t):
    return templates.count_by_group(t.events)


@query(
    "sample_columns",
    """SELECT o_orderpriority, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20""",
)
def sample_columns(t):
    return templates.sample_columns(t.orders, ["o_orderpriority", "o_totalprice"], ["o_orderkey"])


@query(
    "capped_sql",
    f"""SELECT o_custkey, {rnd('sum(o_totalprice)', 2)} AS spend FROM orders GROUP BY 1
    ORDER BY spend DESC, o_custkey LIMIT 5000""",
)
def capped_sql(t):
    return templates.capped_sql(
        t.orders,
        "SELECT o_custkey, round(sum(o_totalprice), 2) AS spend FROM dataset "
        "GROUP BY o_custkey ORDER BY spend DESC, o_custkey LIMIT 5000",
    )


@query(
    "column_summary",
    f"""SELECT count(o_totalprice) AS count, {rnd('sum(o_totalprice)', 2)} AS sum,
      {rnd('avg(o_totalprice)', 2)} AS avg, {rnd('median(o_totalprice)', 2)} AS median,
      {rnd('min(o_totalprice)', 2)} AS min, {rnd('max(o_totalprice)', 2)} AS max FROM orders""",
)
def column_summary(t):
    return templates.column_summary(t.orders, "o_totalprice")


@query(
    "value_share",
    f"""SELECT event_type AS label, count(*) AS value,
      {rnd('count(*) / (SELECT count(*) FROM events) * 100', 1)} AS share_pct
    FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY value DESC, label LIMIT 8""",
)
def value_share(t):
    return templates.value_share(t.events, "event_type")


@query("pii_distinct", "SELECT count(DISTINCT c_name) AS distinct_values FROM customer")
def pii_distinct(t):
    return templates.pii_distinct(t.customer, "c_name")


@query(
    "period_change",
    f"""WITH {ORDER_SERIES}, {LAST_TWO},
    best AS (SELECT o_orderpriority AS top_label, {rnd('sum(o_totalprice)', 2)} AS top_value
      FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
    SELECT a.period, a.value, b.period AS prev_period, b.value AS prev_value,
      {rnd('(a.value - b.value) / greatest(b.value, 1e-6) * 100', 1)} AS change_pct,
      top_label, top_value
    FROM last2 a JOIN last2 b ON a.r = 1 AND b.r = 2, best""",
)
def period_change(t):
    line = series.time_series(t.orders, "o_orderdate", "o_totalprice")
    return templates.period_change(t.orders, line, "o_orderpriority", "o_totalprice")


@query(
    "strongest_correlation",
    f"""SELECT * FROM ({correlations_sql('lineitem', LINE_NUMBERS)})
    ORDER BY abs(pearson) DESC, x, y LIMIT 1""",
)
def strongest_correlation(t):
    return templates.strongest_correlation(t.lineitem, LINE_NUMBERS)


@query(
    "metric_card",
    f"""WITH a AS (SELECT sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM orders),
    b AS (SELECT *, {rnd('total * 1.12', 2)} AS target FROM a),
    c AS (SELECT *, {rnd('target * 0.92', 2)} AS benchmark,
      {rnd('total / greatest(target, 1e-4) * 100', 1)} AS achievement_pct FROM b)
    SELECT {rnd('total', 2)} AS total, {rnd('mean', 2)} AS mean, target, benchmark, achievement_pct,
      {rnd('(total - benchmark) / greatest(benchmark, 1e-4) * 100', 1)} AS benchmark_variance_pct,
      CASE WHEN achievement_pct >= 95 THEN 'Ahead of Target' WHEN achievement_pct >= 85
        THEN 'On Track' WHEN achievement_pct >= 70 THEN 'Needs Attention'
        ELSE 'Critical Risk' END AS status FROM c""",
)
def metric_card(t):
    return templates.metric_card(t.orders, "o_totalprice")


@query(
    "metric_sparkline",
    f"""WITH p AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS rn,
      count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
    SELECT (rn - 1) // greatest(1, n // 10) AS chunk, {rnd('sum(value)', 2)} AS value
    FROM p GROUP BY 1 HAVING chunk < 10""",
)
def metric_sparkline(t):
    return templates.metric_sparkline(t.events, "value", ["ts", "event_id"])


@query(
    "metric_card_secondary",
    f"""WITH a AS (SELECT avg(l_quantity) AS m FROM lineitem),
    b AS (SELECT m, {rnd('m * 1.05', 2)} AS target FROM a)
    SELECT {rnd('m', 2)} AS mean, target, {rnd('m / target * 100', 1)} AS achievement_pct FROM b""",
)
def metric_card_secondary(t):
    return templates.secondary_card(t.lineitem, "l_quantity")


@query(
    "top_contributor",
    f"""WITH g AS (SELECT n_name AS label, {rnd('sum(o_totalprice)', 2)} AS value
      FROM ({SALES_SQL}) GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS place,
      sum(value) OVER () AS total, count(*) OVER () AS groups FROM g)
    SELECT place, label, value, {rnd('value / total * 100', 1)} AS share_pct
    FROM r WHERE place <= 2 AND groups > 1""",
)
def top_contributor(t):
    return templates.top_contributor(t.sales(), "n_name", "o_totalprice")
