"""Chart, filter and drill queries."""

from __future__ import annotations

from tidemark.operators import charts, filters
from tidemark.plans.registry import query, rnd
from tidemark.plans.tables import SALES_SQL

SHARE = "CASE WHEN {t} > 0 THEN " + rnd("{v} / {t} * 100", 1) + " ELSE 0.0 END"


def share(value: str, total: str) -> str:
    return SHARE.format(v=value, t=total)


def labelled(label: str, value: str, source: str, tail: str = "") -> str:
    """The general chart: label, rounded value, rows, share of the total of rounded values."""
    return f"""WITH g AS (SELECT {label} AS label, {rnd(value, 2)} AS value, count(*) AS count
      FROM ({source}) GROUP BY 1), t AS (SELECT sum(value) AS total FROM g)
    SELECT label, value, count, {share('value', 'total')} AS percentage FROM g, t {tail}"""


WINDOWED = [
    {"column": "o_orderdate", "operator": "date_range", "value": ["1996-01-01", "1999-12-31"]},
    {"column": "o_orderstatus", "operator": "in", "value": ["F", "O"]},
    {"column": "o_totalprice", "operator": "gte", "value": 50000},
]
WINDOWED_SQL = """SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01'
  AND TIMESTAMP '1999-12-31' AND o_orderstatus IN ('F', 'O') AND o_totalprice >= 50000"""

MONTHLY = labelled("strftime(o_orderdate, '%Y-%m')", "sum(o_totalprice)", "SELECT * FROM orders")


@query("monthly_revenue", MONTHLY)
def monthly_revenue(t):
    return charts.group_measure(
        t.orders, "o_orderdate", "o_totalprice", grain="month", sort_by="label", descending=False
    )


@query(
    "slice_filter",
    labelled("strftime(o_orderdate, '%Y-%m')", "sum(o_totalprice)", WINDOWED_SQL),
)
def sliced(t):
    kept = filters.slice_filter(t.orders, WINDOWED)
    return charts.group_measure(kept, "o_orderdate", "o_totalprice", grain="month", sort_by="label")


@query(
    "cross_filter",
    labelled(
        "c_mktsegment", "sum(o_totalprice)", f"SELECT * FROM ({SALES_SQL}) WHERE r_name = 'ASIA'"
    ),
)
def crossed(t):
    kept = filters.cross_filter(t.sales(), "r_name", "ASIA")
    return charts.group_measure(kept, "c_mktsegment", "o_totalprice")


@query(
    "text_search",
    """SELECT lang, count(*) AS matches, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents
    WHERE contains(lower(text), 'the ') OR contains(lower(source), 'the ') GROUP BY lang""",
)
def searched(t):
    from pyspark.sql import functions as F

    hits = filters.text_search(t.documents, "The ", ["text", "source"])
    return hits.groupBy("lang").agg(
        F.count(F.lit(1)).alias("matches"), F.sum("n_chars").alias("chars")
    )


@query(
    "top_n_membership",
    f"""WITH top AS (SELECT n_name FROM ({SALES_SQL}) GROUP BY 1 ORDER BY count(*) DESC, n_name
      LIMIT 5)
    SELECT n_name, count(*) AS orders, {rnd('sum(o_totalprice)', 2)} AS revenue
    FROM ({SALES_SQL}) WHERE n_name IN (SELECT n_name FROM top) GROUP BY n_name""",
)
def top_membership(t):
    from pyspark.sql import functions as F

    kept = filters.keep_top(t.sales(), "n_name", 5)
    return kept.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )


MEASURES = {
    "sum": "sum(o_totalprice)",
    "avg": "avg(o_totalprice)",
    "min": "min(o_totalprice)",
    "max": "max(o_totalprice)",
    "median": "median(o_totalprice)",
    "count": "count(o_totalprice)",
    "distinct_count": "count(DISTINCT o_totalprice)",
    "pct": "sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) * 100",
}


def _measure_query(agg: str, expression: str) -> None:
    @query(
        f"agg_measure_{agg}", labelled("o_orderpriority", expression, "SELECT * FROM orders")
    )
    def build(t, agg=agg):
        return charts.group_measure(t.orders, "o_orderpriority", "o_totalprice", agg)


for _agg, _expression in MEASURES.items():
    _measure_query(_agg, _expression)


@query("group_measure", labelled("l_returnflag", "sum(l_extendedprice)", "SELECT * FROM lineitem"))
def group_measure(t):
    return charts.group_measure(t.lineitem, "l_returnflag", "l_extendedprice")


@query(
    "group_measure_top_n",
    labelled("p_brand", "avg(l_extendedprice)",
             "SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey",
             "ORDER BY value DESC, label LIMIT 10"),
)
def group_measure_top(t):
    return charts.group_measure(t.items(), "p_brand", "l_extendedprice", "avg", top_n=10)


def grain_case(when: str, grain: str) -> str:
    return f"""CASE {grain} WHEN 'year' THEN strftime({when}, '%Y')
      WHEN 'quarter' THEN strftime({when}, '%Y') || '-Q' || quarter({when})
      WHEN 'month' THEN strftime({when}, '%Y-%m') ELSE strftime({when}, '%Y-%m-%d') END"""


def auto_grain(when: str, table: str) -> str:
    return f"""(SELECT CASE WHEN d > 730 THEN 'year' WHEN d > 180 THEN 'quarter'
      WHEN d > 35 THEN 'month' ELSE 'day' END AS grain FROM
      (SELECT datesub('day', min({when}), max({when})) AS d FROM {table}))"""


@query(
    "date_bucket_auto",
    labelled(grain_case("ts", "grain"), "sum(value)",
             f"SELECT * FROM events, {auto_grain('ts', 'events')} s"),
)
def date_bucket_auto(t):
    return charts.group_measure(t.events, "ts", "value")


@query(
    "date_bucket_auto_year",
    labelled(grain_case("l_shipdate", "grain"), "sum(l_quantity)",
             f"SELECT * FROM lineitem, {auto_grain('l_shipdate', 'lineitem')} s"),
)
def date_bucket_auto_year(t):
    return charts.group_measure(t.lineitem, "l_shipdate", "l_quantity")


@query(
    "date_bucket_quarter",
    labelled(grain_case("o_orderdate", "'quarter'"), "count(*)", "SELECT * FROM orders"),
)
def date_bucket_quarter(t):
    return charts.group_measure(t.orders, "o_orderdate", grain="quarter", sort_by="label")


@query(
    "drill_rollup",
    f"""WITH d AS (SELECT year(o_orderdate) y, quarter(o_orderdate) q, month(o_orderdate) m,
      day(o_orderdate) dd, o_totalprice FROM orders)
    SELECT CASE grouping(y, q, m, dd) WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 3 THEN 'quarter'
        WHEN 7 THEN 'year' ELSE 'all' END AS level,
      CASE grouping(y, q, m, dd) WHEN 0 THEN printf('%04d-%02d-%02d', y, m, dd)
        WHEN 1 THEN printf('%04d-%02d', y, m) WHEN 3 THEN y || '-Q' || q
        WHEN 7 THEN CAST(y AS VARCHAR) ELSE 'all' END AS label,
      {rnd('sum(o_totalprice)', 2)} AS value, count(*) AS count
    FROM d GROUP BY ROLLUP (y, q, m, dd)""",
)
def drill(t):
    return charts.drill_rollup(t.orders, "o_orderdate", "o_totalprice")


def grid_sql(source: str, x: str, y: str, value: str, kx: int, ky: int) -> str:
    return f"""src AS ({source}),
    tx AS (SELECT {x} AS x FROM src GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {kx}),
    ty AS (SELECT {y} AS y FROM src GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {ky}),
    cells AS (SELECT {x} AS x, {y} AS y, {value} AS value FROM src GROUP BY 1, 2),
    grid AS (SELECT tx.x, ty.y, coalesce(c.value, 0) AS value FROM tx CROSS JOIN ty
      LEFT JOIN cells c ON c.x = tx.x AND c.y = ty.y)"""


def stacked_sql(source: str, x: str, y: str, value: str, kx: int, ky: int) -> str:
    return f"""WITH {grid_sql(source, x, y, value, kx, ky)}
    SELECT x AS label, y AS series, {rnd('value', 2)} AS value,
      {rnd('sum(value) OVER (PARTITION BY x)', 2)} AS total FROM grid"""


@query("stacked", stacked_sql(SALES_SQL, "n_name", "o_orderpriority", "sum(o_totalprice)", 10, 6))
def stacked(t):
    return charts.stacked(t.sales(), "n_name", "o_orderpriority", "o_totalprice")


@query(
    "stacked_by_period",
    stacked_sql("SELECT strftime(o_orderdate, '%Y') AS y, * FROM orders", "y", "o_orderstatus",
                "count(*)", 10, 6),
)
def stacked_by_period(t):
    return charts.stacked(t.orders, "o_orderdate", "o_orderstatus", grain="year")


@query(
    "stacked_wide",
    f"""WITH {grid_sql('SELECT * FROM orders', 'o_orderpriority', 'o_orderstatus',
                       'sum(o_totalprice)', 10, 6)}
    SELECT x AS label, {rnd("sum(value)", 2)} AS total,
      {rnd("sum(value) FILTER (y = 'F')", 2)} AS F, {rnd("sum(value) FILTER (y = 'O')", 2)} AS O,
      {rnd("sum(value) FILTER (y = 'P')", 2)} AS P FROM grid GROUP BY x""",
)
def stacked_wide(t):
    grid = charts.stacked(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice")
    return charts.stacked_wide(grid, ["F", "O", "P"])


def heat_sql(source: str, x: str, y: str, value: str, kx: int = 8, ky: int = 8) -> str:
    spread = "CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END"
    return f"""WITH {grid_sql(source, x, y, value, kx, ky)},
    lim AS (SELECT min(value) AS lo, max(value) AS hi FROM grid)
    SELECT x, y, {rnd('value', 2)} AS value,
      {rnd(f"({rnd('value', 2)} - lo) / ({spread})", 3)} AS intensity FROM grid, lim"""


@query("heatmap", heat_sql(SALES_SQL, "n_name", "c_mktsegment", "sum(o_totalprice)"))
def heatmap(t):
    return charts.heatmap(t.sales(), "n_name", "c_mktsegment", "o_totalprice")


@query("heatmap_median", heat_sql("SELECT * FROM lineitem", "l_returnflag", "l_linestatus",
                                  "median(l_extendedprice)"))
def heatmap_median(t):
    return charts.heatmap(t.lineitem, "l_returnflag", "l_linestatus", "l_extendedprice", "median")


@query(
    "combo",
    f"""SELECT c_mktsegment AS label, {rnd('sum(o_totalprice)', 2)} AS "primary",
      {rnd('avg(c_acctbal)', 2)} AS secondary FROM ({SALES_SQL}) GROUP BY 1""",
)
def combo(t):
    return charts.combo(t.sales(), "c_mktsegment", "o_totalprice", "c_acctbal")


@query(
    "treemap",
    f"""WITH g AS (SELECT p_type AS label, sum(l_extendedprice) AS v FROM lineitem
      JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY v DESC, label LIMIT 8)
    SELECT label, {rnd('v', 2)} AS value, {rnd('v / (SELECT sum(v) FROM g) * 100', 1)} AS pct
    FROM g""",
)
def treemap(t):
    return charts.treemap(t.items(), "p_type", "l_extendedprice", top_n=8)


def funnel_sql(source: str, by: str, value: str, limit: str = "") -> str:
    base = "CASE WHEN first_v > 0 THEN first_v ELSE 1.0 END"
    return f"""WITH g AS (SELECT {by} AS stage, CAST({value} AS DOUBLE) AS v FROM ({source})
      GROUP BY 1 ORDER BY v DESC, stage {limit}),
    o AS (SELECT row_number() OVER w AS position, stage, v, first_value(v) OVER w AS first_v,
      lag(v) OVER w AS prev FROM g WINDOW w AS (ORDER BY v DESC, stage))
    SELECT position, stage, {rnd('v', 2)} AS value, {rnd(f'v / ({base}) * 100', 1)} AS pct_of_first,
      CASE WHEN coalesce(prev, {base}) > 0 THEN {rnd(f'v / coalesce(prev, {base}) * 100', 1)}
        ELSE 100.0 END AS pct_of_prev FROM o"""


@query("funnel", funnel_sql("SELECT * FROM events", "event_type", "count(*)"))
def funnel(t):
    return charts.funnel(t.events, "event_type")


@query("funnel_top_n", funnel_sql(SALES_SQL, "n_name", "sum(o_totalprice)", "LIMIT 5"))
def funnel_top(t):
    return charts.funnel(t.sales(), "n_name", "o_totalprice", top_n=5)


BOX = """boxes AS (SELECT {by} AS category, count({v}) AS n, quantile_cont({v}, 0.25) AS q1,
    median({v}) AS med, quantile_cont({v}, 0.75) AS q3, min({v}) AS lo, max({v}) AS hi
  FROM ({source}) WHERE {by} IN (SELECT {by} FROM ({source}) GROUP BY 1
    ORDER BY count(*) DESC, 1 LIMIT {k}) GROUP BY 1 HAVING count({v}) >= 4),
  fenced AS (SELECT *, greatest(lo, q1 - 1.5 * (q3 - q1)) AS low,
    least(hi, q3 + 1.5 * (q3 - q1)) AS high FROM boxes)"""


def box_sql(source: str, by: str, value: str, k: int = 8) -> str:
    return f"""WITH {BOX.format(by=by, v=value, source=source, k=k)}
    SELECT category, n AS count, {rnd('low', 2)} AS min, {rnd('q1', 2)} AS q1,
      {rnd('med', 2)} AS median, {rnd('q3', 2)} AS q3, {rnd('high', 2)} AS max FROM fenced"""


@query("box_plot", box_sql("SELECT * FROM events", "event_type", "value"))
def box_plot(t):
    return charts.box_plot(t.events, "value", "event_type")


@query("box_plot_overall", box_sql("SELECT 'o_totalprice' AS c, * FROM orders", "c", "o_totalprice"))
def box_plot_overall(t):
    return charts.box_plot(t.orders, "o_totalprice")


@query(
    "box_plot_outliers",
    f"""WITH {BOX.format(by='event_type', v='value', source='SELECT * FROM events', k=8)},
    o AS (SELECT event_type AS category, value,
      row_number() OVER (PARTITION BY event_type ORDER BY value) AS position
      FROM events JOIN fenced ON event_type = category WHERE value < low OR value > high)
    SELECT category, position, value FROM o WHERE position <= 20""",
)
def box_outliers(t):
    return charts.box_outliers(t.events, "value", "event_type")


def histogram_sql(table: str, value: str, least: int = 6) -> str:
    return f"""WITH lim AS (SELECT count({value}) AS n, min({value}) AS lo, max({value}) AS hi,
      CAST(least(20, greatest({least}, ceil(log2(count({value})) + 1))) AS INT) AS b FROM {table}),
    hits AS (SELECT CAST(least(floor(({value} - lo) * b / (hi - lo)), b - 1) AS INT) AS bin,
      count(*) AS c FROM {table}, lim WHERE {value} IS NOT NULL GROUP BY 1),
    bins AS (SELECT CAST(unnest(range(b)) AS INT) AS bin, * FROM lim WHERE lo < hi)
    SELECT bins.bin, {rnd('lo + (hi - lo) / b * bins.bin', 6)} AS lower,
      {rnd('lo + (hi - lo) / b * (bins.bin + 1)', 6)} AS upper, coalesce(c, 0) AS count,
      {rnd('coalesce(c, 0) / n * 100', 1)} AS frequency
    FROM bins LEFT JOIN hits ON bins.bin = hits.bin"""


@query("histogram", histogram_sql("lineitem", "l_extendedprice"))
def histogram(t):
    return charts.histogram(t.lineitem, "l_extendedprice")


@query(
    "scatter",
    """SELECT l_quantity AS x, l_extendedprice AS y, 10.0::DOUBLE AS size
    FROM (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
        || strftime(l_shipdate, '%Y%m%d') AS k FROM lineitem)
    ORDER BY md5(k), k LIMIT 600""",
)
def scatter(t):
    from pyspark.sql import functions as F

    keyed = t.lineitem.withColumn(
        "k",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")),
    )
    return charts.scatter(keyed, "l_quantity", "l_extendedprice", "k")


@query(
    "bubble",
    """SELECT o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, CAST(o_orderkey AS DOUBLE) AS size
    FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 600""",
)
def bubble(t):
    return charts.scatter(t.orders, "o_totalprice", "o_custkey", "o_orderkey", size="o_orderkey")


def gauge_sql(table: str, value: str, column: str, low: str, high: str) -> str:
    return f"""WITH g AS (SELECT {value} AS v, {low} AS lo, {high} AS hi FROM {table})
    SELECT {rnd('v', 2)} AS value, {rnd('lo', 2)} AS min, {rnd('hi', 2)} AS max,
      {rnd('hi * 0.8', 2)} AS target, greatest(0.0, least(100.0, CASE WHEN hi > lo
        THEN {rnd('(v - lo) / (hi - lo) * 100', 1)} ELSE 50.0 END)) AS pct FROM g"""


@query("gauge", gauge_sql("orders", "avg(o_totalprice)", "o_totalprice", "min(o_totalprice)",
                          "max(o_totalprice)"))
def gauge(t):
    return charts.gauge(t.orders, "o_totalprice", "avg")


@query("gauge_sum", gauge_sql("events", "sum(value)", "value", "0.0", "max(value)"))
def gauge_sum(t):
    return charts.gauge(t.events, "value", "sum")


@query(
    "kpi_card",
    f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn,
      count(*) OVER () AS n FROM orders),
    a AS (SELECT sum(o_totalprice) AS v, sum(o_totalprice) FILTER (rn <= n // 2) AS prior,
      count(*) AS total_rows FROM p)
    SELECT {rnd('v', 2)} AS value, {rnd('prior', 2)} AS prior_value,
      {rnd('(v - prior) / abs(prior) * 100', 2)} AS variance_pct,
      {rnd('v - prior', 2)} AS variance_abs, {rnd('v * 1.15', 2)} AS target,
      {rnd(f"v / {rnd('v * 1.15', 2)} * 100", 1)} AS achievement_pct, total_rows FROM a""",
)
def kpi_card(t):
    return charts.kpi_card(t.orders, "o_totalprice", ["o_orderdate", "o_orderkey"])


@query(
    "kpi_sparkline",
    f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn,
      count(*) OVER () AS n FROM orders)
    SELECT (rn - 1) // greatest(1, n // 8) AS chunk, CAST(min(o_orderdate) AS DATE) AS period,
      {rnd('sum(o_totalprice)', 2)} AS value FROM p GROUP BY 1""",
)
def kpi_sparkline(t):
    return charts.kpi_sparkline(t.orders, "o_totalprice", ["o_orderdate", "o_orderkey"])


@query(
    "group_counts",
    """SELECT p_name AS label, count(*) AS value FROM part WHERE p_name IS NOT NULL GROUP BY 1
    ORDER BY value DESC, label LIMIT 50""",
)
def group_counts(t):
    return charts.group_counts(t.part, "p_name")


@query(
    "group_sums",
    f"""SELECT n_name AS label, {rnd('sum(o_totalprice)', 2)} AS value FROM ({SALES_SQL})
    GROUP BY 1 ORDER BY value DESC, label LIMIT 10""",
)
def group_sums(t):
    return charts.group_sums(t.sales(), "n_name", "o_totalprice")


@query(
    "metric_by_dimension",
    f"""SELECT p_brand AS label, {rnd('avg(p_retailprice)', 3)} AS value FROM part
    GROUP BY 1 ORDER BY value DESC, label LIMIT 10""",
)
def metric_by_dimension(t):
    return charts.metric_by_dimension(t.part, "p_brand", "p_retailprice")


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey"]


def correlations_sql(table: str, columns: list[str]) -> str:
    pairs = [
        f"SELECT '{a}' AS x, '{b}' AS y, {rnd(f'corr({a}, {b})', 4)} AS pearson, "
        f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS sample_size FROM {table}"
        for i, a in enumerate(columns)
        for b in columns[i + 1:]
    ]
    return " UNION ALL ".join(pairs)


@query("correlations", correlations_sql("lineitem", LINE_NUMBERS))
def correlations(t):
    return charts.correlations(t.lineitem, LINE_NUMBERS)
