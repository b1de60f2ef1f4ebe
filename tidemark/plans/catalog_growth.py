"""Customer growth, anomaly, rule and forecast queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.fixed_values import CHURN_TIERS, HOLT, OLS, SEGMENT_NOTES, WMA
from tidemark.operators import anomalies, forecast, growth, isolation, kpis, series
from tidemark.plans.catalog_business import FORECAST_GRAINS, KPI_SOURCE, kpi_table, series_sql
from tidemark.plans.registry import query, rnd
from tidemark.session import literal_rows

BUYER = ("o_custkey", "o_orderdate", "o_totalprice")

SCORE = "CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil(({r} - 1) * least(5, n) / (n - 1))) END AS INT)"
PEOPLE = f"""people AS (SELECT o_custkey AS customer,
    datesub('day', max(o_orderdate), (SELECT max(o_orderdate) + INTERVAL 1 DAY FROM orders))
      AS recency_days,
    count(*) AS frequency, {rnd('sum(o_totalprice)', 2)} AS monetary FROM orders GROUP BY 1),
  ranked AS (SELECT *, row_number() OVER (ORDER BY recency_days DESC, customer) AS rr,
    row_number() OVER (ORDER BY frequency, customer) AS fr,
    row_number() OVER (ORDER BY monetary, customer) AS mr, count(*) OVER () AS n FROM people),
  scores AS (SELECT customer, recency_days, frequency, monetary, {SCORE.format(r='rr')} AS r_score,
    {SCORE.format(r='fr')} AS f_score, {SCORE.format(r='mr')} AS m_score FROM ranked)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def notes(part: int) -> str:
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v[part])}" for k, v in SEGMENT_NOTES.items())
    return f"CASE segment {cases} END"


SEGMENTS = f"""segments AS (SELECT *, CASE
    WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
    WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'Loyal Customers'
    WHEN r_score >= 4 AND f_score <= 3 AND m_score >= 2 THEN 'Potential Loyalists'
    WHEN r_score >= 4 AND f_score = 1 THEN 'New Customers'
    WHEN r_score >= 3 AND f_score <= 2 AND m_score <= 2 THEN 'Promising'
    WHEN r_score = 3 AND f_score >= 2 THEN 'Need Attention'
    WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk'
    WHEN r_score <= 2 AND f_score <= 2 AND m_score >= 3 THEN 'Can''t Lose Them'
    WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Hibernating'
    ELSE 'Lost' END AS segment, r_score || '' || f_score || m_score AS rfm_score FROM scores),
  noted AS (SELECT *, {notes(0)} AS tier, {notes(1)} AS action FROM segments)"""
SUMMARY = f"""summary AS (SELECT segment, first(tier) AS tier, count(*) AS customers,
    {rnd('count(*) / (SELECT count(*) FROM noted) * 100', 1)} AS customer_share_pct,
    {rnd('sum(monetary)', 2)} AS revenue,
    {rnd('sum(monetary) / (SELECT sum(monetary) FROM noted) * 100', 1)} AS revenue_share_pct,
    {rnd('avg(monetary)', 2)} AS avg_monetary, {rnd('avg(frequency)', 1)} AS avg_frequency,
    {rnd('avg(recency_days)', 0)} AS avg_recency_days FROM noted GROUP BY segment)"""


@query(
    "detect_roles",
    " UNION ALL ".join(
        f"SELECT '{role}' AS role, '{c}' AS \"column\", count({c}) AS filled FROM ({KPI_SOURCE})"
        for role, c in (("customer", "customer_id"), ("monetary", "revenue"), ("category", "country"))
    ),
)
def detect_roles(t):
    return growth.role_columns(kpi_table(t))


@query("rfm_scores", f"WITH {PEOPLE} SELECT * FROM scores")
def rfm_scores(t):
    return growth.rfm_scores(t.orders, *BUYER)


@query("rfm_segments", f"WITH {PEOPLE}, {SEGMENTS} SELECT * FROM noted")
def rfm_segments(t):
    return growth.rfm_segments(growth.rfm_scores(t.orders, *BUYER))


@query("rfm_summary", f"WITH {PEOPLE}, {SEGMENTS}, {SUMMARY} SELECT * FROM summary")
def rfm_summary(t):
    return growth.rfm_summary(growth.rfm_segments(growth.rfm_scores(t.orders, *BUYER)))


@query(
    "rfm_totals",
    f"""WITH {PEOPLE}, {SEGMENTS}, {SUMMARY}
    SELECT CAST(sum(customers) AS BIGINT) AS total_customers, {rnd('sum(revenue)', 2)} AS total_revenue,
      {rnd('sum(revenue) / sum(customers)', 2)} AS avg_customer_value,
      coalesce(max(revenue_share_pct) FILTER (segment = 'Champions'), 0) AS champions_share_pct,
      {rnd("coalesce(sum(revenue) FILTER (segment IN ('At Risk', 'Can''t Lose Them')), 0)", 2)}
        AS at_risk_revenue FROM summary""",
)
def rfm_totals(t):
    segments = growth.rfm_segments(growth.rfm_scores(t.orders, *BUYER))
    return growth.rfm_totals(growth.rfm_summary(segments))


def cohort_sql(table: str, customer: str, date: str) -> str:
    return f"""months AS (SELECT DISTINCT {customer} AS customer,
      CAST(date_trunc('month', {date}) AS DATE) AS month FROM {table}),
    aged AS (SELECT *, min(month) OVER (PARTITION BY customer) AS cohort FROM months),
    counts AS (SELECT cohort, CAST(datediff('month', cohort, month) AS INT) AS period,
      count(*) AS customers FROM aged GROUP BY 1, 2),
    matrix AS (SELECT cohort, s.customers AS cohort_size, period, c.customers,
      {rnd('c.customers / s.customers * 100', 1)} AS retention_pct
      FROM counts c JOIN (SELECT cohort, customers FROM counts WHERE period = 0) s USING (cohort)
      WHERE period <= 6)"""


COHORTS = cohort_sql("orders", "o_custkey", "o_orderdate")


def cohorts(t):
    return growth.cohort_matrix(growth.cohort_counts(t.orders, "o_custkey", "o_orderdate"))


@query("cohort_counts", f"WITH {COHORTS} SELECT * FROM counts")
def cohort_counts(t):
    return growth.cohort_counts(t.orders, "o_custkey", "o_orderdate")


@query("cohort_matrix", f"WITH {COHORTS} SELECT * FROM matrix")
def cohort_matrix(t):
    return cohorts(t)


@query(
    "cohort_table",
    f"WITH {COHORTS} SELECT cohort, cohort_size, "
    + ", ".join(f"max(retention_pct) FILTER (period = {p}) AS m{p}" for p in range(7))
    + " FROM matrix GROUP BY 1, 2",
)
def cohort_table(t):
    return growth.cohort_table(cohorts(t))


@query(
    "retention_curve",
    f"""WITH {COHORTS}, c AS (SELECT period, {rnd('avg(retention_pct)', 1)} AS a FROM matrix GROUP BY 1)
    SELECT period, a AS average_retention_pct, {rnd('100 - a', 1)} AS churn_pct FROM c""",
)
def retention_curve(t):
    return growth.retention_curve(cohorts(t))


HIGH, MEDIUM, LOW = (quoted(tier) for tier in CHURN_TIERS)
CLV = f"""base AS (SELECT o_custkey AS customer, min(o_orderdate) AS f, max(o_orderdate) AS l,
    CAST(count(*) AS DOUBLE) AS n, sum(o_totalprice) AS spend FROM orders GROUP BY 1),
  aged AS (SELECT *, spend / n AS aov, greatest(1, datesub('day', f, as_of)) AS tenure,
    datesub('day', l, as_of) AS recency FROM base,
    (SELECT max(o_orderdate) + INTERVAL 1 DAY AS as_of FROM orders)),
  odds AS (SELECT *, least(0.98, greatest(0.02, {rnd(
      '1.0 / (1.0 + exp(-1.5 * (recency / greatest(tenure / n, 7.0) - 1.8)))', 3)})) AS churn
    FROM aged),
  clv AS (SELECT customer, {rnd('spend', 2)} AS historic_spend, CAST(n AS BIGINT) AS order_count,
    {rnd('aov', 2)} AS aov, recency AS recency_days, tenure AS tenure_days,
    churn AS churn_probability,
    CASE WHEN churn >= 0.7 THEN {HIGH} WHEN churn >= 0.4 THEN {MEDIUM} ELSE {LOW} END
      AS churn_risk_tier,
    {rnd('aov * least(30.0, greatest(0.1, n / (tenure / 30.0))) * 12.0 * (1.0 - churn)', 2)}
      AS predicted_annual_clv FROM odds)"""


@query("clv_churn", f"WITH {CLV} SELECT * FROM clv")
def clv_churn(t):
    return growth.clv_churn(t.orders, *BUYER)


@query("clv_top_customers",
       f"WITH {CLV} SELECT * FROM clv ORDER BY historic_spend DESC, customer LIMIT 15")
def clv_top_customers(t):
    return growth.top_customers(growth.clv_churn(t.orders, *BUYER))


@query(
    "churn_breakdown",
    f"""WITH {CLV}, tiers AS (SELECT unnest([{HIGH}, {MEDIUM}, {LOW}]) AS tier)
    SELECT tier, count(customer) AS customers, CASE WHEN tier = {LOW} THEN 0.0
      ELSE {rnd('coalesce(sum(historic_spend), 0)', 2)} END AS revenue_at_risk
    FROM tiers LEFT JOIN clv ON churn_risk_tier = tier GROUP BY tier""",
)
def churn_breakdown(t):
    return growth.churn_breakdown(growth.clv_churn(t.orders, *BUYER))


@query(
    "clv_summary",
    f"""WITH {CLV}, p AS (SELECT *, row_number() OVER (ORDER BY historic_spend DESC, customer) AS rn,
      count(*) OVER () AS n FROM clv)
    SELECT count(*) AS total_customers, {rnd('sum(historic_spend) / count(*)', 2)} AS average_historic_clv,
      {rnd('avg(predicted_annual_clv)', 2)} AS average_predicted_annual_clv,
      {rnd('sum(historic_spend) FILTER (rn <= greatest(1, n // 10)) / sum(historic_spend) * 100', 1)}
        AS whale_share_pct,
      {rnd(f'count(*) FILTER (churn_risk_tier = {HIGH}) / count(*) * 100', 1)} AS churn_rate_pct,
      {rnd(f'coalesce(sum(historic_spend) FILTER (churn_risk_tier = {HIGH}), 0)', 2)}
        AS at_risk_revenue FROM p""",
)
def clv_summary(t):
    return growth.clv_summary(growth.clv_churn(t.orders, *BUYER))


@query(
    "unit_economics",
    f"""WITH b AS (SELECT c_mktsegment AS segment, sum(o_totalprice) AS rev,
      count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey
      GROUP BY 1),
    c AS (SELECT *, {rnd('rev * 0.18 / greatest(customers, 1)', 2)} AS cac,
      {rnd('rev / greatest(customers, 1) * 3.2', 2)} AS ltv FROM b),
    d AS (SELECT *, {rnd('ltv / greatest(cac, 1.0)', 2)} AS ltv_cac, {rnd('ltv / 36.0', 2)} AS arpu
      FROM c)
    SELECT segment, {rnd('rev', 2)} AS revenue, customers, cac, ltv, ltv_cac,
      CASE WHEN ltv_cac >= 4 THEN 'Elite' WHEN ltv_cac >= 3 THEN 'Strong'
        WHEN ltv_cac >= 1.5 THEN 'Acceptable' ELSE 'Sub-Optimal' END AS grade, arpu,
      {rnd('cac / greatest(arpu * 0.745, 1.0)', 1)} AS payback_months,
      {rnd(f"rev / greatest({rnd('cac * customers', 2)}, 1.0)", 2)} AS roas,
      CAST(least(100, floor(ltv_cac * 25)) AS INT) AS efficiency_score FROM d""",
)
def unit_economics(t):
    joined = t.orders.join(t.customer, t.orders["o_custkey"] == t.customer["c_custkey"])
    return growth.unit_economics(joined, "c_mktsegment", "o_totalprice", "o_custkey")


@query(
    "business_baseline",
    f"""WITH b AS (SELECT l_returnflag AS segment, sum(l_extendedprice) AS rev, sum(l_quantity) AS vol
      FROM lineitem GROUP BY 1),
    c AS (SELECT *, {rnd('rev * 0.28', 2)} AS cogs, {rnd('rev * 0.18', 2)} AS marketing,
      {rnd('rev * 0.35', 2)} AS operating FROM b),
    d AS (SELECT *, {rnd('rev - cogs', 2)} AS gross_profit FROM c)
    SELECT segment, {rnd('rev', 2)} AS revenue, {rnd('vol', 0)} AS volume,
      {rnd('rev / greatest(vol, 1.0)', 2)} AS avg_price, cogs, gross_profit, marketing, operating,
      {rnd('gross_profit - (marketing + operating)', 2)} AS net_profit,
      {rnd('marketing / greatest(vol * 0.25, 1.0)', 2)} AS cac FROM d""",
)
def business_baseline(t):
    return growth.business_baseline(t.lineitem, "l_returnflag", "l_extendedprice", "l_quantity")


# Anomalies --------------------------------------------------------------------------------------

DAILY = series_sql("events", "ts", "sum(value)", "event_type")


def rolling_sql(ser: str, key: str, k: float) -> str:
    return f"""w AS (SELECT {key}, period, value, row_number() OVER p AS pos,
      CAST(sum(CAST(value AS DECIMAL(30,6))) OVER h AS DOUBLE) / count(value) OVER h AS mean, stddev_pop(value) OVER h AS std,
      array_to_string(list(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)) OVER a, '|') AS neighbours
      FROM ({ser}) WINDOW p AS (PARTITION BY {key} ORDER BY period),
      h AS (PARTITION BY {key} ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
      a AS (PARTITION BY {key} ORDER BY period ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    j AS (SELECT *, greatest(0.0, mean - {k} * std) AS low, mean + {k} * std AS high,
      (value - mean) / greatest(mean, 1e-6) * 100 AS dev,
      abs((value - mean) / greatest(std, 1e-6)) AS z FROM w WHERE pos > 3),
    rolled AS (SELECT {key}, period, {rnd('value', 2)} AS observed, {rnd('low', 2)} AS expected_low,
      {rnd('high', 2)} AS expected_high, {rnd('dev', 1)} AS deviation_pct, {rnd('z', 2)} AS z_score,
      CASE WHEN abs(dev) >= 50 OR z >= 3.5 THEN 'critical' WHEN abs(dev) >= 30 OR z >= 2.5
        THEN 'high' WHEN abs(dev) >= 15 OR z >= 1.8 THEN 'medium' ELSE 'low' END AS severity,
      CASE WHEN value > mean THEN 'spike' ELSE 'drop' END AS direction,
      {rnd('mean', 2)} AS baseline_mean, {rnd('std', 2)} AS baseline_std, neighbours
      FROM j WHERE value < low OR value > high)"""


ROLLED = rolling_sql(DAILY, "event_type", 2.0)


def daily_anomalies(t, sensitivity="medium"):
    line = series.time_series(t.events, "ts", "value", ["event_type"])
    found = anomalies.rolling_anomalies(line, ["event_type"], sensitivity)
    near = F.transform("neighbours", lambda v: v.cast("decimal(18,2)").cast("string"))
    return found.withColumn("neighbours", F.array_join(near, "|"))


@query("rolling_anomalies", f"WITH {ROLLED} SELECT * FROM rolled")
def rolling_anomalies(t):
    return daily_anomalies(t)


@query(
    "rolling_anomalies_high",
    f"WITH {rolling_sql(DAILY, 'event_type', 1.5)} SELECT * FROM rolled",
)
def rolling_anomalies_high(t):
    return daily_anomalies(t, "high")


def rank_sql(source: str) -> str:
    return f"""SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2
      ELSE 3 END AS severity_rank FROM {source}"""


@query("rank_anomalies", f"WITH {ROLLED} {rank_sql('rolled')}")
def rank_anomalies(t):
    return anomalies.rank_anomalies(daily_anomalies(t), "event_type", "period")


@query(
    "anomaly_posture",
    f"""WITH {ROLLED}, c AS (SELECT count(*) FILTER (severity IN ('critical', 'high')) AS severe,
      count(*) FILTER (severity IN ('medium', 'low')) AS mild FROM rolled)
    SELECT *, CASE WHEN severe > 0 THEN 'Elevated' WHEN mild > 0 THEN 'Moderate' ELSE 'Low' END
      AS risk_level FROM c""",
)
def anomaly_posture(t):
    return anomalies.anomaly_posture(daily_anomalies(t))


def iqr_sql(table: str, columns: list[str], k: float) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM {table}" for c in columns)
    return f"""WITH l AS (SELECT * FROM ({parts}) WHERE v IS NOT NULL),
    b AS (SELECT "column" AS c, count(*) AS n, count(DISTINCT v) AS d, quantile_cont(v, 0.25) AS q25,
      quantile_cont(v, 0.75) AS q75, avg(v) AS mean, stddev_samp(v) AS std FROM l GROUP BY 1),
    f AS (SELECT *, q25 - {k} * (q75 - q25) AS low, q75 + {k} * (q75 - q25) AS high FROM b
      WHERE n >= 8 AND d >= 4 AND q75 > q25),
    o AS (SELECT "column", mean, std, q25, q75, low, high, count(*) FILTER (v > high) AS above,
      count(*) FILTER (v < low) AS below,
      coalesce(max(v) FILTER (v > high), min(v) FILTER (v < low)) AS extreme
      FROM l JOIN f ON "column" = c GROUP BY ALL),
    s AS (SELECT *, {rnd('abs(extreme - mean) / greatest(std, 1e-6)', 2)} AS deviation_score FROM o
      WHERE above + below > 0)
    SELECT "column", {rnd('extreme', 2)} AS observed, {rnd('low', 2)} AS expected_low,
      {rnd('high', 2)} AS expected_high, above, below, deviation_score,
      CASE WHEN deviation_score >= 4 THEN 'critical' WHEN deviation_score >= 2.5 THEN 'high'
        ELSE 'medium' END AS severity, {rnd('q25', 2)} AS q25, {rnd('q75', 2)} AS q75,
      {rnd('mean', 2)} AS mean, {rnd('std', 2)} AS std FROM s"""


@query("iqr_anomalies", iqr_sql("events", ["value", "user_id", "event_id"], 2.0))
def iqr_anomalies(t):
    return anomalies.iqr_anomalies(t.events, ["value", "user_id", "event_id"])


@query("iqr_anomalies_high", iqr_sql("documents", ["n_chars", "doc_id"], 1.5))
def iqr_anomalies_high(t):
    return anomalies.iqr_anomalies(t.documents, ["n_chars", "doc_id"], "high")


def forest_sql(table: str, value: str, key: str, trees: int = 100, sample: int = 256, cut: float = 0.05, seed: int = 42) -> str:
    """The isolation forest grown level by level, a named query for each."""
    depth = math.ceil(math.log2(sample))
    hexed = "CAST('0x' || substr(md5({}), 1, {}) AS BIGINT)"
    place = hexed.format(f"'{seed}:' || CAST({key} AS VARCHAR)", 7)
    chance = hexed.format(f"'{seed}:' || CAST(tree AS VARCHAR) || ':' || CAST(node AS VARCHAR)", 13) + " / CAST(16 AS DOUBLE) ** 13"
    expected = ("(CASE WHEN {0} <= 1 THEN 0.0 WHEN {0} = 2 THEN 1.0 ELSE "
                "2.0 * (ln({0} - 1) + 0.5772156649015329) - 2.0 * ({0} - 1) / {0} END)")
    parts = [
        f"""m0 AS (SELECT tree, 1 AS node, v, CAST('inf' AS DOUBLE) AS upto FROM (SELECT {place} % {trees} AS tree,
          {value} AS v, row_number() OVER (PARTITION BY {place} % {trees}
            ORDER BY md5('{seed + 1}:' || CAST({key} AS VARCHAR)), {value}) AS position
          FROM {table} WHERE {value} IS NOT NULL) WHERE position <= {sample})""",
        "sizes AS (SELECT tree, count(*) AS size, ceil(log2(greatest(count(*), 2))) AS deepest FROM m0 GROUP BY tree)",
    ]
    for k in range(depth + 1):
        parts.append(f"""n{k} AS (SELECT tree, node, any_value(upto) AS upto, count(*) AS n, min(v) AS lo, max(v) AS hi,
          any_value(size) AS size, any_value(deepest) AS deepest FROM m{k} JOIN sizes USING (tree) GROUP BY tree, node)""")
        parts.append(f"""s{k} AS (SELECT *, lo + {chance} * (hi - lo) AS cut FROM n{k}
          WHERE n > 1 AND lo < hi AND {k} < deepest)""")
        parts.append(f"""l{k} AS (SELECT tree, upto, ({k} + {expected.format('n')}) / greatest({expected.format('size')}, 1e-12) AS path
          FROM n{k} WHERE NOT (n > 1 AND lo < hi AND {k} < deepest))""")
        parts.append(f"""m{k + 1} AS (SELECT m.tree, 2 * m.node + CASE WHEN m.v <= s.cut THEN 0 ELSE 1 END AS node, m.v,
          CASE WHEN m.v <= s.cut THEN s.cut ELSE m.upto END AS upto FROM m{k} m JOIN s{k} s ON m.tree = s.tree AND m.node = s.node)""")
    parts += [
        "leaves AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(depth + 1)) + ")",
        f"vals AS (SELECT {value} AS v, count(*) AS hits FROM {table} WHERE {value} IS NOT NULL GROUP BY 1)",
        """scored AS (SELECT q.v, any_value(q.hits) AS hits, round(2.0 ** (-avg(l.path)), 9) AS score
          FROM (SELECT v, hits, tree FROM vals, sizes) q ASOF JOIN leaves l ON q.tree = l.tree AND q.v <= l.upto GROUP BY q.v)""",
        """ranked AS (SELECT score, sum(hits) AS hits, sum(sum(hits)) OVER (ORDER BY score) AS upto,
          sum(sum(hits)) OVER () AS n FROM scored GROUP BY score)""",
        f"cutting AS (SELECT min(score) AS cut FROM ranked WHERE upto >= ceil(n * (1 - {cut})))",
    ]
    return (
        "WITH " + ",\n".join(parts)
        + """ SELECT CAST(max(n) AS BIGINT) AS rows, CAST(coalesce(sum(hits) FILTER (score > cut), 0) AS BIGINT) AS flagged,
        max(cut) AS cut_score FROM ranked, cutting"""
    )


@query("isolation_forest_flags", forest_sql("events", "value", "event_id"))
def isolation_forest_flags(t):
    return isolation.isolation_forest_flags(t.events, "value", "event_id")


RULES = [
    (1, "Unusual volume", "anomaly", "value", None, None, "high"),
    (2, "Revenue above plan", "threshold", "revenue", "gt", 1000000.0, "medium"),
    (3, "Low order value", "threshold", "order_value", "lt", 200000.0, "low"),
    (4, "Any total", "threshold", "total", "gt", 0.0, "low"),
    (5, "Growth swing", "threshold", "growth", "pct_change", 5.0, "medium"),
    (6, "Never", "threshold", "revenue", "lt", 0.0, "high"),
]
RULE_SCHEMA = (
    "rule_id int, name string, alert_type string, metric string, condition string, "
    "threshold double, severity string"
)
KPI_SQL = f"""kp AS (SELECT 0 AS position, 'Total Revenue' AS label, 'currency' AS format,
    {rnd('sum(o_totalprice)', 2)} AS value FROM orders
  UNION ALL SELECT 1, 'Average Order Value', 'currency',
    {rnd('sum(o_totalprice) / count(DISTINCT o_orderkey)', 2)} FROM orders
  UNION ALL SELECT 2, 'Revenue Growth', 'percent', {rnd('''(SELECT (max(value) FILTER (r = 1)
    / max(value) FILTER (r = 2) - 1) * 100 FROM (SELECT value,
    row_number() OVER (ORDER BY period DESC) AS r FROM ''' + "(" + series_sql("orders", "o_orderdate", "sum(o_totalprice)") + ")))", 2)})"""


def rule_values() -> str:
    def literal(v):
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else repr(v)

    rows = ", ".join("(" + ", ".join(literal(v) for v in rule) + ")" for rule in RULES)
    return f"(VALUES {rows}) AS r(rule_id, name, alert_type, metric, condition, threshold, severity)"


@query(
    "evaluate_rules",
    f"""WITH {ROLLED}, {KPI_SQL},
    hit AS (SELECT rule_id, name, severity, label, value, row_number() OVER (PARTITION BY rule_id
      ORDER BY position) AS first FROM {rule_values()} JOIN kp
      ON (contains(lower(label), lower(metric))
          OR contains(replace(lower(label), ' ', '_'), lower(metric)))
      AND alert_type <> 'anomaly' AND ((condition = 'gt' AND value > threshold)
        OR (condition = 'lt' AND value < threshold)
        OR (condition = 'pct_change' AND format = 'percent' AND abs(value) > threshold)))
    SELECT rule_id, name, severity, label, value FROM hit WHERE first = 1
    UNION ALL SELECT rule_id, name, severity, 'Anomalies', n FROM {rule_values()},
      (SELECT CAST(count(*) AS DOUBLE) AS n FROM rolled) WHERE alert_type = 'anomaly' AND n > 0""",
)
def evaluate_rules(t):
    orders = t.orders.withColumnRenamed("o_totalprice", "revenue")
    line = series.time_series(orders, "o_orderdate", "revenue")
    numbers = kpis.kpi_revenue(orders, "revenue", order_id="o_orderkey", series=line)
    rules = literal_rows(t.spark, RULES, RULE_SCHEMA)
    return anomalies.evaluate_rules(numbers, rules, daily_anomalies(t))


# Forecasts --------------------------------------------------------------------------------------

KEY = "o_orderpriority"
FIT_SERIES = f"""ser AS ({series_sql('orders', 'o_orderdate', 'sum(o_totalprice)', KEY, FORECAST_GRAINS)}),
  p AS (SELECT {KEY} AS k, grain, period, value, row_number() OVER (PARTITION BY {KEY}
    ORDER BY period) - 1 AS t, count(*) OVER (PARTITION BY {KEY}) AS n FROM ser),
  q AS (SELECT *, CASE WHEN n >= 5 THEN greatest(2, n * 4 // 5) ELSE n - 1 END AS m FROM p
    WHERE n >= 3),
  h AS (SELECT a.k, a.t, a.n, a.m, a.value AS level, b.value - a.value AS trend
    FROM q a JOIN q b ON a.k = b.k AND a.t = 0 AND b.t = 1
    UNION ALL SELECT k, t, n, m, level, 0.2 * (level - before) + 0.8 * trend
    FROM (SELECT h.k, q.t, h.n, h.m, h.trend, h.level AS before,
      0.4 * q.value + 0.6 * (h.level + h.trend) AS level
      FROM h JOIN q ON q.k = h.k AND q.t = h.t + 1)),
  full_o AS (SELECT k, max(n) AS n, regr_slope(value, t) AS slope,
    regr_intercept(value, t) AS intercept, regr_sxx(value, t) AS sxx, avg(t) AS mid FROM q GROUP BY k),
  res AS (SELECT q.k, stddev_pop(value - (intercept + slope * t)) AS sigma
    FROM q JOIN full_o USING (k) GROUP BY 1),
  full_w AS (SELECT k, sum(value * (t - n + 4)) / 6.0 AS flat FROM q WHERE t >= n - 3 GROUP BY k),
  train_o AS (SELECT k, regr_slope(value, t) AS slope, regr_intercept(value, t) AS intercept
    FROM q WHERE t < m GROUP BY k),
  train_w AS (SELECT k, sum(value * (t - greatest(m - 3, 0) + 1))
    / (least(3, m) * (least(3, m) + 1) / 2.0) AS flat FROM q
    WHERE t < m AND t >= m - 3 GROUP BY k, m),
  preds AS (
    SELECT q.k, 0 AS tie, {quoted(HOLT)} AS model, value AS a, level + (q.t - q.m + 1) * trend AS p,
      q.m, q.n FROM q JOIN h ON h.k = q.k AND h.t = q.m - 1 WHERE q.t >= q.m
    UNION ALL SELECT q.k, 1, {quoted(OLS)}, value, intercept + slope * t, m, n FROM q
      JOIN train_o USING (k) WHERE t >= m
    UNION ALL SELECT q.k, 2, {quoted(WMA)}, value, flat, m, n FROM q JOIN train_w USING (k)
      WHERE t >= m),
  errors AS (SELECT k, tie, model, CAST(max(m) AS INT) AS train, CAST(max(n - m) AS INT) AS holdout,
    {rnd('avg(abs(a - p))', 2)} AS mae, {rnd('sqrt(avg((a - p) ** 2))', 2)} AS rmse,
    {rnd('coalesce(avg(abs((a - p) / a)) FILTER (abs(a) > 1e-4) * 100, 0)', 2)} AS mape
    FROM preds GROUP BY 1, 2, 3),
  placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY mape, rmse, tie) AS rank
    FROM errors)"""


def fit_series(t):
    return series.forecast_series(t.orders, "o_orderdate", "o_totalprice", [KEY])


def six(*names: str):
    return [F.round(name, 4).alias(name) for name in names]


@query(
    "fit_holt",
    f"""WITH RECURSIVE {FIT_SERIES} SELECT k AS {KEY}, CAST(n AS INT) AS n,
      {rnd('level', 4)} AS level, {rnd('trend', 4)} AS trend FROM h WHERE t = n - 1""",
)
def fit_holt(t):
    return forecast.fit_holt(fit_series(t), [KEY]).select(KEY, "n", *six("level", "trend"))


@query(
    "fit_ols",
    f"""WITH RECURSIVE {FIT_SERIES} SELECT k AS {KEY}, CAST(n AS INT) AS n,
      {rnd('slope', 4)} AS slope, {rnd('intercept', 4)} AS intercept,
      {rnd('sigma', 4)} AS residual_std FROM full_o JOIN res USING (k)""",
)
def fit_ols(t):
    rows = forecast.fit_ols(fit_series(t), [KEY])
    return rows.select(KEY, "n", *six("slope", "intercept", "residual_std"))


@query(
    "fit_wma",
    f"""WITH RECURSIVE {FIT_SERIES} SELECT k AS {KEY}, CAST(n AS INT) AS n, {rnd('flat', 4)} AS flat
    FROM full_w JOIN full_o USING (k)""",
)
def fit_wma(t):
    return forecast.fit_wma(fit_series(t), [KEY]).select(KEY, "n", *six("flat"))


BACKTEST = "model, train, holdout, mae, rmse, mape"


@query("backtest", f"WITH RECURSIVE {FIT_SERIES} SELECT k AS {KEY}, {BACKTEST}, rank FROM placed")
def backtest(t):
    return forecast.backtest(fit_series(t), [KEY])


@query(
    "champion",
    f"WITH RECURSIVE {FIT_SERIES} SELECT k AS {KEY}, {BACKTEST} FROM placed WHERE rank = 1",
)
def champion(t):
    return forecast.champion(fit_series(t), [KEY])


@query(
    "forecast",
    f"""WITH RECURSIVE {FIT_SERIES},
    ahead AS (SELECT c.k, c.model, CAST(s.step AS INT) AS step, o.n, sigma, sxx, mid, grain, last,
      CASE c.model WHEN {quoted(HOLT)} THEN h.level + s.step * h.trend WHEN {quoted(WMA)} THEN w.flat
        ELSE intercept + slope * (o.n + s.step - 1) END AS raw,
      CASE c.model WHEN {quoted(OLS)} THEN sqrt(1 + 1.0 / o.n + (o.n + s.step - 1 - mid) ** 2
        / greatest(sxx, 1e-6)) ELSE sqrt(s.step) END AS width
      FROM placed c JOIN full_o o USING (k) JOIN res USING (k) JOIN full_w w USING (k)
      JOIN h ON h.k = c.k AND h.t = h.n - 1
      JOIN (SELECT k, grain, max(period) AS last FROM q GROUP BY 1, 2) l ON l.k = c.k,
      (SELECT unnest(range(1, 5)) AS step) s WHERE c.rank = 1)
    SELECT k AS {KEY}, model, step, CAST(CASE grain WHEN 'quarter' THEN last + INTERVAL 3 MONTH * step
        WHEN 'month' THEN last + INTERVAL 1 MONTH * step WHEN 'week' THEN last + INTERVAL 7 DAY * step
        ELSE last + INTERVAL 1 DAY * step END AS DATE) AS period,
      {rnd('greatest(0.0, raw)', 2)} AS value,
      {rnd('greatest(0.0, greatest(0.0, raw) - 1.96 * sigma * width)', 2)} AS lower,
      {rnd('greatest(0.0, raw) + 1.96 * sigma * width', 2)} AS upper FROM ahead""",
)
def forecast_values(t):
    return forecast.forecast(fit_series(t), [KEY])
