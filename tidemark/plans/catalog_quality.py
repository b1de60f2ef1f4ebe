"""Cleaning, profiling, quality and privacy queries.

The given tables are clean, so the cleaning queries read ``leads``: every customer as the text a
spreadsheet export might hold, with padded names, tokens for missing values, mixed number and date
formats, and some rows repeated. The same SQL makes it in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.fixed_values import EMAIL, NULL_TOKENS, PII_PATTERNS
from tidemark.operators import cells, cleaning, insights, kpis, privacy, profile, quality
from tidemark.plans.registry import query, rnd

ONE_LEAD = """SELECT
  CAST(CASE WHEN c_custkey % 50 = 1 THEN c_custkey - 1 ELSE c_custkey END AS STRING) AS lead_id,
  CASE WHEN c_custkey % 7 = 0 THEN '  ' || c_name || ' ' WHEN c_custkey % 11 = 0 THEN ' N/A '
    WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS full_name,
  CASE WHEN c_custkey % 10 = 0 THEN 'bad-email' WHEN c_custkey % 12 = 0 THEN ''
    ELSE lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@mail' || CAST(c_nationkey AS STRING)
      || '.com' END AS email,
  CASE WHEN c_custkey % 9 = 0 THEN '123' ELSE '+1 (555) ' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')
    || '-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END AS mobile,
  CASE WHEN c_custkey % 8 = 0 THEN 'not-a-date'
    WHEN c_custkey % 8 = 1 THEN '2024/02/' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0')
    WHEN c_custkey % 8 = 2 THEN '03/' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || '/2024'
    WHEN c_custkey % 8 = 3 THEN '--'
    ELSE '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') END AS created_date,
  CASE WHEN c_custkey % 6 = 0 THEN '$' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING)
    WHEN c_custkey % 6 = 1 THEN '(' || CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS STRING) || ')'
    WHEN c_custkey % 6 = 2 THEN '1,' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '.50'
    WHEN c_custkey % 23 = 0 THEN 'oops'
    ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END AS price,
  CASE WHEN c_custkey % 31 = 0 THEN 'null' ELSE CAST(c_custkey % 9 AS STRING) END AS quantity,
  CASE WHEN c_custkey % 29 = 0 THEN 'maybe' WHEN c_custkey % 4 = 0 THEN 'Yes'
    WHEN c_custkey % 4 = 1 THEN 'no' WHEN c_custkey % 4 = 2 THEN ' TRUE' ELSE '0' END AS is_active,
  CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment,
  'R' || CAST(c_nationkey AS STRING) AS region,
  CAST(NULL AS STRING) AS note,
  'x' AS batch
FROM {customer}"""
LEADS = f"{ONE_LEAD} UNION ALL {ONE_LEAD} WHERE c_custkey % 20 = 0"
LEADS_SQL = LEADS.format(customer="customer")

KINDS = {
    "lead_id": "identifier",
    "full_name": "person",
    "email": "email",
    "mobile": "phone",
    "created_date": "datetime",
    "price": "currency",
    "quantity": "numeric",
    "is_active": "boolean",
    "segment": "category",
    "region": "region",
    "note": "text",
    "batch": "text",
}


def leads(t):
    return t.spark.sql(LEADS, customer=t.customer)


TOKEN_LIST = ", ".join(f"'{token}'" for token in NULL_TOKENS)


def blank(c: str) -> str:
    return f"CASE WHEN trim({c}) IN ({TOKEN_LIST}) THEN NULL ELSE trim({c}) END"


TRIMMED = f"SELECT {', '.join(f'{blank(c)} AS {c}' for c in KINDS)} FROM ({LEADS_SQL})"
NUMBER = r"""try_cast(regexp_replace(regexp_replace({c}, '[, $₹€£%¥]', '', 'g'), '^\((.*)\)$', '-\1')
  AS DOUBLE)"""
DATE = """coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%Y/%m/%d'),
  try_strptime({c}, '%m/%d/%Y'))"""
BOOLEAN = """CASE WHEN lower({c}) IN ('true', 'yes', '1', 'y', 't') THEN true
  WHEN lower({c}) IN ('false', 'no', '0', 'n', 'f') THEN false END"""


def typed_sql(c: str) -> str:
    form = {"datetime": DATE, "currency": NUMBER, "numeric": NUMBER, "boolean": BOOLEAN}
    return form.get(KINDS[c], "{c}").format(c=c)


CLEAN = f"SELECT {', '.join(f'{typed_sql(c)} AS {c}' for c in KINDS)} FROM ({TRIMMED})"


def invalid_sql(c: str) -> str:
    kind = KINDS[c]
    if kind == "email":
        return f"NOT regexp_matches({c}, '{EMAIL}')"
    if kind == "phone":
        return f"length(regexp_replace({c}, '\\D', '', 'g')) NOT BETWEEN 7 AND 15"
    if kind in ("datetime", "currency", "numeric", "boolean"):
        return f"({typed_sql(c)}) IS NULL"
    return "false"


def per_column(expression, source: str, head: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {head} {expression(c)} FROM ({source})" for c in KINDS
    )


@query("trim_nulls", TRIMMED)
def trim_nulls(t):
    return cleaning.trim_nulls(leads(t))


@query(
    "trim_counts",
    per_column(lambda c: f"count(*) FILTER ({c} <> trim({c})) AS trimmed", LEADS_SQL),
)
def trim_counts(t):
    return cleaning.trim_counts(leads(t))


@query(
    "normalize_names",
    """SELECT c_custkey AS cust_key, c_name AS name, c_mktsegment AS name_2, c_acctbal AS acct_bal,
      c_nationkey AS "column" FROM customer""",
)
def normalize_names(t):
    messy = t.customer.select(
        F.col("c_custkey").alias(" Cust Key "),
        F.col("c_name").alias("Name"),
        F.col("c_mktsegment").alias("name!"),
        F.col("c_acctbal").alias("Acct--Bal"),
        F.col("c_nationkey").alias("??"),
    )
    return cleaning.normalize_names(messy)


HISTOGRAM = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS hits FROM ({{src}}) GROUP BY 2"
    for c in KINDS
)


def lead_histogram(t):
    return profile.value_histogram(cleaning.trim_nulls(leads(t)))


@query(
    "case_variants",
    f"""WITH h AS ({HISTOGRAM.format(src=TRIMMED)})
    SELECT "column", lower(value) AS normalized, count(DISTINCT value) AS spellings,
      array_to_string(list_slice(list_sort(list(DISTINCT value)), 1, 10), '|') AS variants
    FROM h WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""",
)
def case_variants(t):
    found = cleaning.case_variants(lead_histogram(t))
    return found.withColumn("variants", F.array_join("variants", "|"))


def typed_query(name: str, column: str, build) -> None:
    sql = f"SELECT lead_id, {column} AS raw, {typed_sql(column)} AS typed FROM ({TRIMMED})"

    @query(name, sql)
    def typed(t):
        trimmed = cleaning.trim_nulls(leads(t))
        value = build(F.col(column))
        return trimmed.select("lead_id", F.col(column).alias("raw"), value.alias("typed"))


def _typed():
    from tidemark.functions import text

    typed_query("to_number", "price", text.to_number)
    typed_query("to_timestamp_mixed", "created_date", text.to_timestamp_mixed)
    typed_query("to_boolean", "is_active", text.to_boolean)


_typed()


@query("coerce", CLEAN)
def coerce(t):
    return cleaning.coerce(cleaning.trim_nulls(leads(t)), KINDS)


INVALID = per_column(
    lambda c: f"'{KINDS[c]}' AS kind, count(*) FILTER ({c} IS NOT NULL AND {invalid_sql(c)}) AS invalid",
    TRIMMED,
)


def invalid(t):
    return cleaning.invalid_counts(cleaning.trim_nulls(leads(t)), KINDS)


@query("invalid_values", INVALID)
def invalid_values(t):
    return invalid(t)


@query("invalid_emails", f"SELECT * FROM ({INVALID}) WHERE kind = 'email'")
def invalid_emails(t):
    trimmed = cleaning.trim_nulls(leads(t))
    return cleaning.invalid_counts(trimmed, {"email": "email"})


@query("invalid_phones", f"SELECT * FROM ({INVALID}) WHERE kind = 'phone'")
def invalid_phones(t):
    trimmed = cleaning.trim_nulls(leads(t))
    return cleaning.invalid_counts(trimmed, {"mobile": "phone"})


DUPLICATES = f"""SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM
    ({{src}}))) AS duplicate_rows,
  {rnd("(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({src})))) / count(*) * 100", 2)}
    AS duplicate_pct FROM ({{src}})"""


@query("duplicate_rows", DUPLICATES.format(src=CLEAN))
def duplicate_rows(t):
    return cleaning.duplicate_rows(cleaning.coerce(cleaning.trim_nulls(leads(t)), KINDS))


@query("drop_duplicate_rows", f"SELECT DISTINCT * FROM ({TRIMMED})")
def drop_duplicate_rows(t):
    return cleaning.drop_duplicate_rows(cleaning.trim_nulls(leads(t)))


@query(
    "duplicate_pct",
    DUPLICATES.format(src="SELECT event_type, user_id, value FROM events"),
)
def duplicate_pct(t):
    return cleaning.duplicate_rows(t.events.select("event_type", "user_id", "value"))


@query(
    "duplicate_ids",
    f"""SELECT 'lead_id' AS "column", count(lead_id) - count(DISTINCT lead_id) AS repeated
    FROM ({TRIMMED})""",
)
def duplicate_ids(t):
    return cleaning.duplicate_ids(lead_histogram(t), ["lead_id"])


FLAGS = per_column(
    lambda c: f"""count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) = 0 AS is_empty,
      count(DISTINCT {c}) = 1 AS is_constant,
      count(DISTINCT {c}) > 30 AND count(DISTINCT {c}) / count(*) >= 0.8 AS is_high_cardinality""",
    TRIMMED,
)


@query("column_flags", FLAGS)
def column_flags(t):
    return cleaning.column_flags(lead_histogram(t))


DIFF_COUNTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{KINDS[c]}' AS kind, count(*) AS rows,
      count(*) FILTER (raw <> trim(raw)) AS trimmed, count(*) FILTER (raw IS NULL) AS missing_before,
      count(*) FILTER (({typed_sql(c)}) IS NULL) AS missing_after,
      count(*) FILTER ({c} IS NOT NULL AND {invalid_sql(c)}) AS invalid
      FROM (SELECT {c} AS raw, {blank(c)} AS {c} FROM ({LEADS_SQL}))"""
    for c in KINDS
)
DIFF = f"""WITH d AS ({DIFF_COUNTS}),
  s AS (SELECT *, CASE WHEN missing_after > 0 AND missing_after < rows
      AND kind IN ('numeric', 'currency', 'percentage') THEN 'median'
    WHEN missing_after > 0 AND missing_after < rows
      AND kind IN ('category', 'status', 'region', 'delivery_mode') THEN 'mode'
    ELSE 'preserved' END AS strategy FROM d)
  SELECT *, CASE WHEN strategy <> 'preserved' THEN missing_after ELSE 0 END AS imputable FROM s"""


@query("cleaning_diff", DIFF)
def cleaning_diff(t):
    return cleaning.cleaning_diff(leads(t), KINDS)


@query(
    "cleaning_score",
    f"""SELECT max(rows) AS rows, count(*) AS columns,
      CAST(sum(missing_before) AS BIGINT) AS missing_before,
      CAST(sum(missing_after) AS BIGINT) AS missing_after, CAST(sum(invalid) AS BIGINT) AS invalid,
      {rnd('(sum(rows) - sum(missing_before)) / sum(rows) * 100', 1)} AS score_before,
      {rnd('greatest(0, sum(rows) - sum(missing_after) - sum(invalid)) / sum(rows) * 100', 1)}
        AS score_after FROM ({DIFF})""",
)
def cleaning_score(t):
    return cleaning.cleaning_score(cleaning.cleaning_diff(leads(t), KINDS))


@query(
    "derived_revenue",
    f"""SELECT l_orderkey, l_linenumber, {rnd('p_retailprice * l_quantity', 2)} AS revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def derived_revenue(t):
    named = t.items().select(
        "l_orderkey",
        "l_linenumber",
        F.col("p_retailprice").alias("unit_price"),
        F.col("l_quantity").alias("quantity"),
    )
    kinds = {"l_orderkey": "identifier", "unit_price": "currency", "quantity": "numeric"}
    priced = cleaning.derived_revenue(named, kinds)
    return priced.select("l_orderkey", "l_linenumber", F.round("revenue", 2).alias("revenue"))


# Profiles ---------------------------------------------------------------------------------------

PHONE_SHAPE = "regexp_full_match(CAST({c} AS VARCHAR), '\\+?[0-9() .-]{{7,20}}')"
DIGIT_COUNT = "length(regexp_replace(CAST({c} AS VARCHAR), '\\D', '', 'g')) BETWEEN 7 AND 15"


def part_of(test: str) -> str:
    return f"avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END)"


def number_facts(table: str, c: str, kind: str) -> str:
    """The ladder for a numeric column whose name says nothing: phone, boolean, number."""
    phone = f"{part_of(PHONE_SHAPE.format(c=c))} >= 0.8 AND {part_of(DIGIT_COUNT.format(c=c))} >= 0.8"
    boolean = f"{part_of(f'{c} IN (0, 1)')} >= 0.9"
    return f"""SELECT '{c}' AS "column", '{kind}' AS data_type,
      CASE WHEN {phone} THEN 'phone' WHEN {boolean} THEN 'boolean' ELSE 'numeric' END AS semantic_type,
      CAST(CASE WHEN {phone} THEN 0.86 WHEN {boolean} THEN 0.85 ELSE 0.88 END AS DOUBLE) AS confidence,
      CAST(0 AS DOUBLE) AS null_percentage, count(DISTINCT {c}) AS unique_count FROM {table}"""


FEW_NAMES = "count(DISTINCT c_name) <= least(30, greatest(2, count(c_name) // 2))"
CUSTOMER_FACTS = f"""{number_facts('customer', 'c_custkey', 'bigint')}
  UNION ALL {number_facts('customer', 'c_nationkey', 'int')}
  UNION ALL {number_facts('customer', 'c_acctbal', 'double')}
  UNION ALL SELECT 'c_name', 'string', CASE WHEN {FEW_NAMES} THEN 'category' ELSE 'text' END,
    CASE WHEN {FEW_NAMES} THEN 0.72 ELSE 0.62 END, 0, count(DISTINCT c_name) FROM customer
  UNION ALL SELECT 'c_mktsegment', 'string', 'category', 0.82, 0, count(DISTINCT c_mktsegment)
    FROM customer"""


EVENT_NAMES = {
    "event_id": ("identifier", 0.9),
    "ts": ("", 0.0),
    "user_id": ("identifier", 0.9),
    "event_type": ("", 0.0),
    "value": ("currency", 0.96),
    "props": ("", 0.0),
}


@query(
    "name_semantics",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS kind, CAST({sure} AS DOUBLE) AS confidence,
          count({c}) AS filled FROM events"""
        for c, (kind, sure) in EVENT_NAMES.items()
    ),
)
def name_semantics(t):
    return profile.named_columns(t.events)


@query("classify_columns", CUSTOMER_FACTS)
def classify_columns(t):
    return profile.classify_columns(t.customer)


LEAD_VERDICTS = {
    "lead_id": ("identifier", 0.96),
    "full_name": ("person", 0.96),
    "email": ("email", 0.96),
    "mobile": ("phone", 0.96),
    "created_date": ("datetime", 0.88),
    "price": ("currency", 0.96),
    "quantity": ("numeric", 0.84),
    "is_active": ("boolean", 0.96),
    "segment": ("category", 0.96),
    "region": ("region", 0.96),
    "note": ("unknown", 0.4),
    "batch": ("category", 0.72),
}
LEAD_FACTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", 'string' AS data_type, '{kind}' AS semantic_type,
      CAST({confidence} AS DOUBLE) AS confidence,
      {rnd(f'(count(*) - count({c})) / count(*) * 100', 2)} AS null_percentage,
      count(DISTINCT {c}) AS unique_count FROM ({TRIMMED})"""
    for c, (kind, confidence) in LEAD_VERDICTS.items()
)


@query("classify_text_columns", LEAD_FACTS)
def classify_text_columns(t):
    return profile.classify_columns(cleaning.trim_nulls(leads(t)))


EMAIL_MASK = """CASE WHEN contains({v}, '@') THEN left(split_part({v}, '@', 1), 2)
    || repeat('*', greatest(2, CAST(length(split_part({v}, '@', 1)) AS INT) - 2))
    || substr({v}, CAST(strpos({v}, '@') AS INT)) ELSE left({v}, 1) || '***' END"""
DIGITS = "regexp_replace({v}, '\\D', '', 'g')"
PHONE_MASK = (
    "CASE WHEN " + DIGITS + " = '' THEN '***' ELSE repeat('*', greatest(0, CAST(length("
    + DIGITS + ") AS INT) - 4)) || right(" + DIGITS + ", 4) END"
)


def masked_sql(c: str) -> str:
    kind = LEAD_VERDICTS[c][0]
    form = {"email": EMAIL_MASK, "phone": PHONE_MASK}.get(kind, "left({v}, 80)")
    return form.format(v=c)


SAMPLES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT count(*) FROM ({TRIMMED}) WHERE {c} IS NULL) AS missing,
      coalesce(array_to_string(list(m ORDER BY {c}), ' | '), '') AS samples FROM (SELECT DISTINCT {c},
      {masked_sql(c)} AS m FROM ({TRIMMED}) WHERE {c} IS NOT NULL ORDER BY {c} LIMIT 3)"""
    for c in KINDS
)


@query("column_profile", f"""SELECT * FROM ({LEAD_FACTS}) JOIN ({SAMPLES}) USING ("column")""")
def column_profile(t):
    return profile.column_profile(cleaning.trim_nulls(leads(t)))


@query(
    "sensitive_columns",
    f"""SELECT "column", semantic_type, 'Potentially identifiable information; values are masked in '
      || 'analysis.' AS message FROM ({LEAD_FACTS}) WHERE semantic_type IN ('email', 'phone')""",
)
def sensitive_columns(t):
    return profile.sensitive_columns(profile.classify_columns(cleaning.trim_nulls(leads(t))))


@query(
    "dataset_domain",
    f"""SELECT 'General Dataset' AS domain, CAST(0.68 AS DOUBLE) AS confidence,
      'Product / Record IDs, Sales Agents / People, Regions / Locations, Creation Date' AS entities,
      count(*) AS rows FROM ({LEADS_SQL})""",
)
def dataset_domain(t):
    frame = cleaning.trim_nulls(leads(t))
    return profile.dataset_domain(frame, profile.column_kinds(frame))


@query(
    "mask_values",
    f"SELECT lead_id, {masked_sql('email')} AS email, {masked_sql('mobile')} AS mobile FROM ({TRIMMED})",
)
def mask_values(t):
    masked = profile.mask_values(cleaning.trim_nulls(leads(t)), KINDS)
    return masked.select("lead_id", "email", "mobile")


def stats_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", n AS count, {rnd('mean', 3)} AS mean, {rnd('med', 3)} AS median,
          {rnd('coalesce(std, 0)', 3)} AS std, lo AS min, {rnd('q1', 3)} AS q1, {rnd('q3', 3)} AS q3,
          hi AS max, (SELECT count(*) FROM {table} WHERE q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1)
            OR {c} > q3 + 1.5 * (q3 - q1))) AS outlier_count
        FROM (SELECT count({c}) AS n, avg({c}) AS mean, median({c}) AS med, stddev_samp({c}) AS std,
          CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi,
          quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table})"""
        for c in columns
    )


LINE_STATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("numeric_stats", stats_sql("lineitem", LINE_STATS))
def numeric_stats(t):
    return profile.numeric_stats(t.lineitem, LINE_STATS)


@query("numeric_stats_events", stats_sql("events", ["value", "user_id"]))
def numeric_stats_events(t):
    return profile.numeric_stats(t.events, ["value", "user_id"])


@query(
    "insight_outliers",
    f"""SELECT * FROM (SELECT "column", outlier_count,
      {rnd('outlier_count / greatest(count, 1) * 100', 1)} AS outlier_pct
      FROM ({stats_sql('events', ['value', 'user_id'])})) WHERE outlier_pct >= 3""",
)
def insight_outliers(t):
    return insights.insight_outliers(profile.numeric_stats(t.events, ["value", "user_id"]))


@query(
    "dimensions",
    f"""WITH h AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS label, count(*) AS value FROM ({TRIMMED}) "
        f"WHERE {c} IS NOT NULL GROUP BY 2" for c in ('full_name', 'segment', 'region'))}),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value DESC, label) AS place,
      count(*) OVER (PARTITION BY "column") AS n FROM h)
    SELECT "column", place, label, value FROM r WHERE n BETWEEN 2 AND 30 AND place <= 50""",
)
def dimensions(t):
    return profile.dimensions(cleaning.trim_nulls(leads(t)), KINDS)


# Quality ----------------------------------------------------------------------------------------

NULLS = per_column(
    lambda c: f"count(*) FILTER ({c} IS NULL) AS missing_count, count(*) AS rows", CLEAN
)
QUALITY = f"""WITH m AS ({NULLS}), i AS (SELECT sum(invalid) AS invalid FROM ({INVALID})),
  f AS (SELECT max(rows) AS r, count(*) AS c, sum(missing_count) AS miss,
    sum(rows - missing_count) FILTER ("column" IN ('created_date', 'price', 'quantity')) AS typed
    FROM m),
  d AS (SELECT duplicate_rows AS dup FROM ({DUPLICATES.format(src=CLEAN)})),
  p AS (SELECT r AS rows, c AS columns, CAST(miss AS BIGINT) AS missing_values,
    CAST(invalid AS BIGINT) AS invalid_values, dup AS duplicate_rows,
    {rnd('(r * c - miss) / (r * c) * 100', 1)} AS completeness,
    {rnd('(r - dup) / r * 100', 1)} AS uniqueness,
    {rnd('greatest(0, r * c - invalid) / (r * c) * 100', 1)} AS validity,
    {rnd('greatest(0, r - dup - invalid) / r * 100', 1)} AS consistency,
    {rnd('typed / greatest(typed + invalid, 1) * 100', 1)} AS type_correctness FROM f, i, d)
  SELECT *, {rnd('(completeness + uniqueness + validity + consistency + type_correctness) / 5', 1)}
    AS overall_score FROM p"""


def lead_quality(t):
    return quality.quality_report(leads(t), KINDS)


@query("quality_report", QUALITY)
def quality_report(t):
    return lead_quality(t)


@query(
    "kpi_base",
    f"""WITH q AS ({QUALITY}) SELECT 0 AS position, 'Total Records' AS label,
      CAST(rows AS DOUBLE) AS value, 'count' AS format FROM q
    UNION ALL SELECT 1, 'Columns', columns, 'count' FROM q
    UNION ALL SELECT 2, 'Data Quality', overall_score, 'percent' FROM q
    UNION ALL SELECT 3, 'Missing Values', missing_values, 'count' FROM q
    UNION ALL SELECT 4, 'Duplicate Records', duplicate_rows, 'count' FROM q""",
)
def kpi_base(t):
    return kpis.kpi_base(lead_quality(t)).drop("calculation")


ORDER_KINDS = {
    "o_orderkey": "identifier", "o_custkey": "identifier", "o_orderstatus": "status",
    "revenue": "currency", "o_orderdate": "datetime", "o_orderpriority": "category",
}


@query(
    "overview",
    f"""SELECT {rnd('sum(o_totalprice)', 2)} AS revenue,
      CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS orders, {rnd('sum(o_totalprice * 0.25)', 2)} AS profit,
      {rnd('sum(o_totalprice) / count(DISTINCT o_orderkey)', 2)} AS aov,
      {rnd('sum(o_totalprice * 0.25) / sum(o_totalprice) * 100', 2)} AS margin, count(*) AS records,
      6 AS columns, CAST(100 AS DOUBLE) AS quality_score FROM orders""",
)
def overview(t):
    orders = t.orders.withColumnRenamed("o_totalprice", "revenue")
    profit = orders.withColumn("profit", F.col("revenue") * 0.25)
    rows = kpis.stack_kpis(
        kpis.kpi_orders(orders, order_id="o_orderkey"),
        kpis.kpi_revenue(orders, "revenue", order_id="o_orderkey"),
        kpis.kpi_profit(profit, "profit", "revenue"),
    )
    return kpis.overview(rows, quality.quality_report(orders, ORDER_KINDS))


MISSING = f"""SELECT "column", missing_count, pct AS missing_pct, CASE WHEN pct >= 30 THEN 'critical'
    WHEN pct >= 10 THEN 'warning' ELSE 'healthy' END AS status
  FROM (SELECT *, {rnd('missing_count / rows * 100', 2)} AS pct FROM ({NULLS}))"""


def clean_leads(t):
    return cleaning.coerce(cleaning.trim_nulls(leads(t)), KINDS)


@query("missing_by_column", MISSING)
def missing_by_column(t):
    return quality.missing_by_column(clean_leads(t))


@query(
    "insight_missing",
    f"""SELECT * FROM (SELECT {rnd('sum(missing_count) / sum(rows) * 100', 2)} AS missing_pct,
      count(*) FILTER (missing_count > 0) AS columns FROM ({NULLS})) WHERE missing_pct >= 2""",
)
def insight_missing(t):
    return insights.insight_missing(quality.null_counts(clean_leads(t)))


MIXED = " + ".join(
    f"""CASE WHEN count({NUMBER.format(c=c)}) > 0 AND count({NUMBER.format(c=c)}) < count({c})
      THEN 1 ELSE 0 END""" for c in KINDS
)
HEALTH = f"""SELECT {len(KINDS)} AS columns, CAST(100 AS DOUBLE) AS naming_score, {MIXED} AS mixed_columns
  FROM ({TRIMMED})"""


@query("schema_health", HEALTH)
def schema_health(t):
    return quality.schema_health(cleaning.trim_nulls(leads(t)))


@query(
    "outlier_skew",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", o AS outlier_count, {rnd('o / n * 100', 2)} AS outlier_pct,
          {rnd('coalesce(sk, 0)', 2)} AS skewness, abs(coalesce(sk, 0)) > 1 AS is_skewed
        FROM (SELECT n, sk, (SELECT count(*) FROM {table} WHERE {c} < q1 - 1.5 * (q3 - q1)
            OR {c} > q3 + 1.5 * (q3 - q1)) AS o
          FROM (SELECT count({c}) AS n, skewness({c}) AS sk, quantile_cont({c}, 0.25) AS q1,
            quantile_cont({c}, 0.75) AS q3 FROM {table}) WHERE n >= 6 AND q3 > q1)"""
        for table, c in [("documents", "doc_id"), ("documents", "n_chars")]
    ),
)
def outlier_skew(t):
    return quality.outlier_skew(t.documents, ["doc_id", "n_chars"])


DRIFT_COLUMNS = ["value", "user_id", "event_id"]
DRIFT = f"""p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n
    FROM events),
  d AS ({" UNION ALL ".join(
      f"SELECT '{c}' AS \"column\", avg({c}) FILTER (rn <= n // 2) AS mb, "
      f"avg({c}) FILTER (rn > n // 2) AS mr, stddev_samp({c}) FILTER (rn <= n // 2) AS sb, "
      f"stddev_samp({c}) FILTER (rn > n // 2) AS sr FROM p" for c in DRIFT_COLUMNS)}),
  s AS (SELECT *, {rnd('abs(mr - mb) / greatest(abs(mb), abs(mr), 1e-4) * 100', 1)} AS shift FROM d),
  drifted AS (SELECT "column", {rnd('mb', 2)} AS baseline_mean, {rnd('mr', 2)} AS recent_mean,
    shift AS mean_shift_pct, CASE WHEN shift >= 25 THEN 'High Drift' WHEN shift >= 10
      THEN 'Moderate Drift' ELSE 'Stable' END AS status,
    {rnd('sr / greatest(sb, 1e-6)', 2)} AS variance_ratio FROM s)"""


def event_drift(t):
    return quality.drift(t.events, DRIFT_COLUMNS, ["ts", "event_id"])


@query("drift", f"WITH {DRIFT} SELECT * FROM drifted")
def drift(t):
    return event_drift(t)


SCORES = f"""WITH {DRIFT}, n AS (SELECT {rnd('sum(missing_count) / sum(rows) * 100', 2)} AS null_pct
    FROM ({NULLS})),
  u AS ({DUPLICATES.format(src=CLEAN)}), h AS ({HEALTH}),
  g AS (SELECT count(*) FILTER (status = 'High Drift') AS high_drift FROM drifted),
  k AS (SELECT *, greatest(0.0, 100.0 - null_pct * 2.0) AS a,
    greatest(0.0, 100.0 - duplicate_pct * 4.0) AS b,
    greatest(50.0, 100.0 - CAST(mixed_columns AS DOUBLE) / columns * 30.0) AS c,
    CAST(naming_score AS DOUBLE) AS d,
    CAST(greatest(60.0, 100.0 - high_drift * 15.0) AS DOUBLE) AS e FROM n, u, h, g),
  card AS (SELECT {rnd('a * 0.3 + b * 0.2 + c * 0.2 + d * 0.15 + e * 0.15', 1)} AS overall_score,
    {rnd('a', 1)} AS completeness, {rnd('b', 1)} AS uniqueness, {rnd('c', 1)} AS validity,
    {rnd('d', 1)} AS consistency, {rnd('e', 1)} AS stability, null_pct, duplicate_pct,
    duplicate_rows, high_drift FROM k)"""


def scorecard(t):
    """Nulls and names from one histogram of the cells, duplicates from the rows."""
    counted = cells.written_cells(leads(t), KINDS)
    return quality.quality_scorecard(
        cells.null_counts_of(counted),
        cleaning.duplicate_rows(clean_leads(t)),
        cells.schema_health_of(counted, list(KINDS)),
        event_drift(t),
    )


@query(
    "quality_scorecard",
    f"""{SCORES} SELECT *, CASE WHEN overall_score >= 90 THEN 'Excellent' WHEN overall_score >= 75
      THEN 'Good' ELSE 'Needs Cleaning' END AS quality_tier FROM card""",
)
def quality_scorecard(t):
    return scorecard(t)


@query(
    "quality_actions",
    f"""{SCORES}, worst AS (SELECT "column" AS detail, missing_pct FROM ({MISSING})
      WHERE status = 'critical' ORDER BY missing_pct DESC, "column" LIMIT 1),
    a AS (SELECT 'remove_duplicates' AS action, 'exact duplicate rows' AS detail,
        CAST(duplicate_rows AS DOUBLE) AS amount FROM card WHERE duplicate_rows > 0
      UNION ALL SELECT 'handle_missing', detail, missing_pct FROM worst
      UNION ALL SELECT 'inspect_drift', 'columns with high drift', CAST(high_drift AS DOUBLE)
        FROM card WHERE high_drift > 0)
    SELECT * FROM a UNION ALL SELECT 'none', 'healthy', 0.0 WHERE NOT EXISTS (SELECT * FROM a)""",
)
def quality_actions(t):
    return quality.quality_actions(scorecard(t), quality.missing_by_column(clean_leads(t)))


LEAD_NUMBERS = ["price", "quantity"]
CLEAN_STATS = stats_sql(f"({CLEAN})", LEAD_NUMBERS)


@query(
    "data_alerts",
    f"""WITH d AS ({DIFF}), f AS ({FLAGS}), s AS ({CLEAN_STATS})
    SELECT 'missing values' AS alert, '(table)' AS "column", CAST(sum(missing_after) AS BIGINT) AS count,
      'medium' AS severity FROM d HAVING sum(missing_after) > 0
    UNION ALL SELECT 'duplicate rows', '(table)', duplicate_rows, 'medium'
      FROM ({DUPLICATES.format(src=CLEAN)}) WHERE duplicate_rows > 0
    UNION ALL SELECT 'invalid values', "column", invalid, 'high' FROM d WHERE invalid > 0
    UNION ALL SELECT 'repeated identifier', 'lead_id', count(lead_id) - count(DISTINCT lead_id),
      'medium' FROM ({TRIMMED}) HAVING count(lead_id) > count(DISTINCT lead_id)
    UNION ALL SELECT 'empty column', "column", 0, 'low' FROM f WHERE is_empty
    UNION ALL SELECT 'constant column', "column", 1, 'low' FROM f WHERE is_constant
    UNION ALL SELECT 'outliers', "column", outlier_count, 'medium' FROM s WHERE outlier_count > 0""",
)
def data_alerts(t):
    """All reports from one histogram of the cells, but for the duplicate rows."""
    counted = cells.written_cells(leads(t), KINDS)
    values = cells.histogram_of(counted)
    return cleaning.data_alerts(
        cells.diff_of(counted),
        cleaning.duplicate_rows(clean_leads(t)),
        cleaning.duplicate_ids(values, ["lead_id"]),
        cleaning.column_flags(values),
        cells.numeric_stats_of(counted),
    )


# Privacy ----------------------------------------------------------------------------------------

HEADER_NOTES = {
    "email": ("Direct PII (Email)", "High", "Mask domain or pseudonymize with HMAC-SHA256"),
    "mobile": ("Direct PII (Phone)", "High", "Mask phone number (***-***-1234)"),
}
HEADERS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{category}' AS category, '{severity}' AS severity,
      '{action}' AS action, count({c}) AS "values" FROM ({TRIMMED})"""
    for c, (category, severity, action) in HEADER_NOTES.items()
)


def content_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{name}' AS pattern,
          count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), '{pattern}')) AS matches FROM ({source})"""
        for c in columns
        for name, pattern, *_ in PII_PATTERNS
    )


@query("pii_headers", HEADERS)
def pii_headers(t):
    return privacy.pii_headers(cleaning.trim_nulls(leads(t)))


@query("pii_content", content_sql("SELECT * FROM documents", ["text", "source"]))
def pii_content(t):
    return privacy.pii_content(t.documents, ["text", "source"])


@query("pii_content_conversations", content_sql("SELECT * FROM conversations", ["text", "role"]))
def pii_content_conversations(t):
    return privacy.pii_content(t.conversations, ["text", "role"])


@query(
    "pii_samples",
    """WITH l AS (SELECT 'text' AS "column", doc_id, text AS v FROM documents
      UNION ALL SELECT 'source', doc_id, source FROM documents),
    m AS (SELECT "column", doc_id, CASE WHEN length(v) > 4 THEN left(v, 2) || '***' || right(v, 2)
      WHEN v IS NOT NULL THEN '***' END AS sample FROM l WHERE v IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY doc_id, sample) AS place FROM m)
    SELECT "column", place, sample FROM r WHERE place <= 3""",
)
def pii_samples(t):
    return privacy.pii_samples(t.documents, ["text", "source"], ["doc_id"])


SCANNED = ["lead_id", "email", "mobile", "segment", "note"]
CASES = {
    part: "CASE pattern "
    + " ".join(f"WHEN '{row[0]}' THEN '{row[i]}'" for row in PII_PATTERNS)
    + " END"
    for part, i in (("category", 3), ("severity", 2), ("action", 4))
}
ORDERED = "CASE pattern " + " ".join(f"WHEN '{row[0]}' THEN {i}" for i, row in enumerate(PII_PATTERNS)) + " END"
FINDINGS = f"""WITH h AS ({HEADERS}), c AS ({content_sql(TRIMMED, SCANNED)}),
  f AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY {ORDERED}) AS r,
    {CASES['category']} AS cc, {CASES['severity']} AS cs, {CASES['action']} AS ca
    FROM c WHERE matches > 0),
  found AS (SELECT "column", CASE WHEN cs = 'Critical' THEN cc ELSE coalesce(category, cc) END AS category,
    CASE WHEN cs = 'Critical' THEN cs ELSE coalesce(severity, cs) END AS severity,
    CASE WHEN cs = 'Critical' THEN ca ELSE coalesce(action, ca) END AS action,
    coalesce(matches, 0) AS matches
    FROM h FULL JOIN (SELECT * FROM f WHERE r = 1) USING ("column"))"""


def findings(t):
    frame = cleaning.trim_nulls(leads(t)).select(*SCANNED)
    return privacy.pii_findings(privacy.pii_headers(frame), privacy.pii_content(frame, SCANNED))


@query("pii_findings", f"{FINDINGS} SELECT * FROM found")
def pii_findings(t):
    return findings(t)


@query(
    "compliance_score",
    f"""{FINDINGS}, s AS (SELECT count(*) AS findings, greatest(0, 100 - count(*) * 15)
      AS compliance_score FROM found)
    SELECT {len(SCANNED)} AS columns_scanned, findings, compliance_score,
      CASE WHEN findings = 0 THEN 'Compliant' WHEN compliance_score > 60 THEN 'Attention Required'
        ELSE 'High Risk' END AS compliance_status,
      CASE WHEN findings = 0 THEN 'Ready' ELSE 'Review Recommended' END AS readiness FROM s""",
)
def compliance_score(t):
    return privacy.compliance_score(findings(t), len(SCANNED))
