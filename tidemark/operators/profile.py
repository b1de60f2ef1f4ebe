"""What each column holds: meaning, completeness, distinct values, statistics, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.fixed_values import (
    ALIAS_ORDER,
    BOOLEAN_WORDS,
    COLUMN_ALIASES,
    COUNT_NAMES,
    DIMENSION_KINDS,
    ENTITY_LABELS,
    NAME_PARTS,
    PII_KINDS,
)
from tidemark.functions.numbers import is_numeric, is_temporal
from tidemark.functions.text import (
    has_phone_length,
    is_email,
    is_phone,
    mask,
    mask_by,
    quoted,
    strip,
    to_number,
    to_timestamp_mixed,
)
from tidemark.operators.anomalies import long_numbers
from tidemark.operators.cleaning import normal_name
from tidemark.operators.quantiles import grouped_quantiles

#: Texts beyond so many characters are named by a digest in histograms.
LONG = 128


def name_semantics(name: str) -> tuple[str | None, float]:
    """What a column's name alone says it holds, and how sure that is."""
    plain = normal_name(name)
    if plain in COUNT_NAMES:
        return "numeric", 0.84
    for kind in ALIAS_ORDER:
        if plain in COLUMN_ALIASES[kind]:
            return ("currency" if kind == "revenue" else kind), 0.96
    fits = {
        "has": lambda token: token in plain,
        "ends": plain.endswith,
        "starts": plain.startswith,
    }
    for kind, confidence, how, tokens in NAME_PARTS:
        if any(map(fits[how], tokens)):
            return kind, confidence
    return None, 0.0


def named_columns(df: DataFrame) -> DataFrame:
    """(column, kind, confidence, filled): what names alone say, and how many cells are filled.

    The kind is empty where a name says nothing.
    """
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    records = []
    for c in df.columns:
        kind, confidence = name_semantics(c)
        records.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kind or "").alias("kind"),
                F.lit(confidence).alias("confidence"),
                F.col(f"`{c}`").alias("filled"),
            )
        )
    return filled.select(F.inline(F.array(*records)))


def value_histogram(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, hits): how often each column holds each value, as text, nulls included.

    One grouping of the stacked columns serves distinct counts, modes, flags, case variants and
    classification. Partial aggregation folds frequent values before the shuffle. Values longer
    than 128 characters are keyed by their first 80 and their SHA-256, so long texts are not shuffled; what the
    classification and the case variants need of them is worked out before (``long_*``, null for
    short values): every test of the content, and the key of the text in lower case.
    """
    used = columns or df.columns
    cells = ", ".join(f"{quoted(c)}, CAST(`{c}` AS STRING)" for c in used)
    stacked = df.select(F.expr(f"stack({len(used)}, {cells}) AS (column, text)"))
    text = F.col("text")
    long = F.length(text) > LONG
    facts = {f"long_{name}": F.when(long, test) for name, test in _content_tests(strip(text)).items()}
    facts["long_folded"] = F.when(long & (strip(text) != ""), text_key(F.lower(text)))
    keyed = stacked.select(
        "column",
        F.when(long, text_key(text)).otherwise(text).alias("value"),
        *[fact.alias(name) for name, fact in facts.items()],
    )
    return keyed.groupBy("column", "value", *facts).agg(F.count(F.lit(1)).alias("hits"))


def text_key(text: Column) -> Column:
    """A short name of a long text: its first 80 characters and its SHA-256."""
    return F.concat(F.left(text, F.lit(80)), F.lit("… sha256:"), F.sha2(text, 256))


def shown(value: Column, digits: int = 0) -> Column:
    """A histogram's value to look at: a long text as its first 80 characters and so many digits of its digest."""
    mark = "… #$1" if digits else "…"
    return F.regexp_replace(value, rf"… sha256:([0-9a-f]{{{digits}}})[0-9a-f]{{{64 - digits}}}$", mark)


def _content_tests(text: Column) -> dict[str, Column]:
    return {
        "email": is_email(text),
        "date": to_timestamp_mixed(text).isNotNull(),
        "phone": is_phone(text),
        "phone_length": has_phone_length(text),
        "boolean": F.lower(text).isin(BOOLEAN_WORDS),
        "number": to_number(text).isNotNull(),
    }


def _lookup(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[F.col("column")]


def classify_columns(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(column, data_type, semantic_type, confidence, null_percentage, unique_count).

    A name that means personal data, a date or a number decides at once. Otherwise the content of
    the distinct values, weighted by how often they occur, runs down the ladder: e-mails, dates,
    other names, phones, booleans, numbers, categories, text.
    """
    counts = value_histogram(df) if counts is None else counts
    tests = {
        name: F.coalesce(f"long_{name}", test) for name, test in _content_tests(F.col("text")).items()
    }
    judged = counts.withColumn("text", strip(F.col("value"))).select(
        "column",
        "hits",
        F.when(F.col("value").isNotNull(), F.col("hits")).alias("present"),
        *[F.when(test, F.col("hits")).otherwise(0).alias(name) for name, test in tests.items()],
    )
    facts = judged.groupBy("column").agg(
        F.sum("hits").alias("rows"),
        F.coalesce(F.sum("present"), F.lit(0)).alias("filled"),
        F.count("present").alias("unique_count"),
        *[F.sum(name).alias(name) for name in tests],
    )
    facts = facts.select(
        "column", "rows", "filled", "unique_count",
        *[F.try_divide(F.col(name), F.col("filled")).alias(f"p_{name}") for name in tests],
    )
    named = {c: name_semantics(c) for c in df.columns}
    kind_by_name = _lookup({c: kind or "" for c, (kind, _) in named.items()})
    sure_by_name = _lookup({c: confidence for c, (_, confidence) in named.items()})
    temporal = _lookup({c: is_temporal(df, c) for c in df.columns})
    numeric = _lookup({c: is_numeric(df, c) for c in df.columns})
    types = _lookup({f.name: f.dataType.simpleString() for f in df.schema.fields})

    filled = F.col("filled") > 0
    few = F.least(F.lit(30), F.greatest(F.lit(2), F.floor(F.col("filled") * 0.5)))
    by_name = F.struct(kind_by_name.alias("kind"), sure_by_name.alias("confidence"))

    def verdict(kind: str, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))

    dated = F.struct(F.lit("datetime").alias("kind"), sure_by_name.alias("confidence"))
    other_names = [
        "customer", "region", "category", "status", "person", "source", "delivery_mode", "boolean",
    ]
    ladder = (
        F.when(kind_by_name.isin(PII_KINDS), by_name)
        .when(kind_by_name == "date", dated)
        .when(kind_by_name.isin("currency", "percentage", "identifier", "numeric"), by_name)
        .when(filled & (F.col("p_email") >= 0.7), verdict("email", 0.93))
        .when(filled & (F.col("p_date") >= 0.85), verdict("datetime", 0.82))
        .when(kind_by_name.isin(other_names), by_name)
        .when(
            filled & (F.col("p_phone") >= 0.8) & (F.col("p_phone_length") >= 0.8),
            verdict("phone", 0.86),
        )
        .when(temporal, verdict("datetime", 0.98))
        .when(filled & (F.col("p_boolean") >= 0.9), verdict("boolean", 0.85))
        .when(filled & (F.col("p_number") >= 0.85), verdict("numeric", 0.88))
        .when(filled & (F.col("unique_count") <= few), verdict("category", 0.72))
        .when(filled, verdict("text", 0.62))
        .when(numeric, verdict("numeric", 0.8))
        .otherwise(verdict("unknown", 0.4))
    )
    nulls = (F.col("rows") - F.col("filled")) / F.col("rows") * 100
    return facts.select("*", ladder.alias("v")).select(
        "column",
        types.alias("data_type"),
        F.col("v.kind").alias("semantic_type"),
        F.round("v.confidence", 2).alias("confidence"),
        F.round(nulls, 2).alias("null_percentage"),
        "unique_count",
    )


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Column meanings as a dict, for operators that choose their columns by it.

    Collects one row per column of the table.
    """
    found = {r["column"]: r["semantic_type"] for r in classify_columns(df).collect()}
    return {c: found.get(c, "unknown") for c in df.columns}


def column_profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """Classification plus missing counts, masked samples and the domain of the dataset.

    Samples are the first distinct values in text order, as ``a | b | c``; of values of more than 128
    characters the first 80 are shown.
    """
    counts = value_histogram(df)
    facts = classify_columns(df, counts)
    line = Window.partitionBy("column").orderBy("value")
    present = counts.where(F.col("value").isNotNull()).select("column", "value")
    firsts = present.withColumn("at", F.row_number().over(line)).where(F.col("at") <= samples)
    sampled = firsts.join(facts.select("column", "semantic_type"), "column").groupBy("column").agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct("at", mask_by(shown(F.col("value")), F.col("semantic_type")).alias("m"))
                    )
                ),
                lambda s: s["m"],
            ),
            " | ",
        ).alias("samples")
    )
    missing = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("hits"))), F.lit(0)).alias("missing")
    )
    return (
        facts.join(missing, "column")
        .join(sampled, "column", "left")
        .withColumn("samples", F.coalesce("samples", F.lit("")))
    )


def domain_of(kinds: dict[str, str]) -> tuple[str, float, list[str]]:
    """What a dataset is about, how sure that is, and the entities it holds."""
    names, held = list(kinds), set(kinds.values())
    joined = " ".join(names)
    entities = [label for kind, label in ENTITY_LABELS if kind in held]

    def named(*tokens: str) -> bool:
        return any(token in name for token in tokens for name in names)

    operations = {"status", "region"} <= held and held & {"source", "person"}
    workforce = named("employee") and {"department", "salary", "attrition"} & set(names)
    health = named("patient") and any(
        token in joined for token in ("treatment", "outcome", "condition", "admitted")
    )
    shop = named("order") and named("customer") and named("product")
    money = any(token in joined for token in ("income", "expense", "cash_flow", "account"))
    sales = "currency" in held and any(t in joined for t in ("sales", "revenue", "amount"))
    stock = named("stock", "inventory", "sku") or (
        named("warehouse") and named("product", "quantity", "stock", "inventory")
    )
    choices = [
        (operations, "Customer / Lead / Sales Operations", 0.92, []),
        (workforce, "HR / Workforce", 0.90, ["Employees", "Departments", "Salary"]),
        (health, "Healthcare", 0.88, ["Patients", "Treatments", "Outcomes"]),
        (shop, "E-commerce", 0.90, ["Orders", "Customers", "Products"]),
        (money, "Finance", 0.88, ["Income", "Expenses", "Cash Flow"]),
        (sales, "Sales / Revenue", 0.88, []),
        (stock, "Inventory / Operations", 0.84, []),
        (True, "General Dataset", 0.68, []),
    ]
    _, label, confidence, extra = next(choice for choice in choices if choice[0])
    return label, confidence, entities + [e for e in extra if e not in entities]


def dataset_domain(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row: domain, confidence, entities and the number of rows it was seen in."""
    label, confidence, entities = domain_of(kinds)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(label).alias("domain"),
        F.lit(confidence).alias("confidence"),
        F.lit(", ".join(entities)).alias("entities"),
        "rows",
    )


def numeric_stats(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """Per column: count, mean, median, std, min, q1, q3, max and 1.5-IQR outliers.

    All columns are stacked and handled in the same passes: quartiles first, then the rest next to
    the outliers. ``approx`` takes the quartiles from a sketch.
    """
    rows = long_numbers(df, columns)
    if not approx:
        return numeric_stats_of(rows.withColumn("w", F.lit(1).cast("long")))
    return _around_quartiles(rows.withColumn("w", F.lit(1).cast("long")), _sketched(rows))


def numeric_stats_of(rows: DataFrame) -> DataFrame:
    """Statistics per column of (column, v, w): numbers, each standing for ``w`` cells."""
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    facts = grouped_quantiles(rows, ["column"], F.col("v"), quarters, few_groups=True, weight=F.col("w"))
    return _around_quartiles(rows, facts.withColumnsRenamed({"least": "min", "most": "max"}))


def _sketched(rows: DataFrame) -> DataFrame:
    """n, min, max and quartiles per column, the quartiles from a sketch."""
    sketch = rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.percentile_approx("v", [0.25, 0.5, 0.75]).alias("_q"),
    )
    quarters = [F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    return sketch.select("column", "n", "min", "max", *quarters)


def _around_quartiles(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Statistics of (column, v, w), given n, min, max and quartiles per column.

    Sums are taken around the median, so a large common offset costs no digits.
    """
    iqr = F.col("q3") - F.col("q1")
    fenced = facts.select(
        F.col("column").alias("_c"), "n", "median", "min", "q1", "q3", "max",
        (F.col("q1") - 1.5 * iqr).alias("_low"),
        (F.col("q3") + 1.5 * iqr).alias("_high"),
    )
    v = F.col("v")
    outside = (F.col("q3") > F.col("q1")) & ((v < F.col("_low")) | (v > F.col("_high")))
    # One row of fences per column of the table is broadcast.
    counted = (
        rows.join(F.broadcast(fenced), F.col("column") == F.col("_c"))
        .groupBy("column", "n", "median", "min", "q1", "q3", "max")
        .agg(
            F.sum(F.when(outside, F.col("w")).otherwise(F.lit(0))).alias("outlier_count"),
            F.sum((v - F.col("median")) * F.col("w")).alias("_sum"),
            F.sum((v - F.col("median")) * (v - F.col("median")) * F.col("w")).alias("_square"),
        )
    )
    n = F.col("n")
    spread = F.greatest(F.col("_square") - F.col("_sum") * F.col("_sum") / n, F.lit(0.0))
    return counted.select(
        "column",
        n.alias("count"),
        F.round(F.col("median") + F.col("_sum") / n, 3).alias("mean"),
        F.round("median", 3).alias("median"),
        F.round(F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(F.lit(0.0)), 3).alias("std"),
        "min",
        F.round("q1", 3).alias("q1"),
        F.round("q3", 3).alias("q3"),
        "max",
        "outlier_count",
    )


def mask_values(df: DataFrame, kinds: dict[str, str], width: int = 80) -> DataFrame:
    """The table with e-mails and phones masked; nothing else changes."""
    return df.select(
        *[
            mask(F.col(f"`{c}`").cast("string"), kinds[c], width).alias(c)
            if kinds.get(c) in PII_KINDS
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def sensitive_columns(profile: DataFrame) -> DataFrame:
    """The columns whose meaning is personal data."""
    note = "Potentially identifiable information; values are masked in analysis."
    return profile.where(F.col("semantic_type").isin(PII_KINDS)).select(
        "column", "semantic_type", F.lit(note).alias("message")
    )


def dimensions(
    df: DataFrame, kinds: dict[str, str], most: int = 30, top: int = 50
) -> DataFrame:
    """(column, place, label, value): counts of columns that can split a chart.

    A dimension has between 2 and ``most`` distinct values. Wider columns are dropped before
    anything is ranked. Labels of more than 128 characters show their first 80 and part of a digest,
    which tells labels with one start apart.
    """
    columns = [c for c, kind in kinds.items() if kind in DIMENSION_KINDS]
    counts = value_histogram(df, columns).where(F.col("value").isNotNull())
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    usable = distinct.where((F.col("n") > 1) & (F.col("n") <= most)).select("column")
    line = Window.partitionBy("column").orderBy(F.desc("hits"), F.asc("value"))
    placed = counts.join(F.broadcast(usable), "column", "left_semi").withColumn(
        "place", F.row_number().over(line)
    )
    return placed.where(F.col("place") <= top).select(
        "column", "place", shown(F.col("value"), 8).alias("label"), F.col("hits").alias("value")
    )
