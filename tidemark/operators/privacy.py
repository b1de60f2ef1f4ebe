"""Where a table may hold personal data: by column name and by content of every value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.fixed_values import PII_HEADERS, PII_PATTERNS
from tidemark.functions.text import mask_middle
from tidemark.operators.cleaning import normal_name
from tidemark.session import literal_rows


# What must occur for a pattern to occur: optional and repeated ends do not matter for presence, and
# without them the search does not go over a long word again and again.
_PROBES = {
    "email": r"[a-zA-Z0-9_.+-]@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]",
    "phone": r"\d{3}[-.\s]?\d{4}",
}


def _holds(text: Column, name: str, pattern: str) -> Column:
    found = text.rlike(_PROBES.get(name, pattern))
    return text.contains("@") & found if name == "email" else found


def header_finding(column: str) -> tuple[str, str, str] | None:
    """(category, severity, action) when the name holds a token as whole words."""
    name = f"_{normal_name(column)}_"
    return next(
        (
            (category, severity, action)
            for category, severity, action, tokens in PII_HEADERS
            if any(f"_{token}_" in name for token in tokens)
        ),
        None,
    )


def pii_headers(df: DataFrame) -> DataFrame:
    """(column, category, severity, action, values): suspicious names and their filled cells."""
    found = {c: hit for c in df.columns if (hit := header_finding(c))}
    if not found:
        schema = "column string, category string, severity string, action string, values long"
        return df.sparkSession.createDataFrame([], schema)
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in found])
    records = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(category).alias("category"),
            F.lit(severity).alias("severity"),
            F.lit(action).alias("action"),
            F.col(f"`{c}`").alias("values"),
        )
        for c, (category, severity, action) in found.items()
    ]
    return filled.select(F.inline(F.array(*records)))


def pii_content(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, pattern, matches): values that hold each pattern, over every value in full.

    Each pattern of each column is one counter of a single aggregation, so the text itself is
    never shuffled.
    """
    counters, records = [], []
    for i, c in enumerate(columns):
        text = F.col(f"`{c}`").cast("string")
        for name, pattern, *_ in PII_PATTERNS:
            counters.append(F.count_if(_holds(text, name, pattern)).alias(f"{name}_{i}"))
            records.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(name).alias("pattern"),
                    F.col(f"{name}_{i}").alias("matches"),
                )
            )
    return df.agg(*counters).select(F.inline(F.array(*records)))


def pii_samples(df: DataFrame, columns: list[str], order_by: list[str], k: int = 3) -> DataFrame:
    """(column, place, sample): the first k non-null values with their middle masked.

    Row-number-at-most-k is cut to k rows per column before the shuffle.
    """
    cells = [
        F.struct(F.lit(c).alias("column"), mask_middle(F.col(f"`{c}`").cast("string")).alias("sample"))
        for c in columns
    ]
    keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(order_by)]
    stacked = df.select(*keys, F.inline(F.array(*cells)))
    present = stacked.where(F.col("sample").isNotNull())
    line = Window.partitionBy("column").orderBy(*[f"_k{i}" for i in range(len(order_by))], "sample")
    placed = present.withColumn("place", F.row_number().over(line))
    return placed.where(F.col("place") <= k).select("column", "place", "sample")


def pii_findings(headers: DataFrame, content: DataFrame) -> DataFrame:
    """(column, category, severity, action, matches): one row per column that looks sensitive.

    The first pattern that occurs counts. A name decides the category unless the content is
    critical.
    """
    order = {name: i for i, (name, *_) in enumerate(PII_PATTERNS)}
    ranked = content.where("matches > 0").withColumn(
        "_place", F.create_map(*[F.lit(v) for pair in order.items() for v in pair])[F.col("pattern")]
    )
    first = ranked.groupBy("column").agg(F.min(F.struct("_place", "pattern", "matches")).alias("f"))
    notes = literal_rows(
        content.sparkSession,
        [(name, category, severity, action) for name, _, severity, category, action in PII_PATTERNS],
        "pattern string,c_category string,c_severity string,c_action string",
    )
    by_content = (
        first.select("column", "f.pattern", "f.matches").join(F.broadcast(notes), "pattern")
    )
    both = headers.drop("values").join(by_content, "column", "full")
    critical = F.col("c_severity") == "Critical"

    def pick(name: str) -> Column:
        return F.when(critical, F.col(f"c_{name}")).otherwise(
            F.coalesce(F.col(name), F.col(f"c_{name}"))
        )

    return both.select(
        "column",
        *[pick(name).alias(name) for name in ("category", "severity", "action")],
        F.coalesce("matches", F.lit(0)).alias("matches"),
    )


def compliance_score(findings: DataFrame, columns: int) -> DataFrame:
    """One row: columns scanned, findings, score (15 points off per finding), status, readiness."""
    counted = findings.agg(F.count(F.lit(1)).alias("findings"))
    score = F.greatest(F.lit(0), 100 - F.col("findings") * 15)
    scored = counted.withColumn("compliance_score", score)
    status = F.when(F.col("findings") == 0, "Compliant").when(
        F.col("compliance_score") > 60, "Attention Required"
    )
    ready = F.when(F.col("findings") == 0, "Ready").otherwise("Review Recommended")
    return scored.select(
        F.lit(columns).alias("columns_scanned"),
        "findings",
        "compliance_score",
        status.otherwise("High Risk").alias("compliance_status"),
        ready.alias("readiness"),
    )
