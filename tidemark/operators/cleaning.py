"""Names, missing values, typed coercion, duplicates, and what cleaning changed."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.fixed_values import NULL_TOKENS, NUMBER_KINDS
from tidemark.functions.numbers import number, text_columns
from tidemark.functions.text import (
    WHITESPACE,
    blank_to_null,
    has_phone_length,
    is_email,
    quoted,
    strip,
    to_boolean,
    to_number,
    to_timestamp_mixed,
)

MODE_KINDS = ["category", "status", "region", "delivery_mode"]
TYPED_KINDS = ["datetime", *NUMBER_KINDS]


def normal_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_") or "column"


def normal_names(names: list[str]) -> list[str]:
    """Lower-case names with underscores; a repeated one gets ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    result = []
    for name in map(normal_name, names):
        seen[name] = seen.get(name, 0) + 1
        result.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return result


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*normal_names(df.columns))


def trim_nulls(df: DataFrame) -> DataFrame:
    """Text columns stripped, tokens for missing values turned into null."""
    text = set(text_columns(df))
    space, tokens = quoted(WHITESPACE), ", ".join(map(quoted, NULL_TOKENS))
    stripped = df.selectExpr(
        *[f"btrim(`{c}`, {space}) AS `{c}`" if c in text else f"`{c}`" for c in df.columns]
    )
    return stripped.selectExpr(
        *[
            f"CASE WHEN `{c}` NOT IN ({tokens}) THEN `{c}` END AS `{c}`" if c in text else f"`{c}`"
            for c in df.columns
        ]
    )


def cell_facts(raw: DataFrame, kinds: dict[str, str], with_value: bool = False) -> DataFrame:
    """One row per cell: (column, kind, padded, missing_before, missing_after, invalid).

    With ``with_value`` also the trimmed text (the text of a typed value) and the number it reads as.
    Stacking the columns keeps each rule in the plan once, whatever the number of columns. Columns
    that already have a type bring only whether they are null.
    """
    text = set(text_columns(raw))
    cells = ", ".join(
        f"{quoted(c)}, {quoted(kind)}, `{c}` IS NULL, "
        + (f"`{c}`" if c in text else f"CAST(`{c}` AS STRING)" if with_value else "CAST(NULL AS STRING)")
        + f", {str(c in text).lower()}"
        for c, kind in kinds.items()
    )
    stacked = raw.select(
        F.expr(f"stack({len(kinds)}, {cells}) AS (column, kind, empty, raw, is_text)")
    )
    trimmed = stacked.withColumn("value", blank_to_null(F.col("raw")))
    value, kind = F.col("value"), F.col("kind")
    reads = (
        F.when(kind.isin(NUMBER_KINDS), to_number(value).isNotNull())
        .when(kind == "datetime", to_timestamp_mixed(value).isNotNull())
        .when(kind == "boolean", to_boolean(value).isNotNull())
        .when(kind == "email", is_email(value))
        .when(kind == "phone", has_phone_length(value))
        .otherwise(True)
    )
    judged = trimmed.withColumn("broken", F.col("is_text") & value.isNotNull() & ~reads)
    lost = F.col("broken") & kind.isin(*TYPED_KINDS, "boolean")
    shown = [value.alias("value"), to_number(value).alias("number")] if with_value else []
    padded = F.col("raw") != strip(F.col("raw"))
    return judged.select(
        "column",
        "kind",
        *shown,
        (F.when(F.col("is_text"), padded) if with_value else padded).alias("padded"),
        F.col("empty").alias("missing_before"),
        F.when(F.col("is_text"), value.isNull() | lost).otherwise(F.col("empty")).alias(
            "missing_after"
        ),
        F.col("broken").alias("invalid"),
    )


def trim_counts(df: DataFrame) -> DataFrame:
    """(column, trimmed): text values with white space at an end."""
    cells = cell_facts(df, dict.fromkeys(text_columns(df), "text"))
    return cells.groupBy("column").agg(F.count_if("padded").alias("trimmed"))


def coerced(df: DataFrame, column: str, kind: str) -> Column:
    """The column in the type its meaning calls for; what cannot be read becomes null.

    Columns that already have a type keep it.
    """
    value = F.col(f"`{column}`")
    if column not in text_columns(df):
        return value
    if kind == "datetime":
        return to_timestamp_mixed(value)
    if kind in NUMBER_KINDS:
        return to_number(value)
    if kind == "boolean":
        return to_boolean(value)
    return value


def coerce(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Typed columns from stripped text, by the meaning of each column."""
    return df.select(*[coerced(df, c, kinds.get(c, "text")).alias(c) for c in df.columns])


def invalid_counts(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, kind, invalid): present values that break the rule of their meaning.

    E-mails and phones are judged by shape; their values stay as they are.
    """
    return cell_facts(df, kinds).groupBy("column", "kind").agg(F.count_if("invalid").alias("invalid"))


def case_variants(counts: DataFrame, most: int = 10) -> DataFrame:
    """(column, normalized, spellings, variants) where values differ only by case.

    Takes (column, value) histogram rows. The list keeps the first ``most`` spellings in order; the
    count is of all of them, and :func:`case_spellings` lists them all.
    """
    folded = _folded(counts)
    line = Window.partitionBy("column", "normalized").orderBy("value")
    placed = folded.withColumn("_at", F.row_number().over(line))
    shown = F.collect_list(F.when(F.col("_at") <= most, F.col("value")))
    spelled = placed.groupBy("column", "normalized").agg(
        F.count(F.lit(1)).alias("spellings"), F.array_sort(shown).alias("variants")
    )
    return spelled.where("spellings > 1")


def case_spellings(counts: DataFrame) -> DataFrame:
    """(column, normalized, value): one row for every spelling of values that differ only by case."""
    folded = _folded(counts)
    several = folded.groupBy("column", "normalized").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return folded.join(several, ["column", "normalized"], "left_semi").select("column", "normalized", "value")


def _folded(counts: DataFrame) -> DataFrame:
    """Present values with their text in lower case, or the key of that where the value is a key."""
    present = counts.where(F.col("value").isNotNull() & (strip(F.col("value")) != ""))
    lower = F.lower("value")
    if "long_folded" in counts.columns:
        present = present.where(F.col("long_boolean").isNull() | F.col("long_folded").isNotNull())
        lower = F.coalesce("long_folded", lower)
    return present.select("column", "value", lower.alias("normalized"))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """The rows that occur more than once, each once, with ``copies``. Null equals null.

    Only a 64-bit hash of each row is shuffled at first. Rows whose hash repeats are then compared
    in full, so a hash collision cannot make a duplicate.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumn("_h", F.xxhash64(*columns))
    repeated = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    suspects = hashed.join(repeated, "_h", "left_semi")
    return suspects.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, exact duplicates beyond the first, and their share.

    One aggregation: rows are counted by a 128-bit hash of their values and of which of them are
    null, combined before they are shuffled, so many copies of one row weigh no more than one.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), "n").otherwise("v") for c in columns])
    counted = df.groupBy(F.xxhash64(nulls, *columns).alias("h"), F.xxhash64(F.lit("row"), nulls, *columns).alias("g")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d")
    )
    return total.select(
        "rows",
        F.col("d").alias("duplicate_rows"),
        F.round(F.col("d") / F.greatest(F.col("rows"), F.lit(1)) * 100, 2).alias("duplicate_pct"),
    )


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_ids(counts: DataFrame, identifiers: list[str]) -> DataFrame:
    """(column, repeated): non-null identifier values beyond the first of each."""
    present = counts.where(F.col("value").isNotNull() & F.col("column").isin(identifiers))
    return (
        present.groupBy("column")
        .agg((F.sum("hits") - F.count(F.lit(1))).alias("repeated"))
        .where("repeated > 0")
    )


def column_flags(counts: DataFrame) -> DataFrame:
    """(column, distinct_values, is_empty, is_constant, is_high_cardinality)."""
    present = F.col("value").isNotNull()
    facts = counts.groupBy("column").agg(
        F.count(F.when(present, 1)).alias("distinct_values"), F.sum("hits").alias("rows")
    )
    distinct = F.col("distinct_values")
    return facts.select(
        "column",
        "distinct_values",
        (distinct == 0).alias("is_empty"),
        (distinct == 1).alias("is_constant"),
        ((distinct > 30) & (distinct / F.col("rows") >= 0.8)).alias("is_high_cardinality"),
    )


def cleaning_diff(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row per column: what trimming and coercion change, and what could be imputed.

    (column, kind, rows, trimmed, missing_before, missing_after, invalid, imputable, strategy).
    Nothing is filled. All counts come from one pass over the raw table.
    """
    return cleaning_diff_of(cell_facts(raw, kinds), F.lit(1))


def cleaning_diff_of(cells: DataFrame, hits: Column) -> DataFrame:
    """The cleaning diff of cells as :func:`cell_facts` gives them, each standing for ``hits`` cells."""
    def total(test: str) -> Column:
        return F.sum(F.when(F.col(test), hits).otherwise(F.lit(0))).cast("long")

    rows = cells.groupBy("column", "kind").agg(
        F.sum(hits).cast("long").alias("rows"),
        total("padded").alias("trimmed"),
        *[total(c).alias(c) for c in ("missing_before", "missing_after", "invalid")],
    )
    fillable = (F.col("missing_after") > 0) & (F.col("missing_after") < F.col("rows"))
    strategy = F.when(fillable & F.col("kind").isin(NUMBER_KINDS), "median").when(
        fillable & F.col("kind").isin(MODE_KINDS), "mode"
    )
    return rows.withColumn("strategy", F.coalesce(strategy, F.lit("preserved"))).withColumn(
        "imputable",
        F.when(F.col("strategy") != "preserved", F.col("missing_after")).otherwise(F.lit(0)),
    )


def cleaning_score(diff: DataFrame) -> DataFrame:
    """One row: share of usable cells before and after cleaning, from a cleaning diff."""
    cells = F.greatest(F.sum("rows"), F.lit(1))
    before = (cells - F.sum("missing_before")) / cells * 100
    after = F.greatest(F.lit(0), cells - F.sum("missing_after") - F.sum("invalid")) / cells * 100
    return diff.agg(
        F.max("rows").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.sum("missing_before").alias("missing_before"),
        F.sum("missing_after").alias("missing_after"),
        F.sum("invalid").alias("invalid"),
        F.round(before, 1).alias("score_before"),
        F.round(after, 1).alias("score_after"),
    )


def pick_revenue(kinds: dict[str, str]) -> dict[str, str | None]:
    """Which columns carry revenue, price, quantity and profit, by meaning and name."""

    def first(meaning: str, tokens: tuple[str, ...], without: str | None = None) -> str | None:
        return next(
            (
                c
                for c, kind in kinds.items()
                if kind == meaning
                and any(token in c for token in tokens)
                and not (without and without in c)
            ),
            None,
        )

    names = ("revenue", "sales", "amount", "total", "price", "value", "income")
    return {
        "revenue": first("currency", names, "price"),
        "price": first("currency", ("price",)),
        "quantity": first("numeric", ("quantity", "units")),
        "profit": first("currency", ("profit", "earning")),
    }


def derived_revenue(df: DataFrame, kinds: dict[str, str], name: str = "revenue") -> DataFrame:
    """Add the revenue column: an existing one, else price times quantity, else nothing."""
    roles = pick_revenue(kinds)
    if roles["revenue"]:
        return df.withColumn(name, number(df, roles["revenue"]))
    if roles["price"] and roles["quantity"]:
        return df.withColumn(name, number(df, roles["price"]) * number(df, roles["quantity"]))
    return df


def data_alerts(
    diff: DataFrame,
    duplicates: DataFrame,
    repeated_ids: DataFrame,
    flags: DataFrame,
    stats: DataFrame,
) -> DataFrame:
    """Everything worth a warning: (alert, column, count, severity)."""

    def alert(rows: DataFrame, name: str, column: Column, count: Column, severity: str):
        return rows.select(
            F.lit(name).alias("alert"),
            column.alias("column"),
            count.cast("long").alias("count"),
            F.lit(severity).alias("severity"),
        )

    table = F.lit("(table)")
    missing = diff.agg(F.sum("missing_after").alias("n")).where("n > 0")
    parts = [
        alert(missing, "missing values", table, F.col("n"), "medium"),
        alert(duplicates.where("duplicate_rows > 0"), "duplicate rows", table,
              F.col("duplicate_rows"), "medium"),
        alert(diff.where("invalid > 0"), "invalid values", F.col("column"), F.col("invalid"), "high"),
        alert(repeated_ids, "repeated identifier", F.col("column"), F.col("repeated"), "medium"),
        alert(flags.where("is_empty"), "empty column", F.col("column"), F.lit(0), "low"),
        alert(flags.where("is_constant"), "constant column", F.col("column"), F.lit(1), "low"),
        alert(stats.where("outlier_count > 0"), "outliers", F.col("column"),
              F.col("outlier_count"), "medium"),
    ]
    return reduce(DataFrame.unionByName, parts)


