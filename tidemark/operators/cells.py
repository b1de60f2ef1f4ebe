"""One histogram of a table's cells, written once, from which all its reports are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.fixed_values import NUMBER_KINDS
from tidemark.operators import cleaning, profile
from tidemark.session import scratch_path


def written_cells(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, kind, value, number, padded, missing_before, missing_after, invalid, hits), written once.

    A row stands for all cells of a column that hold one text and fare alike in cleaning: ``value``
    is that text trimmed, null where it is missing, or its start and its SHA-256 if it is long; ``number`` what it
    reads as. One pass over the table serves cleaning diffs, flags, repeated identifiers,
    statistics and scores; each of them then reads this histogram, which is as large as the
    distinct cells, and never the table again.
    """
    cells = cleaning.cell_facts(raw, kinds, with_value=True)
    text = F.col("value")
    keyed = cells.withColumn("value", F.when(F.length(text) > profile.LONG, profile.text_key(text)).otherwise(text))
    names = ["column", "kind", "value", "number", "padded", "missing_before", "missing_after", "invalid"]
    counted = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("hits"))
    path = scratch_path(raw.sparkSession, "cells")
    counted.write.parquet(path)
    return raw.sparkSession.read.schema(counted.schema).parquet(path)


def diff_of(cells: DataFrame) -> DataFrame:
    """The rows of :func:`tidemark.operators.cleaning.cleaning_diff`."""
    return cleaning.cleaning_diff_of(cells, F.col("hits"))


def histogram_of(cells: DataFrame) -> DataFrame:
    """(column, value, hits) of the trimmed table."""
    return cells.groupBy("column", "value").agg(F.sum("hits").alias("hits"))


def null_counts_of(cells: DataFrame) -> DataFrame:
    """(column, missing_count, rows) of the cleaned table."""
    missing = F.sum(F.when(F.col("missing_after"), F.col("hits")).otherwise(F.lit(0)))
    return cells.groupBy("column").agg(missing.alias("missing_count"), F.sum("hits").alias("rows"))


def numeric_stats_of(cells: DataFrame) -> DataFrame:
    """The rows of :func:`tidemark.operators.profile.numeric_stats` for the columns that hold numbers."""
    numbers = cells.where(F.col("kind").isin(NUMBER_KINDS) & F.col("number").isNotNull())
    return profile.numeric_stats_of(numbers.select("column", F.col("number").alias("v"), F.col("hits").alias("w")))


def schema_health_of(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row: share of tidy column names, and text columns where only some values are numbers."""
    tidy = sum(c.replace("_", "").isalnum() for c in columns)
    read = F.sum(F.when(F.col("number").isNotNull(), F.col("hits")).otherwise(F.lit(0)))
    present = F.sum(F.when(F.col("value").isNotNull(), F.col("hits")).otherwise(F.lit(0)))
    mixed = cells.groupBy("column").agg(read.alias("read"), present.alias("present")).agg(
        F.count_if((F.col("read") > 0) & (F.col("read") < F.col("present"))).cast("int").alias("mixed_columns")
    )
    return mixed.select(
        F.lit(len(columns)).alias("columns"), F.lit(round(100.0 * tidy / len(columns), 1)).alias("naming_score"), "mixed_columns"
    )
