"""Writing tables: spreadsheet-safe CSV, and Parquet for cleaned data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numbers import text_columns
from tidemark.functions.text import escape_formula


def escape_formulas(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet would run as a formula gets a leading quote."""
    text = set(text_columns(df))
    return df.select(
        *[
            escape_formula(F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def safe_export(df: DataFrame, path: str) -> None:
    """CSV with a header per part file, formulas escaped, quotes doubled."""
    escape_formulas(df).write.option("header", True).option("escape", '"').csv(path)


def persist_clean(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write Parquet, types kept, and return the written table."""
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
