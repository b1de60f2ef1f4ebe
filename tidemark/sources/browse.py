"""Looking at rows: previews and pages, with personal data masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.fixed_values import PII_KINDS
from tidemark.functions.text import mask
from tidemark.operators.filters import text_search
from tidemark.operators.profile import classify_columns


def shown(df: DataFrame, column: str, kind: str | None, width: int | None = None) -> Column:
    """A cell for display: masked if personal, else itself, as cut text when a width is given."""
    field = F.col(f"`{column}`")
    if kind in PII_KINDS:
        return mask(field.cast("string"), kind)
    return field if width is None else F.substring(field.cast("string"), 1, width)


def preview(
    df: DataFrame, kinds: dict[str, str], order_by: list[str], n: int = 10, width: int = 120
) -> DataFrame:
    """The first rows in a stated order, as text cut to ``width``, personal data masked."""
    first = df.orderBy(*order_by).limit(n)
    return first.select(*[shown(df, c, kinds.get(c), width).alias(c) for c in df.columns])


def preview_schema(df: DataFrame, order_by: list[str], n: int = 15) -> DataFrame:
    """The classification of the columns by the first ``n`` rows alone."""
    return classify_columns(df.orderBy(*order_by).limit(n))


def matching_rows(df: DataFrame, kinds: dict[str, str], search: str = "") -> DataFrame:
    """Rows that hold the text in any column that is not personal."""
    return text_search(df, search, [c for c in df.columns if kinds.get(c) not in PII_KINDS])


def page_total(df: DataFrame, kinds: dict[str, str], search: str = "") -> DataFrame:
    """One row: how many rows all pages hold."""
    return matching_rows(df, kinds, search).agg(F.count(F.lit(1)).alias("total"))


def page_rows(
    df: DataFrame,
    kinds: dict[str, str],
    key: list[str],
    search: str = "",
    sort_by: str | None = None,
    descending: bool = False,
    page: int = 1,
    size: int = 50,
) -> DataFrame:
    """One page of matching rows, nulls last, ties in key order, personal data masked.

    Pages hold 1 to 100 rows. Each task keeps only the rows up to the end of the page.
    """
    if not 1 <= size <= 100 or page < 1:
        raise ValueError("page counts from 1 and a page holds 1 to 100 rows")
    order = [F.asc_nulls_last(c) for c in key]
    if sort_by in df.columns:
        first = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
        order = [first, *order]
    rows = matching_rows(df, kinds, search).orderBy(*order)
    return rows.offset((page - 1) * size).limit(size).select(
        *[shown(df, c, kinds.get(c)).alias(c) for c in df.columns]
    )
