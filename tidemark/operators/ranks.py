"""Exact row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import scratch_path

# monotonically_increasing_id keeps the partition number above this bit, the row below it.
_ROW_BITS = 33


def number_rows(
    df: DataFrame,
    order_by: list[str | Column],
    name: str = "row_number",
    total: str = "row_total",
) -> DataFrame:
    """Add the 1-based position of each row in ``order_by`` order, and the number of rows.

    The keys must be unique as a whole, or ties land in any order. Rows are range-partitioned on
    the full key list, so a value shared by a third of the rows is still split by the tie-break
    key. Each partition is sorted and numbered locally, and the result is written once to the
    shared scratch folder: both readers below then see one fixed layout, also after an executor is
    lost. The broadcast side holds one row per written partition.
    """
    keys = [F.col(f"`{key}`") if isinstance(key, str) else key for key in order_by]
    numbered = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    path = scratch_path(df.sparkSession, "ranks")
    numbered.write.parquet(path)
    rows = df.sparkSession.read.schema(numbered.schema).parquet(path)

    part = F.shiftright("_at", _ROW_BITS).alias("_part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    in_order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(in_order), F.lit(0)).alias("_start"),
        F.sum("_size").over(Window.partitionBy()).alias(total),
    )
    local = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + local + 1)
        .drop("_at", "_part", "_start")
    )


def score_cuts(total: int, buckets: int = 5) -> list[int]:
    """The last positions of the buckets but the top one, as equal-frequency cuts of 1..total give them.

    A rank equal to a cut point belongs to the lower bucket, which is what separates this from
    ``ntile``. With fewer rows than buckets every row gets a bucket of its own.
    """
    used = min(buckets, total)
    return [bucket * (total - 1) // used + 1 for bucket in range(1, used)]
