"""Pairwise moments of many columns in one pass, as blocks that are merged by addition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numbers import number

#: Rows that are looked at to centre the sums, and partitions in which blocks are merged.
_PEEK = 1000
_MERGERS = 32
_PARTS = ["n", "sum", "square", "product", "least", "most"]


def _add(total: dict[str, np.ndarray] | None, block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    if total is None:
        return block
    fold = {"least": np.fmin, "most": np.fmax}
    return {part: fold.get(part, np.add)(total[part], block[part]) for part in _PARTS}


def _block(values: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of rows x columns with NaN for missing: [i, j] is about column i where j is there too."""
    there = ~np.isnan(values)
    zeroed = np.where(there, values, 0.0)
    seen = there.astype(np.float64)
    width = values.shape[1]
    least, most = np.full((width, width), np.nan), np.full((width, width), np.nan)
    if len(values):
        low, high = np.where(there, values, np.inf), np.where(there, values, -np.inf)
        least[:], most[:] = low.min(axis=0)[:, None], high.max(axis=0)[:, None]
        for j in np.flatnonzero(~there.all(axis=0)):
            rows = there[:, j]
            least[:, j] = low[rows].min(axis=0, initial=np.inf)
            most[:, j] = high[rows].max(axis=0, initial=-np.inf)
    return {
        "n": seen.T @ seen, "sum": zeroed.T @ seen, "square": (zeroed * zeroed).T @ seen, "product": zeroed.T @ zeroed,
        "least": least, "most": most,
    }


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per pair of columns (places i < j) over the rows with both numbers: counts and moments.

    (i, j, n, cov, var_i, var_j, varied): population moments, and whether both sides have two
    distinct values. Rows are read once as columns, and never copied per pair: a task adds up blocks
    of columns x columns, blocks are merged in a few tasks, and pairs appear only after that. Sums
    are taken around the means of the first rows, so a large common offset costs no digits.
    """
    width = len(columns)
    if width < 2:
        schema = "i int, j int, n long, cov double, var_i double, var_j double, varied boolean"
        return df.sparkSession.createDataFrame([], schema)
    flat = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    first = flat.limit(_PEEK).agg(*[F.avg(c).alias(c) for c in flat.columns]).first()  # one row
    centre = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in first])

    def packed(total: dict[str, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            columns = [pa.array([total[part].tobytes()], pa.binary()) for part in _PARTS]
            yield pa.RecordBatch.from_arrays(columns, names=_PARTS)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            total = _add(total, _block(values - centre))
        yield from packed(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                block = {part: np.frombuffer(row[part]).reshape(width, width) for part in _PARTS}
                total = _add(total, block)
        yield from packed(total)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merge(batches):
            row = batch.to_pylist()[0]
            block = {part: np.frombuffer(row[part]).reshape(width, width) for part in _PARTS}
            i, j = np.triu_indices(width, 1)
            sides = [block["n"][i, j]] + [block[part][a, b] for a, b in ((i, j), (j, i)) for part in ("sum", "square", "least", "most")]
            arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32())]
            arrays += [pa.array(side, pa.float64()) for side in (*sides, block["product"][i, j])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["i", "j", "n", "sum_i", "square_i", "least_i", "most_i", "sum_j", "square_j", "least_j", "most_j", "product"]
    kinds = ", ".join(f"{part} binary" for part in _PARTS)
    blocks = flat.mapInArrow(collect, kinds).repartition(_MERGERS).mapInArrow(merge, kinds).repartition(1)
    per_pair = blocks.mapInArrow(pairs, ", ".join(f"{n} {'int' if n in 'ij' else 'double'}" for n in names))
    n = F.col("n")

    def variance(side: str):
        return F.greatest(F.col(f"square_{side}") / n - F.pow(F.col(f"sum_{side}") / n, F.lit(2.0)), F.lit(0.0))

    return per_pair.where(n > 0).select(
        "i", "j", n.cast("long").alias("n"),
        (F.col("product") / n - F.col("sum_i") / n * F.col("sum_j") / n).alias("cov"),
        variance("i").alias("var_i"), variance("j").alias("var_j"),
        ((F.col("least_i") < F.col("most_i")) & (F.col("least_j") < F.col("most_j"))).alias("varied"),
    )
