"""Isolation-forest outlier counts for one numeric column (Liu, Ting and Zhou, 2008).

On a single column a tree is a set of intervals with a path length each, and so is the average of
all trees: a step function with at most trees * sample steps. Trees are grown in parallel on small
samples; every row is then scored by its interval.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.numbers import number

# The task functions travel with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STEPS = "tree long, upto double, path double"


def _expected_depth(size: int) -> float:
    """Average depth of an unsuccessful search in a tree of ``size`` values."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (np.log(size - 1) + 0.5772156649015329) - 2.0 * (size - 1) / size


def _chance(seed: int, tree: int, node: int) -> float:
    """The random number of a node: it depends on nothing but its place, so any engine draws the same."""
    return int(hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()[:13], 16) / 16**13


def _grow(values: np.ndarray, limit: int, seed: int, tree: int) -> list[tuple[float, float]]:
    """Random splits of the sorted sample: (upper end of interval, path length), left to right.

    Nodes are numbered from 1, the children of a node 2n and 2n + 1.
    """
    steps: list[tuple[float, float]] = []
    pending = [(values, 0, np.inf, 1)]
    while pending:
        part, depth, upto, node = pending.pop()
        if depth >= limit or len(part) <= 1 or part[0] == part[-1]:
            steps.append((upto, depth + _expected_depth(len(part))))
            continue
        cut = part[0] + _chance(seed, tree, node) * (part[-1] - part[0])
        left = int(np.searchsorted(part, cut, side="right"))
        pending.append((part[left:], depth + 1, upto, 2 * node + 1))
        pending.append((part[:left], depth + 1, cut, 2 * node))
    return steps


def isolation_forest_flags(
    df: DataFrame,
    column: str,
    key: str,
    trees: int = 100,
    sample: int = 256,
    contamination: float = 0.05,
    seed: int = 42,
) -> DataFrame:
    """One row: rows scored, rows flagged, and the score at the contamination cut.

    Rows are dealt to trees by a hash of their key and cut to ``sample`` per tree before the
    shuffle, so a tree sees a fixed number of rows however large the table is. Each split's random
    number is a hash of the seed, the tree and the node, so the forest does not depend on how the
    rows are dealt to tasks. Rows without a key are scored, but no tree samples them. The flagged rows
    score strictly above the (1 - contamination) quantile of the scores.
    """
    rows = df.select(number(df, column).alias("v"), F.col(f"`{key}`").cast("string").alias("k"))
    rows = rows.where(F.col("v").isNotNull())
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col("k")).cast("binary"))
    dealt = rows.select(
        "v",
        (F.conv(F.substring(place, 1, 7), 16, 10).cast("long") % trees).alias("tree"),
        F.md5(F.concat(F.lit(f"{seed + 1}:"), F.col("k")).cast("binary")).alias("_draw"),
    )
    draw = Window.partitionBy("tree").orderBy("_draw", "v")
    samples = dealt.withColumn("_at", F.row_number().over(draw)).where(F.col("_at") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        values = np.sort(pdf["v"].to_numpy(dtype=float))
        limit = int(np.ceil(np.log2(max(len(values), 2))))
        steps = _grow(values, limit, seed, tree)
        norm = max(_expected_depth(len(values)), 1e-12)
        return pd.DataFrame(
            {
                "tree": tree,
                "upto": [upto for upto, _ in steps],
                "path": [path / norm for _, path in steps],
            }
        )

    grown = samples.select("tree", "v").groupBy("tree").applyInPandas(grow, _STEPS)
    # At most trees * sample steps, whatever the table holds.
    steps = grown.toPandas()
    edges, depth = _average_steps(steps)

    @F.pandas_udf("long")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy(dtype=float), side="left"))

    spark = df.sparkSession
    score = np.power(2.0, -depth)
    scores = spark.createDataFrame(
        pd.DataFrame({"step": np.arange(len(score), dtype="int64"), "score": np.round(score, 9)}),
        "step long, score double",
    )
    histogram = rows.groupBy(place("v").alias("step")).agg(F.count(F.lit(1)).alias("hits"))
    by_score = (
        histogram.join(F.broadcast(scores), "step").groupBy("score").agg(F.sum("hits").alias("hits"))
    )
    # At most trees * sample scores come together here, each with its rows.
    upward, whole = Window.orderBy("score"), Window.partitionBy()
    ranked = by_score.select(
        "score", "hits", F.sum("hits").over(upward).alias("upto"), F.sum("hits").over(whole).alias("n")
    )
    reached = F.col("upto") >= F.ceil(F.col("n") * (1 - contamination))
    kept = ranked.withColumn("cut", F.min(F.when(reached, F.col("score"))).over(whole))
    return kept.agg(
        F.max("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("score") > F.col("cut"), F.col("hits"))), F.lit(0)).alias("flagged"),
        F.max("cut").alias("cut_score"),
    )


def _average_steps(steps: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The trees' step functions averaged: interval ends (the last is open) and mean path."""
    edges = np.unique(steps["upto"].to_numpy(dtype=float))
    edges = edges[np.isfinite(edges)]
    ends = np.append(edges, np.inf)
    total = np.zeros(len(ends))
    trees = 0
    for _, tree in steps.groupby("tree"):
        ordered = tree.sort_values("upto")
        at = np.searchsorted(ordered["upto"].to_numpy(dtype=float), ends, side="left")
        total += ordered["path"].to_numpy(dtype=float)[at]
        trees += 1
    return edges, total / max(trees, 1)
