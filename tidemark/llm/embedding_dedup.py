"""Near-duplicate vectors: sorted passes over random projections, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import written
from tidemark.llm.graph import components
from tidemark.operators.ranks import number_rows

_BITS = 48  # of a sort key


def _planes(size: int, turn: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size, turn]).standard_normal((size, _BITS)).astype(np.float32)


def _stack(vectors: pd.Series) -> np.ndarray:
    """Rows of unit length in double precision; all of one size."""
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _values(vectors: DataFrame, vector: str) -> Column:
    """The vector in its own precision if it is one of floating-point numbers, else as doubles."""
    value = F.col(f"`{vector}`")
    kind = vectors.schema[vector].dataType.simpleString()
    return value if kind in ("array<float>", "array<double>") else value.cast("array<double>")


def vector_classes(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """One row per distinct usable (label, vector): a number, the smallest key and how often it occurs."""
    value = _values(vectors, vector)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.select(
        F.col(f"`{key}`").alias("vec"), value.alias("v"), F.col(f"`{label}`").alias("label")
    ).where(
        F.col("label").isNotNull() & value.isNotNull() & ~bad & F.exists(value, lambda x: x != 0)
    )
    grouped = usable.groupBy("label", "v").agg(F.min("vec").alias("first"), F.count(F.lit(1)).alias("copies"))
    return written(
        grouped.withColumn("node", F.monotonically_increasing_id()), "vectors"
    )


def label_plans(classes: DataFrame, least: float, passes: int, window: int, miss: float) -> DataFrame:
    """(label, size, n, mean, passes, turns) of each label and size of vectors: how its links are looked for.

    ``mean`` is the mean of the unit vectors, and ``turns`` how often the label is sorted: as many
    times as keep the expected share of missed pairs of cosine ``least`` under ``miss``, at least
    ``passes``. A pair of that cosine has (least - m) / (1 - m) without the mean, m being its squared
    length, and each sign of it differs with the chance acos / pi of that. A pass is counted as a hit
    only if the first log2(n / window) + 1 signs agree, when about half a window shares them.

    That counts on one link between two vectors. Where m is so large that the pair has under half its
    cosine without the mean, a vector has links by the hundred and one is enough to join it, so there
    four times ``passes`` is the most. A label that fits into one window, whole in it in any order,
    takes one turn and needs no mean. ``passes`` is the bound's number where that is less work than
    all pairs of the label, else 0: a figure for callers, which no link depends on.
    """
    def centred(m: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(least - m, 1 - m)))

    def wanted(m: Column) -> Column:
        differ = F.acos(F.coalesce(centred(m), F.lit(0.0))) / np.pi
        signs = F.greatest(F.ceil(F.log2(F.col("n") / window)), F.lit(0)) + 1
        needed = F.try_divide(F.lit(float(np.log(miss))), F.log1p(-F.pow(1 - differ, signs)))
        return F.greatest(F.lit(passes).cast("long"), F.ceil(needed).cast("long"))

    counts = written(classes.groupBy("label", F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")), "labels")
    large = counts.where(F.col("n") > window + 1)
    kind = classes.schema["label"].dataType

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (label, size), part in frame.groupby(["label", "size"], sort=False):
                total = _stack(part["v"]).sum(axis=0)
                yield pd.DataFrame({"label": [label], "size": [size], "total": [total]})

    rows = classes.select("label", F.size("v").alias("size"), "v").join(large.select("label", "size"), ["label", "size"])
    schema = f"label {kind.simpleString()}, size int, total array<double>"
    single = rows.mapInPandas(sums, schema).select("label", "size", F.posexplode("total").alias("at", "x"))
    summed = single.groupBy("label", "size", "at").agg(F.sum("x").alias("x"))
    total = F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda e: e["x"])
    means = large.join(summed.groupBy("label", "size").agg(total.alias("total")), ["label", "size"]).withColumn(
        "mean", F.transform("total", lambda x: x / F.col("n"))
    )
    length = F.aggregate("mean", F.lit(0.0), lambda t, x: t + x * x)
    planned = means.select("label", "size", "mean", length.alias("m")).join(counts, ["label", "size"])
    alone = F.coalesce(centred(F.col("m")), F.lit(0.0)) >= 0.5
    few = (F.col("m") >= least) | (F.col("n") <= 2 * window * wanted(F.col("m")))
    planned = planned.select(
        "label", "size", "mean", F.when(few, F.lit(0).cast("long")).otherwise(wanted(F.col("m"))).alias("passes"),
        F.when(alone, wanted(F.col("m"))).otherwise(F.least(wanted(F.col("m")), F.lit(4 * passes).cast("long"))).alias("turns"),
    )
    return written(
        counts.join(planned, ["label", "size"], "left").select(
            "label", "size", "n", "mean", F.coalesce("passes", F.lit(0).cast("long")).alias("passes"),
            F.coalesce("turns", F.lit(1).cast("long")).alias("turns"),
        ), "plans",
    )


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links (a, b) between n rows: a row of each component for every further row of it."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b, root[a], root[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    rest = np.flatnonzero(root != np.arange(n))
    return root[rest], rest


def window_links(classes: DataFrame, plans: DataFrame, least: float, window: int, block: int, seed: int) -> DataFrame:
    """Pairs (a, b) of nodes that connect what the links between neighbours of some pass connect.

    A pass sorts all vectors by label, size and the signs of random projections, one after the
    other, of what is left without the label's mean: a direction they share would leave most signs
    alike. The order is cut into blocks; the first rows of a block also go to the block before, so
    every window is whole in one task of bounded size, however many vectors share a label or key.
    Neighbours within ``window`` are compared; a block gives no more pairs than it has rows, so a
    label of near copies makes no square of them.
    """
    zero = F.transform(F.sequence(F.lit(1), F.col("size")), lambda _: F.lit(0.0))
    sorted_plans = plans.where("n > 1").select(
        "label", "size", F.coalesce("mean", zero).alias("mean"), F.col("turns").alias("passes")
    )
    rows = classes.select("label", F.size("v").alias("size"), "node", "v").join(sorted_plans, ["label", "size"])

    @F.pandas_udf("array<long>")
    def keys(vectors: pd.Series, means: pd.Series, passes: pd.Series) -> pd.Series:
        weights = (1 << np.arange(_BITS - 1, -1, -1)).astype(np.int64)
        out, wanted = [None] * len(vectors), passes.to_numpy()
        sizes = vectors.map(len).to_numpy()
        for n, most in {*zip(sizes.tolist(), wanted.tolist())}:
            at = np.flatnonzero((sizes == n) & (wanted == most))
            centred = _stack(vectors.iloc[at]) - np.stack(means.iloc[at])
            found = np.stack([((centred @ _planes(n, turn, seed)) > 0) @ weights for turn in range(most)], axis=1)
            for i, row in zip(at, found):
                out[i] = row
        return pd.Series(out, dtype=object)

    turns = rows.select("label", "size", "node", F.posexplode(keys("v", "mean", "passes")).alias("turn", "sort_key"))
    placed = number_rows(
        turns.select("turn", "label", "size", "sort_key", "node"), ["turn", "label", "size", "sort_key", "node"], "place"
    ).select("turn", "label", "node", "place")
    at = F.floor((F.col("place") - 1) / block)
    again = F.when((F.col("place") - 1) % block < window, F.array(at, at - 1)).otherwise(F.array(at))
    spread = placed.withColumn("block", F.explode(again)).join(classes.select("node", "v"), "node")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", kind="stable").reset_index(drop=True)
        group = pd.factorize(pd.MultiIndex.from_frame(
            pd.DataFrame({"t": frame["turn"], "l": frame["label"], "n": frame["v"].map(len)})
        ))[0]
        nodes, own = frame["node"].to_numpy(), int(((frame["place"] - 1) // block == frame["block"]).sum())
        found = []
        for value in np.unique(group):
            at = np.flatnonzero(group == value)
            rows, ids = _stack(frame["v"].iloc[at]), nodes[at]
            starts, pairs = int((at < own).sum()), []
            for step in range(1, min(window, len(at) - 1) + 1):
                until = min(starts, len(at) - step)
                near = np.einsum("ij,ij->i", rows[:until], rows[step : step + until]) >= least
                first = np.flatnonzero(near)
                pairs.append(np.stack([first, first + step]))
            if pairs:
                a, b = (ids[x] for x in _forest(*np.concatenate(pairs, axis=1), len(at)))
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        return pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64), columns=["a", "b"])

    return spread.groupBy("block").applyInPandas(compare, "a long, b long").distinct()


def component_links(classes: DataFrame, roots: DataFrame, least: float, block: int) -> DataFrame:
    """(node, linked): how many other vectors of its component each node links with.

    Members of a component are compared block by block: each pair of blocks is a task's work of
    bounded size, and only a count per member leaves it. Copies count as often as they occur.
    """
    members = classes.select("node", "v", "copies").join(roots, "node")
    sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    part = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")
    placed = members.join(sizes, "root").withColumn("part", part)
    # A block meets itself and every later one: (i, j) with i <= j, and the member knows its side.
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "root", "node", "v", "copies", "part", "blocks",
        F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
    )
    # Small components share tasks: whole ones in buckets, large ones a block pair each.
    buckets = max(1, roots.count() // 20_000)
    small = F.col("blocks") == 1
    spread = spread.select(
        "node", "v", "copies", "part", "root", "i", "j",
        F.when(small, F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.lit(-1)).alias("bucket"),
        F.when(small, F.lit(-1).cast("long")).otherwise(F.col("root")).alias("large"),
    )

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("root", kind="stable")
        rows, copies = _stack(frame["v"]), frame["copies"].to_numpy()
        left = (frame["part"] == frame["i"]).to_numpy()
        alone = (frame["i"] == frame["j"]).to_numpy()
        linked = np.zeros(len(frame), dtype=np.int64)
        bounds = np.flatnonzero(np.diff(frame["root"].to_numpy())) + 1
        for at in np.split(np.arange(len(frame)), bounds):
            if alone[at[0]]:
                near = rows[at] @ rows[at].T >= least
                np.fill_diagonal(near, True)
                linked[at] = near @ copies[at] - 1
            else:
                one, two = at[left[at]], at[~left[at]]
                near = rows[one] @ rows[two].T >= least
                linked[one], linked[two] = near @ copies[two], copies[one] @ near
        return pd.DataFrame({"node": frame["node"], "linked": linked})

    counts = spread.groupBy("bucket", "large", "i", "j").applyInPandas(count, "node long, linked long")
    return counts.groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93,
    passes: int = 24, window: int = 32, block: int = 2048, seed: int = 7, miss: float = 0.01,
) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id and kept.

    Vectors of one label and one size link when their cosine in double precision is ``least`` or
    more. In labels of every size, each of ``passes`` or more sorts finds links among ``window``
    neighbours; the union of all passes gives components, inside which all members are then
    compared, so a group that is larger than a window loses none of its links. Only a pair that no
    pass brought together, directly or over others, can be missed; :func:`label_plans` adds passes
    until that is expected of at most ``miss`` of the pairs at ``least``, for vectors spread evenly
    around their mean, and says where a label is so dense that it stops earlier. component_id is
    the smallest key reachable by links, kept marks that vector.

    Null labels and vectors that are null, empty, zero or hold null or non-finite numbers link with
    nothing. Equal vectors of a label are compared once and count as often as they occur. Rows
    with a null or repeated key are vectors of their own. An empty table stays empty.
    """
    classes = vector_classes(vectors, key, vector, label)
    plans = label_plans(classes, least, passes, window, miss)
    links = written(window_links(classes, plans, least, window, block, seed), "pairs")
    roots = written(components(links), "roots")
    counts = component_links(classes, roots, least, 1024)
    firsts = classes.select("node", "first").join(roots, "node").groupBy("root").agg(F.min("first").alias("component"))
    known = (
        classes.join(roots, "node", "left").join(firsts, "root", "left").join(counts, "node", "left")
        .select(
            F.col("label").alias("_label"), F.col("v").alias("_v"),
            F.coalesce("linked", F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "first").alias("component_id"),
        )
    )
    rows = vectors.select(
        F.col(f"`{key}`").alias("vec_id"), F.col(f"`{label}`").alias("_row_label"),
        _values(vectors, vector).alias("_row_v"),
    )
    joined = rows.join(known, (F.col("_row_label") == F.col("_label")) & (F.col("_row_v") == F.col("_v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
