"""Exact interpolated quantiles per group at any group size.

The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here the values
of a group are counted in cells, the cells that hold the wanted ranks are cut into finer ones, and
so on, until the cells left are small enough to be counted value by value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.selection import finer_cell, first_cell
from tidemark.session import scratch_path

#: Rows of a cell that are counted value by value, and the finer cells of a larger one.
_BOUNDED = 65_536
_CELLS = 65_536


class _Ranks:
    """The places of the wanted quantiles in a group of ``n`` rows: two neighbours for each.

    Expressions are SQL texts, which are planned much faster than trees of column objects.
    """

    def __init__(self, probabilities: dict[str, float]):
        self.names = list(probabilities)
        # Ten decimals absorb the float error of (n-1)*p before it is split.
        self.places = [f"round((n - 1) * double('{float(p)!r}'), 10)" for p in probabilities.values()]
        self.wanted = []
        for place in self.places:
            self.wanted += [f"floor({place})", f"least(floor({place}) + 1, n - 1)"]
        self.slots = range(len(self.wanted))

    def picks(self) -> list[Column]:
        """For each rank the cell that holds it, from counted cells with their ``_end``."""
        return [
            F.expr(f"max(CASE WHEN _end - _c <= {rank} AND {rank} < _end THEN "
                   f"named_struct('_lo', _lo, '_hi', _hi, '_at', _end - _c, '_c', _c) END) AS _s{j}")
            for j, rank in enumerate(self.wanted)
        ]

    def answers(self) -> list[Column]:
        found = []
        for i, (name, place) in enumerate(zip(self.names, self.places)):
            share = f"({place} - floor({place}))"
            value = F.expr(f"_s{2 * i}._lo * (1.0D - {share}) + _s{2 * i + 1}._lo * {share}")
            found.append(value.alias(name))
        return found

    def slot(self) -> str:
        """The number of the first cell of different values that holds the row."""
        whens = " ".join(
            f"WHEN _s{j}._lo < _s{j}._hi AND _v >= _s{j}._lo AND _v <= _s{j}._hi THEN {j}" for j in self.slots
        )
        return f"CASE {whens} END"

    def of_slot(self, part: str) -> str:
        return f"CASE _slot {' '.join(f'WHEN {j} THEN _s{j}.{part}' for j in self.slots)} END"

    def open_rows(self) -> str:
        """Rows of the largest cell of different values, 0 if every cell is one value."""
        cells = ", ".join(f"CASE WHEN _s{j}._lo < _s{j}._hi THEN _s{j}._c END" for j in self.slots)
        return f"greatest(0L, {cells})"


def grouped_quantiles(
    df: DataFrame,
    groups: list[str],
    value: Column,
    probabilities: dict[str, float],
    few_groups: bool = False,
    weight: Column | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per group, nulls and NaN left out.

    Returns the group columns, ``n`` (values), ``least``, ``most`` and one column per entry of
    ``probabilities``. Groups without values have no row. A ``weight`` says how many values a row
    stands for, as in a histogram.

    The first pass counts each group in 256 cells per doubling of the value. While a cell with a
    wanted rank holds more than 65,536 rows of different values, another pass cuts it into as many
    finer cells; a cell shrinks by that factor each time, so the passes grow with the logarithm of
    the rows. The last pass counts single values, in cells that are bounded by then; no task ever
    holds more than the cells of one group. A cell of one value needs no further pass.

    ``few_groups`` says that the caller has bounded the groups, by a top-k or a list of columns;
    their cells, a row per group, then come to the driver after each pass. Otherwise they are
    written to the shared scratch folder, and adaptive execution joins them.
    """
    ranks = _Ranks(probabilities)
    names = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(f"`{g}`").alias(n) for g, n in zip(groups, names)], (value.cast("double") + F.lit(0.0)).alias("_v"),
                     *([] if weight is None else [weight.cast("long").alias("_w")]))
    rows = rows.where("_v IS NOT NULL AND NOT isnan(_v)")

    few = few_groups or not groups
    keep = _as_local if few else _as_written
    state, open_rows = keep(_first_cells(rows, names, ranks), ranks)
    while open_rows > _BOUNDED:
        state, open_rows = keep(_narrowed(rows, state, names, ranks, exact=False), ranks)
    if open_rows:
        state = _narrowed(rows, state, names, ranks, exact=True)
        state = keep(state, ranks)[0] if few else state
    return state.select(
        *[F.col(n).alias(g) for n, g in zip(names, groups)], "n", "least", "most", *ranks.answers()
    )


def _first_cells(rows: DataFrame, names: list[str], ranks: _Ranks) -> DataFrame:
    """One row per group: n, least, most and the cell of each rank."""
    cells = rows.groupBy(*names, first_cell(F.col("_v")).alias("_cell")).agg(
        F.expr("sum(_w) AS _c" if "_w" in rows.columns else "count(1) AS _c"), F.expr("min(_v) AS _lo"), F.expr("max(_v) AS _hi")
    )
    group = Window.partitionBy(*names)
    upto = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cells.withColumn("_end", F.sum("_c").over(upto)).withColumn("n", F.sum("_c").over(group))
    picked = ranked.groupBy(*names).agg(
        F.max("n").alias("n"), F.min("_lo").alias("least"), F.max("_hi").alias("most"), *ranks.picks()
    )
    return picked.where("n IS NOT NULL")


def _narrowed(rows: DataFrame, state: DataFrame, names: list[str], ranks: _Ranks, exact: bool) -> DataFrame:
    """The state after one more pass: cells of different values are cut, down to values if ``exact``."""
    held = _null_safe_join(rows, state, names).withColumn("_slot", F.expr(ranks.slot())).where("_slot IS NOT NULL")
    weight = ["_w"] if "_w" in rows.columns else []
    held = held.selectExpr(*names, "n", "_v", *weight, "_slot", *[
        f"{ranks.of_slot(part)} AS {name}" for part, name in (("_at", "_from"), ("_lo", "_low"), ("_hi", "_high"))
    ])
    cut = F.col("_v") if exact else finer_cell(F.col("_v"), F.col("_low"), F.col("_high"), _CELLS)
    counted = held.groupBy(*names, "n", "_slot", "_from", cut.alias("_cell")).agg(
        F.expr("sum(_w) AS _c" if "_w" in rows.columns else "count(1) AS _c"), F.expr("min(_v) AS _lo"), F.expr("max(_v) AS _hi")
    )
    upto = Window.partitionBy(*names, "_slot").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_end", F.col("_from") + F.sum("_c").over(upto))
    picked = ranked.groupBy(*names).agg(*ranks.picks()).withColumnsRenamed({f"_s{j}": f"_new{j}" for j in ranks.slots})
    merged = _null_safe_join(state, picked, names, "left")
    return merged.selectExpr(*names, "n", "least", "most", *[f"coalesce(_new{j}, _s{j}) AS _s{j}" for j in ranks.slots])


def _as_written(state: DataFrame, ranks: _Ranks) -> tuple[DataFrame, int]:
    path = scratch_path(state.sparkSession, "cells")
    state.write.parquet(path)
    kept = state.sparkSession.read.schema(state.schema).parquet(path)
    return kept, kept.agg(F.expr(f"coalesce(max({ranks.open_rows()}), 0L)")).first()[0]


def _as_local(state: DataFrame, ranks: _Ranks) -> tuple[DataFrame, int]:
    """The state of a bounded number of groups, a row for each."""
    found = state.selectExpr("*", f"{ranks.open_rows()} AS _open").collect()
    local = state.sparkSession.createDataFrame([row[:-1] for row in found], state.schema)
    return F.broadcast(local), max((row["_open"] for row in found), default=0)


def _null_safe_join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on the groups where null equals null; the right copies are dropped. Without groups, right is one row."""
    if not names:
        return left.join(F.broadcast(right), F.lit(True), how)
    renamed = right.withColumnsRenamed({n: f"_r{n}" for n in names})
    same = reduce(Column.__and__, [left[n].eqNullSafe(renamed[f"_r{n}"]) for n in names])
    return left.join(renamed, same, how).drop(*[f"_r{n}" for n in names])
