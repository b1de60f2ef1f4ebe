"""Rows at given positions of an order, found by counting instead of sorting.

Values are counted in cells that keep their order. The cell that holds a wanted position is cut
into finer cells, until few enough rows are left to be ordered, or one value is. Each pass is an
aggregation over the cells, combined before it is shuffled, so its cost does not depend on how the
values are spread, and a value that a third of the rows share is one cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: First cells per doubling of the value.
_PER_DOUBLING = 256
#: Finer cells of a cell.
FINER_CELLS = 4096
#: Rows of a class that are ordered at once.
_BOUNDED = 4096
_FAR = 1 << 40


def first_cell(value: Column) -> Column:
    """A cell number that never falls as the double grows: so many cells per doubling, zero between.

    It needs no bounds, and its cells are narrow enough for even cuts to be fine from then on.
    """
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(2000.0)) * _PER_DOUBLING) + 300_000
    sized = F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))
    return F.when(F.isnan(value), F.lit(_FAR)).otherwise(sized).cast("long")


def finer_cell(value: Column, low: Column, high: Column, cells: int = FINER_CELLS) -> Column:
    """Which of so many even cells between ``low`` and ``high`` holds the value; both ends differ."""
    share = (value - low).cast("double") / (high - low).cast("double")
    return F.floor(share * cells).cast("long")


@dataclass(frozen=True)
class Key:
    """One key of an order: its name, its direction, and the form it is compared in."""

    name: str
    descending: bool
    kind: str  # long, double or string
    value: Column

    def after(self, cut) -> Column:
        """Whether the row comes after the cut by this key; nulls come first, or last if descending."""
        if self.descending:
            return F.lit(False) if cut is None else F.coalesce(self.value < F.lit(cut), F.lit(True))
        return self.value.isNotNull() if cut is None else F.coalesce(self.value > F.lit(cut), F.lit(False))

    def equals(self, cut) -> Column:
        return self.value.eqNullSafe(F.lit(cut).cast(self.kind))


def order_key(df: DataFrame, name: str, descending: bool = False) -> Key:
    """A key over a column of numbers, dates, times, booleans or text."""
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return Key(name, descending, "string", column)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return Key(name, descending, "double", column.cast("double") + F.lit(0.0))
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        whole = column.cast("long")
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        whole = (column.cast(f"decimal(38,{kind.scale})") * F.lit(10**kind.scale)).cast("long")
    elif isinstance(kind, T.DateType):
        whole = F.unix_date(column).cast("long")
    elif isinstance(kind, T.TimestampType):
        whole = F.unix_micros(column)
    elif isinstance(kind, T.TimestampNTZType):
        # By the fields, which no time zone of the session shifts.
        seconds = F.hour(column) * 3600 + F.minute(column) * 60
        micros = (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long")
        whole = (F.unix_date(F.to_date(column)).cast("long") * 86_400 + seconds) * 1_000_000 + micros
    else:
        raise TypeError(f"rows cannot be ordered by {name}, a {kind.simpleString()}")
    return Key(name, descending, "long", whole)


@dataclass(frozen=True)
class _Class:
    """Rows with given values of the first keys, between two values of the next one."""

    settled: tuple
    low: object = None
    high: object = None
    rows: int = -1

    def holds(self, keys: Sequence[Key]) -> Column:
        inside = F.lit(True)
        for key, cut in zip(keys, self.settled):
            inside = inside & key.equals(cut)
        if self.low is not None:
            value = keys[len(self.settled)].value
            inside = inside & (value >= F.lit(self.low)) & (value <= F.lit(self.high))
        return inside

    def done(self, keys: Sequence[Key]) -> bool:
        return len(self.settled) == len(keys)


@dataclass
class _Search:
    """One order, and for each wanted position the class that holds it and its place there."""

    keys: list[Key]
    open: dict[int, tuple[_Class, int]]

    def slots(self) -> list[_Class]:
        """The classes that still have to be cut; those of one order never overlap."""
        return list(dict.fromkeys(
            c for c, _ in self.open.values() if not c.done(self.keys) and not 0 <= c.rows <= _BOUNDED
        ))


def _by_kind(keys: Sequence[Key], classes: Sequence[_Class], slot: Column, kind: str) -> Column:
    """The current key's value for rows of classes whose key is of this kind, else null."""
    picked = F.lit(None).cast(kind)
    for number, c in enumerate(classes):
        key = keys[len(c.settled)]
        if key.kind == kind:
            picked = F.when(slot == number, key.value).otherwise(picked)
    return picked


def _cells(search: _Search, number: int) -> Column:
    """For one order: a struct of slot, cell and value of each row, null outside all classes."""
    keys, classes = search.keys, search.slots()
    slot = F.lit(None).cast("int")
    for at, c in reversed(list(enumerate(classes))):
        slot = F.when(c.holds(keys), F.lit(at)).otherwise(slot)
    cell, up, down = (F.lit(None).cast(t) for t in ("long", "string", "string"))
    for at, c in enumerate(classes):
        key = keys[len(c.settled)]
        here = slot == at
        first = key.value.isNull()
        if key.kind == "string":
            length = 2 + (len(_shared_start(c.low, c.high)) if c.low is not None else 0)
            start = F.substring(key.value, 1, length)
            up = F.when(here, F.lit(None).cast("string") if key.descending else start).otherwise(up)
            down = F.when(here, start if key.descending else F.lit(None).cast("string")).otherwise(down)
            place = F.lit(0).cast("long")
        else:
            place = first_cell(key.value.cast("double"))
            if c.low is not None:
                place = finer_cell(key.value, F.lit(c.low).cast(key.kind), F.lit(c.high).cast(key.kind))
            place = -place if key.descending else place
        place = F.when(first, F.lit(2 * _FAR if key.descending else -2 * _FAR)).otherwise(place)
        cell = F.when(here, place).otherwise(cell)
    return F.when(slot.isNotNull(), F.struct(
        F.lit(number).alias("search"), slot.alias("slot"), cell.alias("cell"), up.alias("up"), down.alias("down"),
        *[_by_kind(keys, classes, slot, kind).alias(f"v_{kind}") for kind in ("long", "double", "string")],
    ))


def _shared_start(low: str, high: str) -> str:
    size = 0
    while size < min(len(low), len(high)) and low[size] == high[size]:
        size += 1
    return low[:size]


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    """One pass over the rows: every open class shrinks to the cell of the wanted position."""
    busy = [(n, s) for n, s in enumerate(searches) if s.slots()]
    cells = df.select(F.explode(F.array(*[_cells(s, n) for n, s in busy])).alias("c")).where("c is not null").select("c.*")
    kinds = ("long", "double", "string")
    counted = cells.groupBy("search", "slot", "cell", "up", "down").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(f"v_{kind}").alias(f"{name}_{kind}") for kind in kinds for name, f in (("low", F.min), ("high", F.max))],
    )
    # At most as many rows a window as a class has cells.
    line = Window.partitionBy("search", "slot").orderBy("cell", F.asc("up"), F.desc("down"))
    ended = counted.withColumn("end", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    wanted = F.lit(False)
    for number, search in busy:
        for slot, c in enumerate(search.slots()):
            for at in sorted({at for held, at in search.open.values() if held == c}):
                hit = (F.col("end") - F.col("n") < at) & (F.col("end") >= at)
                wanted = wanted | ((F.col("search") == number) & (F.col("slot") == slot) & hit)
    found = ended.where(wanted).collect()  # a row per wanted position at most
    for number, search in busy:
        classes = search.slots()
        for position, (c, at) in list(search.open.items()):
            if c not in classes:
                continue
            slot, key = classes.index(c), search.keys[len(c.settled)]
            for row in found:
                if row["search"] == number and row["slot"] == slot and row["end"] - row["n"] < at <= row["end"]:
                    low, high = row[f"low_{key.kind}"], row[f"high_{key.kind}"]
                    one = low is None or low == high or (isinstance(low, float) and math.isnan(low))
                    if one:
                        smaller = _Class((*c.settled, low), rows=row["n"])
                    else:
                        smaller = replace(c, low=low, high=high, rows=row["n"])
                    search.open[position] = (smaller, at - row["end"] + row["n"])
                    break


def _finish(df: DataFrame, searches: list[_Search]) -> None:
    """Order the rows of the classes that are small by now, and settle their positions."""
    parts = []
    width = max(len(s.keys) for s in searches)
    for number, search in enumerate(searches):
        classes = list(dict.fromkeys(c for c, _ in search.open.values() if not c.done(search.keys)))
        for slot, c in enumerate(classes):
            places = sorted({at for held, at in search.open.values() if held == c})
            rows = df.where(c.holds(search.keys)).select(*[k.value.alias(f"k{i}") for i, k in enumerate(search.keys)])
            order = [F.desc(f"k{i}") if k.descending else F.asc(f"k{i}") for i, k in enumerate(search.keys)]
            numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(slot)).orderBy(*order)))
            typed = [
                (F.col(f"k{i}") if i < len(search.keys) and search.keys[i].kind == kind else F.lit(None).cast(kind)).alias(f"{kind}{i}")
                for i in range(width) for kind in ("long", "double", "string")
            ]
            parts.append(numbered.where(F.col("at").isin(places)).select(F.lit(number).alias("search"), F.lit(slot).alias("slot"), "at", *typed))
    if not parts:
        return
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    found = {(r["search"], r["slot"], r["at"]): r for r in whole.collect()}  # a row per wanted position
    for number, search in enumerate(searches):
        classes = list(dict.fromkeys(c for c, _ in search.open.values() if not c.done(search.keys)))
        for position, (c, at) in list(search.open.items()):
            if c in classes:
                row = found[number, classes.index(c), at]
                values = tuple(row[f"{key.kind}{i}"] for i, key in enumerate(search.keys))
                search.open[position] = (_Class(values), 1)


def half_of(df: DataFrame, order_by: Sequence[str]) -> tuple[int, list[Column]]:
    """The number of rows, and the condition for the later half; an odd row belongs to it."""
    total, found = rows_after(df, {"half": order_by}, lambda n: [n // 2])
    return total, found["half"]


def rows_after(
    df: DataFrame, orders: Mapping[str, Sequence[str | tuple[str, bool]]], positions: Callable[[int], Sequence[int]],
    total: int | None = None,
) -> tuple[int, dict[str, list[Column]]]:
    """The number of rows, and per order a condition for each position: does a row come after it?

    An order is a list of column names, or of names with True for descending order; nulls come
    first, or last where descending. ``positions`` gives the 1-based positions for a number of
    rows. Rows that agree in all keys come out on the same side, so the keys should be unique.

    The keys are searched one after the other: once a key's value at the position is known, only
    its ties matter. Nothing is written and no row travels but those at the positions; the plan
    that uses the conditions compares literals. There is one pass for the count, and some three
    passes in all, more where many rows share the first keys.
    """
    total = df.count() if total is None else total
    searches, names = [], []
    for name, order in orders.items():
        keys = [order_key(df, *((key,) if isinstance(key, str) else key)) for key in order]
        wanted = [p for p in positions(total) if 0 < p < total]
        names.append(name)
        searches.append(_Search(keys, {p: (_Class((), rows=total if total > _BOUNDED else -1), p) for p in wanted}))
    if 0 < total <= _BOUNDED:
        for search in searches:
            search.open = {p: (replace(c, rows=total), at) for p, (c, at) in search.open.items()}
    while any(s.slots() for s in searches):
        _narrow(df, searches)
    _finish(df, searches)
    conditions: dict[str, list[Column]] = {}
    for name, search in zip(names, searches):
        conditions[name] = []
        for position in positions(total):
            if not 0 < position < total:
                conditions[name].append(F.lit(position <= 0))
                continue
            cuts = search.open[position][0].settled
            after = F.lit(False)
            for key, cut in reversed(list(zip(search.keys, cuts))):
                after = key.after(cut) | (key.equals(cut) & after)
            conditions[name].append(after)
    return total, conditions
