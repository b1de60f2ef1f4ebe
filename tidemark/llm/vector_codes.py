"""Product-quantisation codes of vectors, with codebooks fitted by a dual-tree Lloyd iteration.

Vectors are cut into parts, and each part position has a codebook. A task holds a block of rows:
over the parts of a position it builds a tree of boxes, and another one over the codebook's
entries. Pairs of nodes are compared by the least and the greatest distance between their boxes.
An entry node that is surely farther than some other is dropped; a node of parts with one entry
left goes to it as a whole, by its cached sum and count. What stays uncertain down to the leaves is
decided by integer distances. All numbers are integers, so no result depends on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import written

#: Rows of one block: trees are built over so many rows at a time.
_BLOCK = 8192
#: Parts of a leaf at most.
_LEAF = 16
#: Uncertain pairs of a part and an entry that are measured at a time.
_PAIRS = 1 << 19
#: Components beyond it could overflow the sums of squares.
_GREATEST = 1 << 26


@dataclass
class Level:
    """The nodes of one level: where their points start, their boxes, and the sums of their points."""

    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


@dataclass
class Tree:
    """Points in the tree's order, and its levels from the root down; node i has children 2i and 2i+1."""

    order: np.ndarray
    points: np.ndarray
    levels: list[Level]


def build_tree(points: np.ndarray, leaf: int) -> Tree:
    """A balanced tree of boxes: each level cuts every node in half along its longest side.

    Nodes of one point pass it to their first child; the second one is empty, with a box of no use.
    """
    depth = 0
    while -(-len(points) >> depth) > leaf:
        depth += 1
    order = np.arange(len(points))
    levels = []
    start = np.array([0, len(points)])
    for level in range(depth + 1):
        here = points[order]
        at = start[:-1]
        padded = np.concatenate([here, here[-1:]])  # an empty last node starts behind the last point
        low, high = np.minimum.reduceat(padded, at), np.maximum.reduceat(padded, at)
        padded[-1] = 0
        levels.append(Level(start, low, high, np.add.reduceat(padded, at)))
        if level == depth:
            break
        sizes = np.diff(start)
        side = np.repeat(np.argmax(high - low, axis=1), sizes)
        node = np.repeat(np.arange(len(sizes)), sizes)
        order = order[np.lexsort((here[np.arange(len(here)), side], node))]
        cut = np.empty(2 * len(sizes) + 1, dtype=start.dtype)
        cut[0::2], cut[1::2] = start, at + (sizes + 1) // 2
        start = cut
    return Tree(order, points[order], levels)


def _bounds(low_a, high_a, low_b, high_b) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between points of boxes, pair by pair."""
    gap = np.maximum(np.maximum(low_b - high_a, low_a - high_b), 0)
    reach = np.maximum(np.abs(high_b - low_a), np.abs(high_a - low_b))
    return (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)


def _keep_near(nodes: np.ndarray, entries: np.ndarray, parts: Level, books: Level) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (grouped by node) without the entry nodes that are farther than another one for sure.

    An entry node goes only if its least distance exceeds the greatest one of some other, so equal
    distances stay and the lower index can still win.
    """
    least, most = _bounds(parts.low[nodes], parts.high[nodes], books.low[entries], books.high[entries])
    first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
    bound = np.repeat(np.minimum.reduceat(most, first), np.diff(np.r_[first, len(nodes)]))
    near = least <= bound
    return nodes[near], entries[near]


def _children(nodes: np.ndarray) -> np.ndarray:
    return np.column_stack([2 * nodes, 2 * nodes + 1]).ravel()


class Codebook:
    """The entries of one part position: equal ones once, under their lowest index, as a tree."""

    def __init__(self, entries: np.ndarray):
        _, first = np.unique(entries, axis=0, return_index=True)
        self.index = np.sort(first)
        self.tree = build_tree(entries[self.index], 1)
        self.index = self.index[self.tree.order]


def assign(tree: Tree, book: Codebook) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Who goes where: tuples of (start, end, entry, sums) in the tree's order of points.

    A tuple holds arrays, one element per assigned run of points; a whole node is one run with its
    cached sum, a point of an uncertain leaf is a run of its own.
    """
    nodes, entries = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    deep = len(book.tree.levels) - 1
    step = 0
    for level, parts in enumerate(tree.levels):
        if level:
            first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
            sizes = np.diff(np.r_[first, len(nodes)])
            # Both children take over all pairs of their parent, child by child.
            left = np.repeat(np.cumsum(sizes) - sizes, 2 * sizes)
            within = np.arange(2 * len(nodes)) - np.repeat(2 * (np.cumsum(sizes) - sizes), 2 * sizes)
            size = np.repeat(sizes, 2 * sizes)
            entries = entries[left + within % size]
            nodes = 2 * np.repeat(nodes[first], 2 * sizes) + within // size
            nodes, entries = _keep_near(nodes, entries, parts, book.tree.levels[step])
        while step < deep and (level == len(tree.levels) - 1 or step <= level):
            step += 1
            below = book.tree.levels[step]
            nodes, entries = np.repeat(nodes, 2), _children(entries)
            real = below.start[entries + 1] > below.start[entries]
            nodes, entries = _keep_near(nodes[real], entries[real], parts, below)
        if step < deep:
            continue
        first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
        alone = np.diff(np.r_[first, len(nodes)]) == 1
        sure = first[alone]
        at = nodes[sure]
        if len(at):
            yield parts.start[at], parts.start[at + 1], book.index[book.tree.levels[deep].start[entries[sure]]], parts.sums[at]
        left = np.repeat(~alone, np.diff(np.r_[first, len(nodes)]))
        nodes, entries = nodes[left], entries[left]
        if not len(nodes):
            return
    yield from _measure(tree, book, nodes, entries)


def _measure(tree: Tree, book: Codebook, nodes: np.ndarray, entries: np.ndarray):
    """The points of uncertain leaves, each against the entries left for its leaf."""
    leaves, leaf_entries = tree.levels[-1], book.tree.levels[-1]
    spot = leaf_entries.start[entries]
    index, values = book.index[spot], book.tree.points[spot]
    first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
    sizes = np.diff(np.r_[first, len(nodes)])
    owners = nodes[first]
    points = leaves.start[owners + 1] - leaves.start[owners]
    work = np.cumsum(points * sizes)
    for group in np.split(np.arange(len(owners)), np.searchsorted(work, np.arange(_PAIRS, work[-1], _PAIRS))):
        if not len(group):
            continue
        count = np.repeat(sizes[group], points[group])
        point = np.concatenate([np.arange(leaves.start[o], leaves.start[o + 1]) for o in owners[group]])
        begin = np.repeat(first[group], points[group])
        offset = np.cumsum(count) - count
        pair = np.repeat(begin - offset, count) + np.arange(int(count.sum()))
        gap = np.repeat(tree.points[point], count, axis=0) - values[pair]
        # The index in the low digits lets the lower one win among equal distances.
        ranked = (gap * gap).sum(axis=1) * _WIDTH + index[pair]
        best = np.minimum.reduceat(ranked, offset) % _WIDTH
        yield point, point + 1, best, tree.points[point]


#: Entries of a codebook at most: two hex digits.
_WIDTH = 256


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of rows and their parts, as an array of rows x parts x components."""
    held, rows = [], 0

    def block() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        column = table.column("parts").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return table, flat.reshape(len(table), parts, -1)

    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            piece = batch.slice(at, _BLOCK)
            if rows and rows + piece.num_rows > _BLOCK:
                yield block()
                held, rows = [], 0
            held.append(piece)
            rows += piece.num_rows
    if rows:
        yield block()


def _next_entries(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floored mean of its parts, unused ones as they were."""
    parts, entries, width = books.shape

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Codebook(book) for book in books]
        sums = np.zeros((parts, entries, width), dtype=np.int64)
        counts = np.zeros((parts, entries), dtype=np.int64)
        for _, values in _blocks(batches, parts):
            for part in range(parts):
                for start, end, entry, total in assign(build_tree(values[:, part], _LEAF), trees[part]):
                    np.add.at(sums[part], entry, total)
                    np.add.at(counts[part], entry, end - start)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()),
            pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
        ], names=["part", "entry", "n", "sums"])

    seen = kept.select("parts").mapInArrow(collect, "part int, entry int, n long, sums array<long>")
    total = seen.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    )
    after = books.copy()
    for row in total.collect():  # parts x entries rows at most
        after[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return after


def _coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """The kept rows with ``code`` and ``error`` in place of their parts."""
    parts = len(books)
    others = [c for c in kept.columns if c != "parts"]
    schema = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in others)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Codebook(book) for book in books]
        for table, values in _blocks(batches, parts):
            codes = np.empty((len(table), parts), dtype=np.uint8)
            error = np.zeros(len(table), dtype=np.int64)
            for part in range(parts):
                tree = build_tree(values[:, part], _LEAF)
                chosen = np.empty(len(table), dtype=np.int64)
                for start, end, entry, _ in assign(tree, trees[part]):
                    sizes = end - start
                    run = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                    chosen[tree.order[run]] = np.repeat(entry, sizes)
                codes[:, part] = chosen
                gap = values[:, part] - books[part][chosen]
                error += (gap * gap).sum(axis=1)
            text = codes.tobytes().hex()
            hexes = [text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]
            out = table.select(others).append_column("code", pa.array(hexes, pa.string()))
            yield from out.append_column("error", pa.array(error, pa.int64())).combine_chunks().to_batches()

    return kept.mapInArrow(code, f"{schema}, code string, error long")


def _usable(vector: Column) -> Column:
    """A vector without null or non-finite components."""
    whole = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def encode_vectors(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors, and the codebooks as integers (parts x entries x components).

    Columns: the key, the label, ``code`` (two hex digits per part) and ``error`` (squared distances
    to the chosen entries, summed over the parts, in units of 1/scale).

    Each component becomes floor(scale * x). A codebook starts as the parts of the rows with the
    smallest keys (null keys last, rows of one key by their vectors); fewer rows give fewer entries.
    Each round sends every part to its nearest entry, the lower index among equals, and moves each
    entry to the floored mean of its parts. Codebooks have a fixed size, so they travel with the
    tasks; only sums per part and entry come back.

    Left out are null vectors, vectors with null or non-finite components, and vectors of another
    length than the usable vector of the smallest key, or of a length that the parts do not divide.
    Rows may repeat, and each is coded for itself. Components of 2**26 / scale and beyond raise an
    error, because their squares would not fit. An empty table gives no rows and empty codebooks.
    """
    if entries > _WIDTH:
        raise ValueError(f"at most {_WIDTH} entries")
    cell = F.col(f"`{vector}`")
    usable = vectors.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").alias("_label"), cell.alias("_vector"))
    usable = usable.where(_usable(F.col("_vector")) & (F.size("_vector") > 0) & (F.size("_vector") % parts == 0))
    order = [F.col("_key").asc_nulls_last(), F.col("_vector")]
    first = usable.orderBy(*order).limit(1).select(F.size("_vector")).first()
    length = first[0] if first else parts
    whole = F.transform("_vector", lambda x: F.floor(x.cast("double") * scale))
    checked = F.transform(whole, lambda x: F.when(F.abs(x) < _GREATEST, x.cast("int")).otherwise(
        F.raise_error(F.lit(f"a component is {_GREATEST} / {scale} or more")).cast("int")))
    slim = usable.where(F.size("_vector") == length).select("_key", "_label", checked.alias("parts"))
    kept = written(slim, "parts")

    starts = kept.orderBy(F.col("_key").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    books = np.array([row["parts"] for row in starts], dtype=np.int64).reshape(len(starts), parts, length // parts)
    books = np.ascontiguousarray(books.transpose(1, 0, 2))
    if starts:
        for _ in range(rounds):
            books = _next_entries(kept, books)
        coded = _coded(kept, books)
    else:
        coded = kept.select("_key", "_label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    names = [F.col("_key").alias(key), F.col("_label").alias(label), "code", "error"]
    return coded.select(*names), books


def codebooks_sha256(books: np.ndarray) -> str:
    """SHA-256, in lower-case hex, of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """Codes with the error of each label: see :func:`encode_vectors`, whose options it takes.

    Columns: the key, ``code``, ``error``, ``label_error`` (of all rows of equal label, null labels
    together) and ``codebooks_sha256``. Errors are summed per label before they meet the rows.
    """
    coded, books = encode_vectors(vectors, key=key, vector=vector, label=label, **options)
    coded = written(coded.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").alias("_label"), "code", "error"), "codes")
    sums = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("_label").eqNullSafe(F.col("_of")))
    return joined.select(
        F.col("_key").alias(key), "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256")
    )
