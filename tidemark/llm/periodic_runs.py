"""Runs of repeated words: every maximal stretch of a text that repeats with a shortest period.

The method is that of Lyndon roots. Suffix trees of the words and of the words backwards, built
online with suffix links, say in constant time how far two places agree in either direction: the
tree's tour turns, between two leaves, at the node whose depth is that length. For each place and
for both orders of the words, the longest Lyndon word that starts there is the only root it can
have; extended both ways, the roots give all runs, and nothing else has to be tried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Rows read into Python objects at a time.
_ROWS = 200


def suffix_tree(symbols: list[int]) -> tuple[list[int], list[int], list[int], list[bool]]:
    """Ukkonen's tree of ``symbols``, whose last symbol occurs once: parent, start and end of each edge, and leaves.

    Node 0 is the root. Leaves appear in the order of their suffixes.
    """
    size = len(symbols)
    width = max(symbols) + 1
    step: dict[int, int] = {}  # node * width + first symbol of an edge: the node below
    parent, start, end, link, leaf = [0], [0], [0], [0], [False]
    node = length = edge = waiting = 0
    for at, symbol in enumerate(symbols):
        waiting += 1
        fresh = 0
        while waiting:
            if not length:
                edge = at
            key = node * width + symbols[edge]
            below = step.get(key)
            if below is None:
                step[key] = len(parent)
                parent.append(node)
                start.append(at)
                end.append(size)
                link.append(0)
                leaf.append(True)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                begin = start[below]
                reach = end[below]
                span = (reach if reach <= at else at + 1) - begin
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                middle = symbols[begin + length]
                if middle == symbol:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                cut = len(parent)
                step[key] = cut
                parent += (node, cut)
                start += (begin, at)
                end += (begin + length, size)
                link += (0, 0)
                leaf += (False, True)
                parent[below] = cut
                start[below] = begin + length
                base = cut * width
                step[base + middle] = below
                step[base + symbol] = cut + 1
                if fresh:
                    link[fresh] = cut
                fresh = cut
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = at - waiting + 1
    return parent, start, end, leaf


class CommonPrefixes:
    """How long the suffixes at two places agree, in constant time; and the order of all suffixes."""

    def __init__(self, symbols: list[int]):
        parent, start, end, leaf = suffix_tree(symbols)
        parent, leaf = np.asarray(parent), np.asarray(leaf)
        span = np.asarray(end) - start
        first = np.asarray(symbols)[np.asarray(start)]
        # Children of each node side by side, the largest first: the stack then pops the smallest.
        below = 1 + np.lexsort((-first[1:], parent[1:]))
        bounds = np.searchsorted(parent[below], np.arange(len(parent) + 1)).tolist()
        below, spans = below.tolist(), span.tolist()
        suffix = (np.cumsum(leaf) - 1).tolist()
        is_leaf = leaf.tolist()
        order, turns = [], []
        turn = 0
        stack = [(0, 0, -1)]
        while stack:
            node, depth, turned = stack.pop()
            if turned >= 0:
                turn = turned
            if is_leaf[node]:
                order.append(suffix[node])
                turns.append(turn)
                continue
            depth += spans[node]
            children = below[bounds[node] : bounds[node + 1]]
            stack += [(child, depth, depth) for child in children]
            stack[-1] = (children[-1], depth, -1)
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        table = [np.asarray(turns, dtype=np.int32)]
        while (1 << len(table)) < len(order):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``a`` and at ``b`` share at their start, pair by pair; a is never b."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        shared = np.empty(len(low), dtype=np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            shared[at] = np.minimum(row[low[at] + 1], row[high[at] + 1 - (1 << k)])
        return shared


def _next_smaller(ranks: list[int]) -> np.ndarray:
    """For each place the next one of smaller rank, or the length."""
    found = [len(ranks)] * len(ranks)
    stack: list[int] = []
    for at, rank in enumerate(ranks):
        while stack and ranks[stack[-1]] > rank:
            found[stack.pop()] = at
        stack.append(at)
    return np.asarray(found)


def runs_in(words: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least ``least`` words and ``times`` periods.

    ``words`` are numbers from 1, equal for equal words. Runs come in order of start and period.
    """
    size = len(words)
    forward = CommonPrefixes(words.tolist() + [0])
    backward = CommonPrefixes(words[::-1].tolist() + [0])
    ranks = forward.rank[:size]
    places = np.arange(size)
    found = []
    for order in (ranks, -ranks):
        root = _next_smaller(order.tolist()) - places
        some = np.flatnonzero((times * root <= size) & (places + root < size))
        if not len(some):
            continue
        period = root[some]
        start = some - backward(size - some, size - some - period)
        length = some + period + forward(some, some + period) - start
        whole = (length >= least) & (length >= times * period)
        found.append(np.column_stack([start[whole], length[whole], period[whole]]))
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def stretches(words: np.ndarray, document: np.ndarray, least: int, times: int) -> np.ndarray:
    """Which words can lie in a run: a mask, exact in the sense that no word of a run is left out.

    Each word of a run of ``times`` periods occurs ``times`` times in it. So words that are rarer
    in their stretch cut it, stretches of under ``least`` words go, and the same holds for what is
    left, until nothing changes. All documents of a batch are cut together.
    """
    alive = np.arange(len(words))
    stretch = document.astype(np.int64)
    while len(alive):
        _, which, counts = np.unique(stretch * (int(words.max()) + 1) + words[alive], return_inverse=True, return_counts=True)
        often = counts[which] >= times
        kept, before = alive[often], stretch[often]
        if not len(kept):
            alive = kept
            break
        new = np.r_[True, (np.diff(kept) != 1) | (np.diff(before) != 0)]
        stretch = np.cumsum(new) - 1
        long = (np.bincount(stretch) >= least)[stretch]
        settled = often.all() and long.all()
        alive, stretch = kept[long], stretch[long]
        if settled:
            break
    mask = np.zeros(len(words), dtype=bool)
    mask[alive] = True
    return mask


def _runs_of(words: np.ndarray, mask: np.ndarray, least: int, times: int) -> np.ndarray:
    """The runs of one document, from one tree of its stretches with a symbol of its own between two."""
    at = np.flatnonzero(mask)
    if not len(at):
        return np.zeros((0, 3), dtype=np.int64)
    values = np.unique(words[at], return_inverse=True)[1] + 1
    gaps = np.flatnonzero(np.diff(at) != 1) + 1
    walls = int(values.max()) + 1 + np.arange(len(gaps))
    text = np.insert(values, gaps, walls)
    place = np.insert(at, gaps, -1)
    runs = runs_in(text, least, times)
    runs[:, 0] = place[runs[:, 0]]
    return runs


def _kept(runs: np.ndarray, size: int) -> np.ndarray:
    """Which words stay: those that no run holds behind its first period."""
    depth = np.zeros(size + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


def _most_repeated(runs: np.ndarray) -> tuple[int, int, int]:
    """The run of greatest length / period as an exact fraction; ties go to the smaller start, then period."""
    best = runs[0]
    for run in runs[1:]:  # in order of start and period
        if int(run[1]) * int(best[2]) > int(best[1]) * int(run[2]):
            best = run
    return tuple(int(value) for value in best)


_RUN = "array<struct<start:long,length:long,period:long>>"


def find_runs(
    docs: DataFrame, key: str = "doc_id", text: str | Column = "text", least: int = 24, times: int = 3,
    with_text: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_runs, the most repeated run, and digests of all runs and of what they leave.

    Columns: ``start``, ``length``, ``period``, ``exponent_milli`` of the run of greatest length per
    period (ties: the smaller start, then period; null without runs), ``runs_sha256`` (of a line
    ``start,length,period`` per run, by start, then period) and ``collapsed_sha256`` (of the words
    that no run holds behind its first period, joined by spaces). With ``with_text``, also ``runs``
    and ``collapsed``, the runs and the text behind these digests.

    Words are runs of other characters than ASCII white space, numbered from 0 and compared
    exactly. A run has at least ``least`` words and ``times`` times its shortest period and cannot
    be extended. Whole texts are searched however long; only stretches whose words all occur
    ``times`` times need a tree (see :func:`stretches`). No rows meet, so nothing is shuffled. A null
    or blank text has no words and no run. Keys may be null or repeated; other columns are not carried.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    ) + (f", runs {_RUN}, collapsed string" if with_text else "")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            split = [(value or b"").split() for value in batch.column(1).to_pylist()]
            numbers: dict[bytes, int] = {}
            codes = np.fromiter((numbers.setdefault(word, len(numbers)) for part in split for word in part), np.int64)
            sizes = np.array([len(part) for part in split])
            mask = stretches(codes, np.repeat(np.arange(len(split)), sizes), least, times)
            ends = np.cumsum(sizes)
            rows = []
            for words, first, last in zip(split, ends - sizes, ends):
                runs, kept = np.zeros((0, 3), dtype=np.int64), words
                if mask[first:last].any():
                    runs = _runs_of(codes[first:last], mask[first:last], least, times)
                    kept = [word for word, stays in zip(words, _kept(runs, len(words)).tolist()) if stays]
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
                best = _most_repeated(runs) if len(runs) else (None, None, None)
                left = b" ".join(kept)
                row = [len(runs), *best, 1000 * best[1] // best[2] if len(runs) else None,
                       hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()]
                if with_text:
                    row += [[dict(zip(("start", "length", "period"), run)) for run in runs.tolist()], left.decode("utf-8", "replace")]
                rows.append(row)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            if with_text:
                kinds += [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]
                names += ["runs", "collapsed"]
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    whole = (F.col(f"`{text}`") if isinstance(text, str) else text).cast("string").cast("binary")
    return docs.select(F.col(f"`{key}`").alias("doc_id"), whole.alias("text")).mapInArrow(search, schema)


def repeat_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Column:
    """The text, with a periodic tail in a tenth of the rows that the key decides; other rows as they are.

    With h the CRC-32 of the key's decimal digits, g its tenth part and n words: where h ends in 0,
    each word from place a = g % n on becomes the one at a + (i - a) % p, for p = 1 + (n - a) //
    (3 + g % 8). It plants runs of known shape in real texts. Null keys plant nothing.
    """
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n = F.size(words).cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    head = F.slice(words, 1, a.cast("int"))
    cycle = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = F.floor((n - a) / p).cast("int")
    rest = F.slice(words, (a + 1).cast("int"), ((n - a) % p).cast("int"))
    tailed = F.array_join(F.concat(head, F.flatten(F.array_repeat(cycle, times)), rest), " ")
    return F.when((h % 10 == 0) & (F.size(words) > 0), tailed).otherwise(F.col(f"`{text}`").cast("string"))
