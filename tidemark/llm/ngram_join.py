"""Jaccard join of word n-gram sets: PartEnum signatures, exact comparison inside candidate clusters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import LOWER, UPPER, drop_written, written, written_in_rounds
from tidemark.llm.graph import components

_CELLS = 1 << 18  # of the count sketch; its size bounds what is broadcast
_BITS = 1 << 24  # of the bitmap of wanted texts
_REMEMBERED = 400_000  # word hashes a worker keeps
_HELD = 500_000  # shingles or signatures that a worker collects before it counts them or hands them over
_BUCKET = 1_000_000  # shingles of all rows for each bucket of signatures
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SENT = 5  # bytes of a signature, and of a set's name, that travel to its bucket
_ROUNDS = 3  # at most, in which candidates are read and compared; each has its own tables and shuffles
_ROUND = 10_000_000  # shingles of all rows from which another round pays
_PAIRED = 16  # sets with one signature that are still counted pair by pair
_WHOLE = 12  # score of a candidate pair; a multiple of 1, 2, 3 and 4
_SPREAD = 3, 2  # parts of the domain for each part that must agree, as a fraction
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A second hash of 64-bit hashes (the finishing steps of splitmix64)."""
    x = values + np.uint64((salt * 2 + 1) * int(_MIX[0]) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, each computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingles:
    """Sorted distinct 64-bit hashes of the word n-grams of a text in UTF-8."""

    def __init__(self, n: int):
        self.n = n
        self.known = _Words()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(_LOWER).split()  # at the six white-space bytes
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        word = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.n, len(words))
        total = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            total += word[i : i + len(total)]
            total *= _MIX[1]
            total ^= total >> np.uint64(29)
        total.sort()
        if len(total) > 1:
            total = total[np.concatenate(([True], total[1:] != total[:-1]))]
        return total


def _print(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _node(digest: bytes | None) -> int | None:
    """A short, even name of a set while candidates are sought; exact steps use the whole digest."""
    return None if digest is None else int.from_bytes(digest[:_SENT], "little") & ~1


class Bands:
    """Size bands: sets that link are in one band or in two next to each other.

    For a similarity of num/den, sizes of a pair differ by den/num at most and its Hamming
    distance is at most (den - num) / (den + num) of the sum of its sizes.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ends = [0]

    def of(self, size: int) -> int:
        while self.ends[-1] < size:
            self.ends.append((self.ends[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.ends, size))

    def distance(self, band: int) -> int:
        self.of(self.ends[-1] + 1) if band >= len(self.ends) else None
        return 2 * self.ends[band] * (self.den - self.num) // (self.den + self.num)


def signatures(shingles: np.ndarray, bands: Bands, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of one set, and which of them suffice alone.

    For its size band and the next, a set names k + m parts of the domain with what it holds there.

    Within a band two linked sets differ in at most k elements, so of parts of the domain at most k
    hold different elements: of the non-empty parts of either set all but k are equal. It is enough
    that each set names k + m of them in one order of all parts' contents: linked sets then share m.
    That order puts parts with the most elements that are not hot first, which unrelated sets hardly
    share. Small sets use single elements as parts and m = 1; m - 1 stands in the last two bits of a
    signature. A set with fewer than k + m non-empty parts names them all and shares one at least;
    with no more than k, it also gets the signature of all such sets of the band.
    """
    found, thin = [], []
    own = bands.of(len(shingles))
    rare = ~hot[(shingles & np.uint64(_CELLS - 1)).astype(np.int64)]
    for band in (own, own + 1):
        k = bands.distance(band)
        if k == 0:
            continue  # only equal sets, which are one already
        if bands.ends[band] <= 30:
            tokens, good = _mixed(shingles, band), rare.astype(np.int64)
        else:
            parts = (_mixed(shingles, 7 * band + 3) >> np.uint64(20)) % np.uint64(_SPREAD[0] * (k + 1) // _SPREAD[1])
            order = np.argsort(parts, kind="stable")
            parts = parts[order]
            starts = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))
            sums = np.add.reduceat(_mixed(shingles[order], band), starts)
            tokens = _mixed(sums + parts[starts] * _MIX[0], band)
            good = np.add.reduceat(rare[order].astype(np.int64), starts)
        need = min(1 + k // 8, 4) if bands.ends[band] > 30 else 1
        slim = len(tokens) < k + need
        if len(tokens) > k + need:
            score = (tokens >> np.uint64(2)) | ((3 - np.minimum(good, 3)).astype(np.uint64) << np.uint64(62))
            tokens = tokens[np.argpartition(score, k + need - 1)[: k + need]]
        elif len(tokens) <= k:
            tokens = np.append(tokens, _mixed(np.array([band], dtype=np.uint64), 99))
        thin.append(np.full(len(tokens), slim))
        tokens = tokens & ~np.uint64(3) | np.uint64(need - 1)
        found.append(tokens)
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    return np.concatenate(found), np.concatenate(thin)


def _batches(work):
    """mapInArrow over record batches; ``work`` gets the batches and yields columns by name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def document_sets(docs: DataFrame, key: str, text: str, n: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, set, node, n_shingles, th) of every row, and which cells of the count sketch are hot.

    ``set`` is a 128-bit digest of the shingles, null without words; ``th`` a hash of the text. The
    sketch counts the shingles of all rows in a fixed number of cells; a cell is hot that holds
    far more than its share. It only orders signatures.
    """
    kind = docs.schema[key].dataType.simpleString()
    prepared = docs.select(
        F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text")
    ).withColumn("th", F.xxhash64("text"))

    def digest(batches):
        shingles, cells, kind = Shingles(n), np.zeros(_CELLS, dtype=np.int64), pa.int64()
        for batch in batches:
            prints, sizes, at, held = [], [], [], 0
            for value in batch.column("text"):
                found = shingles(value.as_py())
                prints.append(_print(found))
                sizes.append(len(found))
                at.append((found & np.uint64(_CELLS - 1)).astype(np.int64))
                held += len(found)
                if held >= _HELD:
                    cells += np.bincount(np.concatenate(at), minlength=_CELLS)
                    at, held = [], 0
            if at:
                cells += np.bincount(np.concatenate(at), minlength=_CELLS)
            rows, kind = len(prints), batch.column("doc_id").type
            yield {"doc_id": batch.column("doc_id"), "set": pa.array(prints, pa.binary()),
                   "node": pa.array([_node(p) for p in prints], pa.int64()), "n_shingles": pa.array(sizes, pa.int64()), "th": batch.column("th"),
                   "slice": pa.nulls(rows, pa.int32()), "cells": pa.nulls(rows, pa.binary())}
        parts = np.split(cells, 16)
        if cells.any():
            nothing = pa.nulls(16, pa.int64())
            yield {"doc_id": pa.nulls(16, kind), "set": pa.nulls(16, pa.binary()), "node": nothing,
                   "n_shingles": nothing, "th": nothing, "slice": pa.array(range(16), pa.int32()),
                   "cells": pa.array([p.tobytes() for p in parts], pa.binary())}

    both = written(prepared.mapInArrow(
        _batches(digest), f"doc_id {kind}, set binary, node long, n_shingles long, th long, slice int, cells binary"
    ), "sets")

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.int64) for c in frame["cells"])
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "salt": frame["salt"].iloc[:1] // 64,
                             "cells": [total.tobytes()]})

    shape = "slice int, salt long, cells binary"
    sketch = both.where("slice is not null").select(
        "slice", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"), "cells"
    )
    for _ in range(2):
        sketch = sketch.groupBy("slice", "salt").applyInPandas(added, shape)
    cells = np.zeros(_CELLS, dtype=np.int64)
    for r in sketch.collect():
        at = r["slice"] * (_CELLS // 16)
        cells[at : at + _CELLS // 16] = np.frombuffer(r["cells"], dtype=np.int64)
    mean = cells.mean()
    return both.where("slice is null").drop("slice", "cells"), cells > mean + 5 * np.sqrt(mean) + 8


def _blocks(texts: Iterator[bytes | None], n: int, bands: Bands, hot: np.ndarray, buckets: int) -> Iterator[dict[str, pa.Array]]:
    """Signatures of texts and names of their sets, in blocks: one per bucket of the signature's hash each time.

    What has been collected is handed over whenever it exceeds ``_HELD`` signatures, however many
    texts a batch has.
    """
    make, seen, signs, nodes, held = Shingles(n), set(), [], [], 0

    def dealt() -> dict[str, pa.Array]:
        sign, node = np.concatenate(signs), np.concatenate(nodes)
        bucket = (sign >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        sign, node, bucket = sign[order], node[order], bucket[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.append(starts[1:], len(bucket))
        return {"bucket": pa.array(bucket[starts].astype(np.int64)),
                "signs": pa.array([sign[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                "nodes": pa.array([node[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())}

    for value in texts:
        found = make(value)
        digest = _print(found)
        if digest is None or digest in seen:
            continue
        if len(seen) > 1_000_000:
            seen.clear()
        seen.add(digest)
        sign, thin = signatures(found, bands, hot)
        signs.append(sign)
        nodes.append(thin + np.int64(_node(digest)))
        held += len(sign)
        if held >= _HELD:
            yield dealt()
            signs, nodes, held = [], [], 0
    if held:
        yield dealt()


def _sent(values: bytes) -> bytes:
    """The low ``_SENT`` bytes of each 64-bit number: all of a set's name.

    Of a signature they are enough to tell those of one bucket apart; two that agree by chance make a
    candidate at most, and candidates are compared exactly.
    """
    return np.frombuffer(values, dtype=np.uint8).reshape(-1, 8)[:, :_SENT].tobytes()


def _received(parts: Iterable[bytes]) -> np.ndarray:
    """The 64-bit numbers whose low bytes :func:`_sent` has left."""
    low = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, _SENT)
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, :_SENT] = low
    return out.view("<u8").ravel()


def _scored_pairs(sign: np.ndarray, node: np.ndarray) -> pd.DataFrame:
    """(a, b, star, score) of one bucket's signatures: see :func:`candidate_links`.

    Most signatures are of one set; they go before anything else is made of them.
    """
    order = np.argsort(sign)
    sign = sign[order]
    shared = np.zeros(len(sign) + 1, dtype=bool)
    shared[1:-1] = sign[1:] == sign[:-1]
    shared = shared[1:] | shared[:-1]
    sign, node = sign[shared], node[order[shared]]
    del order, shared
    order = np.lexsort((node, sign))
    sign, node, thin = sign[order], node[order] & ~1, node[order] & 1 == 1
    starts = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1]))) if len(sign) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(sign)))
    small = np.repeat(sizes <= _PAIRED, sizes)
    worth = _WHOLE // ((sign & np.uint64(3)).astype(np.int64) + 1)
    first = np.repeat(node[starts], sizes)
    ends, scores = [np.stack([node, first], axis=1)[~small]], [np.full(int((~small).sum()), _WHOLE)]
    for step in range(1, _PAIRED):
        at = np.flatnonzero((sign[step:] == sign[:-step]) & small[step:])
        if len(at) == 0:
            break
        ends.append(np.stack([node[at + step], node[at]], axis=1))
        scores.append(np.where(thin[at] | thin[at + step], _WHOLE, worth[at]))
    stars = np.arange(sum(map(len, scores))) < len(scores[0])
    ends, scores = np.concatenate(ends), np.concatenate(scores)
    differ = ends[:, 0] != ends[:, 1]
    rows = np.column_stack([ends, stars])[differ]
    pairs, back = np.unique(rows, axis=0, return_inverse=True)
    total = np.bincount(back.ravel(), weights=scores[differ], minlength=len(pairs)).astype(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "star": pairs[:, 2] == 1, "score": total})


def candidate_links(docs: DataFrame, text: str, n: int, bands: tuple[int, int], hot: np.ndarray, shingles: int) -> DataFrame:
    """(a, b, star): names of sets that share enough signatures.

    Sets that share a signature with few others are counted pair by pair, as linked sets share m of
    them; all that share one with more than ``_PAIRED`` sets are joined to the first of these, and
    such a ``star`` stands for all pairs among its sets.

    Each task names a set once and hands its signatures over in blocks, one per bucket of the
    signature's hash, of both no more bytes than it takes; the number of buckets follows the number
    of shingles, so a bucket stays small. Sets that are equal in a task's batches are named once, so a text that a third of the
    rows repeat weighs no more than the number of tasks.
    """
    buckets = max(24, shingles // _BUCKET)
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def name(batches):
        texts = (value.as_py() for batch in batches for value in batch.column("text"))
        for block in _blocks(texts, n, Bands(*bands), shared.value, buckets):
            yield block | {c: pa.array([_sent(v) for v in block[c].to_pylist()], pa.binary()) for c in ("signs", "nodes")}

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        return _scored_pairs(_received(frame["signs"]), _received(frame["nodes"]).view(np.int64))

    blocks = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("text")).mapInArrow(
        _batches(name), "bucket long, signs binary, nodes binary"
    )
    scored = blocks.groupBy("bucket").applyInPandas(join, "a long, b long, star boolean, score long")
    return scored.groupBy("a", "b", "star").agg(F.sum("score").alias("score")).where(F.col("score") >= _WHOLE).drop("score")


def wanted_sets(docs: DataFrame, text: str, n: int, hashes: DataFrame) -> DataFrame:
    """(set, shingles) of texts whose hash is among ``hashes`` (th), once or more per set.

    A bitmap of fixed size keeps other texts from being read into sets; those that slip through
    find no partner in later joins.
    """
    def bits(batches):
        got = np.zeros(_BITS // 8, dtype=np.uint8)
        for batch in batches:
            at = batch.column("th").to_numpy(zero_copy_only=False).astype(np.uint64) % np.uint64(_BITS)
            np.bitwise_or.at(got, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        yield {"part": pa.array(range(16), pa.int32()), "bits": pa.array([p.tobytes() for p in np.split(got, 16)], pa.binary())}

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in frame["bits"]])
        return pd.DataFrame({"part": frame["part"].iloc[:1], "bits": [total.tobytes()]})

    parts = {r["part"]: r["bits"] for r in hashes.coalesce(16).mapInArrow(
        _batches(bits), "part int, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary").collect()}
    bitmap = np.frombuffer(b"".join(parts.get(i, bytes(_BITS // 128)) for i in range(16)), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def read(batches):
        make, seen = Shingles(n), set()
        for batch in batches:
            at = batch.column("th").to_numpy(zero_copy_only=False).astype(np.uint64) % np.uint64(_BITS)
            inside = (shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            prints, sets, held = [], [], 0
            for place in np.flatnonzero(inside).tolist():
                found = make(batch.column("text")[place].as_py())
                digest = _print(found)
                if digest is not None and digest not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(digest)
                    prints.append(digest)
                    sets.append(found.tobytes())
                    held += len(found)
                    if held >= _HELD:
                        yield {"set": pa.array(prints, pa.binary()), "shingles": pa.array(sets, pa.binary())}
                        prints, sets, held = [], [], 0
            yield {"set": pa.array(prints, pa.binary()), "shingles": pa.array(sets, pa.binary())}

    prepared = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))
    return prepared.mapInArrow(_batches(read), "set binary, shingles binary")


def cluster_links(names: list[bytes], sets: list[np.ndarray], num: int, den: int, sides: np.ndarray | None = None):
    """Links (pairs of names) that span the linked components among the sets of one cluster.

    A pivot is compared with all sets by counting, until no two sets are left that are neither
    compared nor in one component. With ``sides`` only pairs across the two sides matter.
    """
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mark = np.zeros(ids.max() + 1, dtype=np.int64)
    group = np.arange(len(sets))
    done = np.zeros(len(sets), dtype=bool)
    links = []
    while True:
        # The next pivot is of the smallest component that is not finished.
        counts = np.bincount(group, minlength=len(sets))
        left = np.flatnonzero(~done & (counts[group] < len(sets)))
        if len(left) == 0:
            return links
        largest = np.argmax(counts)
        outside = left[group[left] != largest]
        if counts[largest] > 1 and len(outside) == 0:
            return links  # all others were pivots and met the whole cluster
        pivot = outside[0] if counts[largest] > 1 else left[0]
        done[pivot] = True
        own = ids[starts[pivot] : starts[pivot] + sizes[pivot]]
        mark[own] = 1
        common = np.add.reduceat(mark[ids], starts)
        mark[own] = 0
        near = den * common >= num * (sizes + sizes[pivot] - common)
        if sides is not None:
            near &= sides != sides[pivot]
        for other in np.flatnonzero(near & (group != group[pivot])):
            if group[other] != group[pivot]:
                links.append((names[pivot], names[other]))
                group[group == group[other]] = group[pivot]


def pair_links(names: list[bytes], sets: list[np.ndarray], pairs: np.ndarray, num: int, den: int):
    """Links (pairs of names) that span the components that the given pairs (places) link, if similar.

    Each pair is compared, but for those that earlier links have joined already.
    """
    sizes = np.array([len(s) for s in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    mark = np.zeros(max(int(i.max()) for i in ids) + 1, dtype=bool)
    root = list(range(len(sets)))

    def find(at: int) -> int:
        while root[at] != at:
            root[at] = root[root[at]]
            at = root[at]
        return at

    links, marked = [], -1
    for one, two in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        a, b = find(one), find(two)
        if a == b or den * min(sizes[one], sizes[two]) < num * max(sizes[one], sizes[two]):
            continue
        if marked != one:
            if marked >= 0:
                mark[ids[marked]] = False
            mark[ids[one]], marked = True, one
        common = int(np.count_nonzero(mark[ids[two]]))
        if den * common >= num * (sizes[one] + sizes[two] - common):
            links.append((names[one], names[two]))
            root[a] = b
    return links


def paired_links(
    sets: DataFrame, members: DataFrame, pairs: DataFrame, groups: DataFrame, num: int, den: int, paths: list[str],
    most: int = 1_500_000,
) -> DataFrame:
    """(a, b): links among candidate pairs (a, b), which span the components that these pairs link.

    ``groups`` has (node, root) of the pairs' components; pairs of others are left out. Pairs that hang together are compared in one task, so a set travels once however many partners
    it has; each pair is compared by itself, so the work grows with the pairs and not with the
    square of what hangs together. What has more than ``most`` shingles goes to :func:`exact_links`.
    """
    known = groups.join(members.select("node", "set", "n_shingles").distinct(), "node").select("node", "root", "set", "n_shingles")
    weights = written(known.groupBy("root").agg(F.sum("n_shingles").alias("weight")), "group-weights", paths)
    total, heavy = weights.agg(F.sum("weight"), F.sum((F.col("weight") > most).cast("long"))).first()
    tasks = F.lit(max(64, 8 * (int(total or 0) // most)))
    light = weights.where(F.col("weight") <= most).select("root", F.pmod(F.xxhash64("root"), tasks).alias("task"))
    sized = sets.join(known.join(light, "root"), "set").select("task", "root", "node", "set", "shingles")
    roots = groups.withColumnsRenamed({"node": "a"})
    edges = pairs.join(roots, "a").join(light, "root").select("task", "root", "a", "b")
    edges = edges.toDF("its_task", "its_root", "a", "b")

    def compare(texts: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        links, by_root = [], dict(list(wanted.groupby("its_root", sort=False)))
        for root, one in texts.drop_duplicates("set").groupby("root", sort=False):
            if root not in by_root or len(one) < 2:
                continue
            at: dict[int, list[int]] = {}
            for place, node in enumerate(one["node"]):
                at.setdefault(node, []).append(place)
            edge = by_root[root]
            places = [(x, y) for a, b in zip(edge["a"], edge["b"]) for x in at.get(a, ()) for y in at.get(b, ())]
            places += [(x, y) for same in at.values() for x in same for y in same if x < y]  # sets of one short name
            if places:
                values = [np.frombuffer(s, dtype=np.uint64) for s in one["shingles"]]
                links += pair_links(one["set"].tolist(), values, np.array(places), num, den)
        return pd.DataFrame(links, columns=["a", "b"], dtype=object)

    links = sized.groupBy("task").cogroup(edges.groupBy("its_task")).applyInPandas(compare, "a binary, b binary")
    if not heavy:
        return links
    large = groups.join(weights.where(F.col("weight") > most).select("root"), "root", "left_semi").select("node", "root")
    return links.unionByName(exact_links(sets, members, large, num, den, most))


def exact_links(sets: DataFrame, members: DataFrame, clusters: DataFrame, num: int, den: int, most: int = 1_500_000) -> DataFrame:
    """(a, b): links of exact similarity that span every linked component of each cluster.

    ``clusters`` is (node, root) of candidate clusters, and a node may be in several; ``members`` has
    node, set and n_shingles, ``sets`` is from :func:`wanted_sets`. Small clusters share tasks. A cluster of more than ``most`` shingles is cut into blocks: its sets are
    first compared with one pivot; then blocks of those that did not link with it meet all blocks,
    pair by pair, while those that did are one component already.
    """
    known = clusters.join(
        members.select("node", "set", "n_shingles").distinct(), "node"
    ).select("root", "set", "n_shingles")
    weights = written(known.groupBy("root").agg(
        F.sum("n_shingles").alias("weight"), F.min("set").alias("pivot"), F.count(F.lit(1)).alias("n")
    ).where("n > 1"), "weights")
    total, heavy = weights.agg(F.sum("weight"), F.sum((F.col("weight") > most).cast("long"))).first()
    tasks = max(8, int(total or 0) // most)
    shape = "a binary, b binary"

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, one in frame.groupby("root", sort=False):
            one = one.drop_duplicates("set")
            if len(one) > 1:
                values = [np.frombuffer(s, dtype=np.uint64) for s in one["shingles"]]
                links += cluster_links(one["set"].tolist(), values, num, den)
        return pd.DataFrame(links, columns=["a", "b"], dtype=object)

    sized = sets.join(known.join(weights, "root"), "set")
    small = sized.where(F.col("weight") <= most).withColumn("task", F.pmod(F.xxhash64("root"), F.lit(tasks)))
    links = small.select("task", "root", "set", "shingles").groupBy("task").applyInPandas(whole, shape)
    if not heavy:
        return links

    large = written(
        sized.where(F.col("weight") > most).withColumnRenamed("n_shingles", "size").dropDuplicates(["root", "set"]), "large"
    )
    pivots = large.where(F.col("set") == F.col("pivot")).select("root", F.col("shingles").alias("pivot_shingles"))

    @F.pandas_udf("boolean")
    def linked(one: pd.Series, other: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(one, other):
            x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(den * common >= num * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    judged = written(
        large.join(pivots, "root").withColumn("hit", linked("shingles", "pivot_shingles")).drop("pivot_shingles"), "judged"
    )
    stars = judged.where("hit").where("set != pivot").select(F.col("pivot").alias("a"), F.col("set").alias("b"))
    blocks = judged.groupBy("root", "hit").agg(F.ceil(2 * F.sum("size") / most).cast("long").alias("blocks"))
    by_kind = blocks.groupBy("root").agg(
        F.coalesce(F.max(F.when(~F.col("hit"), F.col("blocks"))), F.lit(0)).alias("rest"),
        F.coalesce(F.max(F.when(F.col("hit"), F.col("blocks"))), F.lit(0)).alias("hits"),
    )
    dealt = judged.join(by_kind, "root").withColumn("block", F.when(
        F.col("hit"), F.col("rest") + F.pmod(F.xxhash64("set"), F.col("hits"))
    ).otherwise(F.pmod(F.xxhash64("set"), F.col("rest"))))
    until = F.when(F.col("hit"), F.col("rest")).otherwise(F.col("rest") + F.col("hits"))
    spread = dealt.where("rest > 0").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), until - 1))).select(
        "root", "set", "shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        values = [np.frombuffer(s, dtype=np.uint64) for s in frame["shingles"]]
        sides = (frame["block"] == frame["i"]).to_numpy() if frame["i"].iloc[0] != frame["j"].iloc[0] else None
        links = cluster_links(frame["set"].tolist(), values, num, den, sides) if len(values) > 1 else []
        return pd.DataFrame(links, columns=["a", "b"], dtype=object)

    return links.unionByName(stars).unionByName(spread.groupBy("root", "i", "j").applyInPandas(pair, shape))


def ngram_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, similarity: tuple[int, int] = (3, 4)
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id.

    Words are runs of other characters than white space, A-Z in lower case. A document's set holds
    its distinct n-word shingles, or its whole word sequence if that is shorter. Two documents link
    when their sets' Jaccard similarity is at least num/den; component_id is the smallest key
    reachable by links. Candidates come from PartEnum signatures, which miss no link, and are compared
    by exact counts: pair by pair, and around pivots where one signature has many sets. Sets are compared by
    64-bit hashes of their shingles, and equal sets by a 128-bit digest.

    A null text and one without words has 0 shingles and its own key. Rows with a null or repeated
    key are documents of their own; a null key is no smallest key. An empty table stays empty.

    Candidates are read and compared in rounds, group by group. After a step the driver gives up what it
    holds of it, and tables that no later step reads are deleted.
    """
    num, den = similarity
    spark, passing = docs.sparkSession, []
    members, hot = document_sets(docs, key, text, n)
    shingles = members.agg(F.sum("n_shingles")).first()[0] or 0
    rounds = min(_ROUNDS, 1 + int(shingles) // _ROUND)
    pairs = written(candidate_links(docs, text, n, (num, den), hot, int(shingles)), "candidates", passing)
    drop_written(spark, [])
    plain, stars = pairs.where("not star").select("a", "b"), pairs.where("star").select("a", "b")
    groups = written(components(plain, passing), "groups", passing)
    # A star stands for all pairs of its sets: those are compared around pivots, star by star.
    starred = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    starred = starred.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    spent: list[str] = []

    def compared(r: int) -> DataFrame:
        mine, own = (g.where(F.pmod(F.xxhash64(F.lit("round"), "root"), F.lit(rounds)) == r) for g in (groups, starred))
        named = mine.select("node").unionByName(own.select("node")).distinct()
        hashes = members.join(named, "node", "left_semi").groupBy("set").agg(F.min("th").alias("th")).select("th")
        sets = written(wanted_sets(docs, text, n, hashes), "wanted", spent)
        drop_written(spark, [])
        return paired_links(sets, members, plain, mine, num, den, spent).unionByName(
            exact_links(sets, members, own, num, den)
        )

    drop_written(spark, [])
    links = written_in_rounds((compared(r) for r in range(rounds)), "set-links", passing, spent)
    roots = written(components(links, passing).withColumnRenamed("node", "set"), "roots")
    drop_written(spark, passing)
    known = members.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    firsts = known.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("first"))
    return known.join(firsts, "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id")
    )

