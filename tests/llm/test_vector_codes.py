"""Dual-tree assignment against all distances, and codes against a plain Lloyd iteration."""

import hashlib
import math

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.compare import differences
from tidemark.llm import vector_codes


@pytest.mark.parametrize("points, entries, width, spread", [
    (1, 1, 4, 10), (5, 3, 4, 3), (100, 64, 4, 2), (2000, 64, 4, 300), (3000, 40, 1, 5), (5000, 64, 2, 4), (700, 2, 3, 100),
    (3000, 256, 4, 50), (300, 64, 4, 0),
])
def test_every_point_goes_to_its_nearest_entry(monkeypatch, points, entries, width, spread):
    monkeypatch.setattr(vector_codes, "_PAIRS", 5000)
    rng = np.random.default_rng(points)
    values = rng.integers(-spread, spread + 1, (points, width))
    book = rng.integers(-spread, spread + 1, (entries, width))
    want = ((values[:, None] - book[None]) ** 2).sum(-1).argmin(1)
    tree = vector_codes.build_tree(values, vector_codes._LEAF)
    got = np.full(points, -1)
    sums, counts = np.zeros_like(book), np.zeros(entries, dtype=int)
    for start, end, entry_, total in vector_codes.assign(tree, vector_codes.Codebook(book)):
        for a, b, e in zip(start, end, entry_):
            assert (got[tree.order[a:b]] == -1).all()
            got[tree.order[a:b]] = e
        np.add.at(sums, entry_, total)
        np.add.at(counts, entry_, end - start)
    assert (got == want).all()
    assert (counts == np.bincount(want, minlength=entries)).all()
    assert all((sums[e] == values[want == e].sum(0)).all() for e in range(entries))


def test_whole_nodes_are_assigned_from_cached_sums():
    rng = np.random.default_rng(4)
    centres = rng.integers(-1000, 1000, (64, 4))
    values = centres[rng.integers(0, 64, 8000)] + rng.integers(-3, 4, (8000, 4))
    runs = list(vector_codes.assign(vector_codes.build_tree(values, 16), vector_codes.Codebook(centres)))
    whole = sum(int((end - start)[end - start > 1].sum()) for start, end, _, _ in runs)
    assert whole > 6000


def plain(rows, parts, entries, rounds, scale=256):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    ints = np.array([[math.floor(scale * x) for x in r[1]] for r in rows], dtype=np.int64).reshape(len(rows), parts, -1)
    books = ints[:entries].transpose(1, 0, 2).copy()

    def assigned():
        return [((ints[:, p, None] - books[p][None]) ** 2).sum(-1).argmin(1) for p in range(parts)]

    for _ in range(rounds):
        for p, chosen in enumerate(assigned()):
            for e in set(chosen.tolist()):
                mine = ints[chosen == e, p]
                books[p, e] = [math.floor(int(s) / len(mine)) for s in mine.sum(0)]
    chosen = assigned()
    error = sum(((ints[:, p] - books[p][chosen[p]]) ** 2).sum(-1) for p in range(parts))
    label = {}
    for r, e in zip(rows, error):
        label[r[2]] = label.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    codes = ["".join(f"{c[i]:02x}" for c in chosen) for i in range(len(rows))]
    key = lambda t: (t[0] is None, t)
    return sorted(((r[0], c, int(e), label[r[2]], sha) for r, c, e in zip(rows, codes, error)), key=key)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_on_given_vectors(spark, name):
    folder = f"/root/testdata/{name}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    out = sorted(tuple(r) for r in entry.queries()["op13_vector_codes"](spark, folder).collect())
    assert out == plain([r for r in rows if r[1] is not None], 16, 64, 2)


def test_query_agrees_with_its_sql(spark, db, folder):
    assert differences(spark, db, "op13_vector_codes", folder) == []


SCHEMA = "vec_id long, embedding array<float>, label int, code int, _label string"


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "_BLOCK", 7)
    rng = np.random.default_rng(9)
    good = [(i // 2, [float(np.float32(x)) for x in rng.normal(size=8)], [None, 1, 2][i % 3]) for i in range(60)]
    good += [(None, good[0][1], None), (1, good[3][1], 1), (1, good[3][1], 1)]
    bad = [(-5, None, 1), (-4, [1.0, None] * 4, 1), (-3, [math.nan] * 8, 2), (-2, [math.inf] * 8, None), (-1, [], 1),
           (70, [1.0] * 4, 1), (71, [1.0] * 7, 1)]
    frame = spark.createDataFrame([(*r, 0, "x") for r in good + bad], SCHEMA).repartition(5)
    for entries in (3, 16, 200):
        out = vector_codes.compress_vectors(frame, parts=2, entries=entries)
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, out.collect()), key=lambda t: (t[0] is None, t)) == plain(good, 2, entries, 2)


def test_nothing_and_too_much(spark):
    frame = spark.createDataFrame([(1, [1e12] * 8, 1, 0, "")], SCHEMA)
    assert vector_codes.compress_vectors(frame.limit(0), parts=2).count() == 0
    with pytest.raises(Exception, match="or more"):
        vector_codes.compress_vectors(frame, parts=2).collect()
