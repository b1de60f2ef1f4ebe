"""Runs against a search of every period, and planted tails against a plain loop."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from tidemark.llm import periodic_runs


def all_runs(words, least, times):
    """(start, length, period) of every run, by trying each period at each place."""
    size, found = len(words), []
    for period in range(1, size // times + 1):
        start = 0
        while start < size - period:
            end = start
            while end < size - period and words[end] == words[end + period]:
                end += 1
            length = end + period - start
            if end > start and length >= max(least, times * period):
                shorter = any(s <= start and s + n >= start + length and period % q == 0 for s, n, q in found)
                if not shorter:
                    found.append((start, length, period))
            start = max(end, start + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


def words_of(rng, size, letters):
    words = [rng.randrange(letters) for _ in range(size)]
    if size > 4 and rng.random() < 0.6:
        at, period = rng.randrange(size), rng.randint(1, max(1, size // 4))
        words = [words[i] if i < at else words[at + (i - at) % period] for i in range(size)]
    return words


def test_common_prefixes():
    rng = random.Random(2)
    for _ in range(60):
        text = words_of(rng, rng.randint(2, 40), rng.randint(1, 3))
        symbols = [v + 1 for v in text] + [0]
        shared = periodic_runs.CommonPrefixes(symbols)
        suffixes = sorted(range(len(symbols)), key=lambda i: symbols[i:])
        assert np.argsort(shared.rank).tolist() == suffixes
        a, b = (x.ravel() for x in np.meshgrid(range(len(text)), range(len(text))))
        a, b = a[a != b], b[a != b]
        want = [next(k for k in range(len(symbols)) if symbols[i + k] != symbols[j + k]) for i, j in zip(a, b)]
        assert shared(a, b).tolist() == want


@pytest.mark.parametrize("least, times", [(2, 2), (5, 2), (6, 3), (24, 3)])
def test_runs_against_every_period(least, times):
    rng = random.Random(least)
    for _ in range(500):
        words = np.array(words_of(rng, rng.randint(1, 70), rng.randint(1, 4)), dtype=np.int64)
        want = all_runs(words.tolist(), least, times)
        assert [tuple(r) for r in periodic_runs.runs_in(words + 1, least, times).tolist()] == want
        mask = periodic_runs.stretches(words, np.zeros(len(words), dtype=np.int64), least, times)
        assert [tuple(r) for r in periodic_runs._runs_of(words, mask, least, times).tolist()] == want


def test_stretches_do_not_cross_documents():
    words = np.array([1] * 20 + [1] * 30)
    mask = periodic_runs.stretches(words, np.array([0] * 20 + [1] * 30), 24, 3)
    assert mask.tolist() == [False] * 20 + [True] * 30


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def by_hand(words):
    runs = all_runs(words, 24, 3)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_against_every_period(spark, folder):
    out = {r[0]: tuple(r)[1:] for r in entry.queries()["op11_periodic_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(out) == len(docs)
    with_runs = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:  # the plain search takes n squared steps
            continue
        assert out[d.doc_id] == by_hand(words), d.doc_id
        with_runs += out[d.doc_id][0] > 0
    assert with_runs > 5


def test_odd_rows(spark):
    cycle = " ".join(["a", "b", "é"] * 9)
    rows = [(1, None), (1, ""), (None, " \n\t"), (2, cycle), (2, cycle), (3, "x " * 100_000), (4, "a b " * 30)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_runs int")
    out = periodic_runs.find_runs(frame, with_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_runs) for r in out) == [(0, 0), (1, 0), (1, 0), (2, 1), (2, 1), (3, 1), (4, 1)]
    by_key = {r.doc_id: r for r in out}
    assert by_key[1].start is None and by_key[1].exponent_milli is None
    assert by_key[1].runs_sha256 == by_key[1].collapsed_sha256 == digest("")
    assert by_key[2][2:6] == (0, 27, 3, 9000) and by_key[2].collapsed == "a b é"
    assert by_key[3][2:6] == (0, 100_000, 1, 100_000_000) and by_key[3].collapsed == "x"
    assert by_key[2].runs[0].asDict() == {"start": 0, "length": 27, "period": 3}
    assert periodic_runs.find_runs(frame.limit(0)).count() == 0


def test_ties_go_to_the_first_run(spark):
    rows = [(1, " ".join(["a"] * 24 + ["x"] + ["b"] * 24)), (2, " ".join(["a", "b"] * 20 + ["a"] * 24))]
    out = {r.doc_id: r for r in periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1][1:5] == (2, 0, 24, 1)
    # the a that starts the second run belongs to the first one too
    assert out[2].n_runs == 2 and out[2][2:5] == (40, 24, 1)
    assert out[2].collapsed_sha256 == digest("a b")
