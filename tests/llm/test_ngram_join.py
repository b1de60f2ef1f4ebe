"""The n-gram join against all pairs."""

import random
import re
import tracemalloc
from itertools import combinations

import numpy as np

import __spark_entry__ as entry
from tidemark.llm import ngram_join

UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """[(n_shingles, component)] per row; keys are unique."""
    sets, links = [shingles(t) for _, t in rows], {k: {k} for k, _ in rows}
    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {p for ids in by_shingle.values() for p in combinations(ids, 2)}
    for i, j in pairs:
        if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
            a, b = links[rows[i][0]], links[rows[j][0]]
            if a is not b:
                a |= b
                for k in b:
                    links[k] = a
    return {k: (len(s), min(links[k])) for (k, _), s in zip(rows, sets)}


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame, **options).collect()}
    assert out == brute(rows)


def edited(rng, words, vocabulary, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
    return words


def test_query_against_all_pairs(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = entry.queries()["op5_ngram_jaccard_join"](spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)


def test_near_copies_around_the_threshold(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=70)
    rows, key = [], 0
    for size in (5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 150, 400):
        for _ in range(6):
            base = rng.choices(vocabulary, k=size) + (passage if size in (30, 60) else [])
            for edits in (0, 1, 1, 2, 3, 5, 8, 12):
                rows.append((key, " ".join(edited(rng, base, vocabulary, min(edits, size)))))
                key += 7 if key % 2 else 8
    rng.shuffle(rows)
    check(spark, rows)


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(5)
    bands = ngram_join.Bands(3, 4)
    for hot in (np.zeros(1 << 18, dtype=bool), rng.random(1 << 18) < 0.7):
        for _ in range(1500):
            size = int(rng.integers(3, 160))
            x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            gone = int(rng.integers(0, size // 7 + 1))
            more = int(rng.integers(0, size // 7 + 1))
            y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**63, more).astype(np.uint64)]))
            common = len(np.intersect1d(x, y))
            if common < len(x) + len(y) - common and 4 * common >= 3 * (len(x) + len(y) - common):
                (a, thin_a), (b, thin_b) = (ngram_join.signatures(s, bands, hot) for s in (x, y))
                shared, at, to = np.intersect1d(a, b, return_indices=True)
                scores = 12 // ((shared & np.uint64(3)).astype(int) + 1)
                assert np.where(thin_a[at] | thin_b[to], 12, scores).sum() >= 12


def test_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    base = rng.choices(vocabulary, k=60)
    rows = [(i, " ".join(edited(rng, base, vocabulary, rng.randint(1, 4)))) for i in range(150)]
    exact = ngram_join.exact_links
    monkeypatch.setattr(ngram_join, "exact_links", lambda *a: exact(*a, most=600))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, "a b c"), (2, "A  b\tc"), (3, "a b"), (4, ""), (5, None), (6, " \n"), (7, "x " * 3000), (8, "x " * 9),
            (9, "É b c d e"), (10, "é b c d e")]
    check(spark, rows)
    repeated = [(1, "a b"), (1, "a b"), (1, "c d"), (None, "a b"), (None, "e f"), (None, None)]
    frame = spark.createDataFrame(repeated, "doc_id long, text string")
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_components(frame).collect())
    assert out == [("1", 1, "1")] * 3 + [("None", 0, "None"), ("None", 1, "1"), ("None", 1, "None")]
    assert ngram_join.ngram_components(frame.limit(0)).count() == 0


def test_a_bucket_of_single_signatures_takes_little_memory():
    # 400,000 signatures of one set each, and 3 that two sets share: 75 bytes for each were held at once before, 18 now.
    rng = np.random.default_rng(7)
    sign = rng.integers(0, 2**62, 400_000).astype(np.uint64) * np.uint64(4)
    node = rng.integers(-(2**62), 2**62, 400_000) * 2
    sign, node = np.append(sign, sign[:3]), np.append(node, [2, 2, 2])
    node[:3] = 4
    tracemalloc.start()
    out = ngram_join._scored_pairs(sign, node)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.values.tolist() == [[4, 2, False, 36]]
    assert peak < 40 * len(sign)


def test_blocks_are_handed_over_by_their_signatures(monkeypatch):
    # One batch of many texts, as Arrow hands them over, was collected whole before.
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=60)).encode() for _ in range(300)]
    hot = np.zeros(1 << 18, dtype=bool)

    def signed(held):
        monkeypatch.setattr(ngram_join, "_HELD", held)
        blocks = [[(s, v) for s, v in zip(b["signs"].to_pylist(), b["nodes"].to_pylist())]
                  for b in ngram_join._blocks(iter(texts), 5, ngram_join.Bands(3, 4), hot, 8)]
        return [sum(len(s) for s, _ in b) // 8 for b in blocks], sorted(
            pair for b in blocks for s, v in b for pair in zip(np.frombuffer(s, np.uint64).tolist(), np.frombuffer(v, np.int64).tolist())
        )

    (whole, all_at_once), (sizes, in_blocks) = signed(1 << 40), signed(500)
    assert len(whole) == 1 and in_blocks == all_at_once
    assert len(sizes) > 10 and max(sizes) < 700


def test_what_travels_to_a_bucket_is_told_apart(spark):
    # 16 bytes a signature before.
    sign = np.array([0, 3, (1 << 64) - 1, 0xABCDEF0123456789], dtype=np.uint64)
    sent = ngram_join._sent(sign.tobytes())
    assert len(sent) == 5 * len(sign)
    assert ngram_join._received([sent[:5], sent[5:]]).tolist() == [int(s) % (1 << 40) for s in sign]
    for text in (b"a", b"a b c d e f", b"z " * 50):
        name = ngram_join._node(ngram_join._print(ngram_join.Shingles(5)(text)))
        assert ngram_join._received([ngram_join._sent(np.array([name + 1]).tobytes())]).tolist() == [name + 1]


def test_candidates_are_read_in_rounds(spark, monkeypatch):
    """A round's sets are gone before the next is read; before, all sets lay on the disks at once."""
    rounds, paths, write = [], [], ngram_join.written

    def written(df, purpose, kept=None):
        out = write(df, purpose, kept)
        if purpose == "wanted":
            for path in paths:
                assert not spark._jvm.java.io.File(path).exists()
            paths.extend(p.removeprefix("file:") for p in kept if "/wanted-" in p)
            rounds.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    monkeypatch.setattr(ngram_join, "_ROUND", 1)
    rng, rows = random.Random(4), []
    for i in range(24):
        words = [f"w{i}x{k}" for k in range(60)]
        rows += [(3 * i + k, " ".join(words[: 60 - k])) for k in range(1 + rng.randrange(3))]
    check(spark, rows)
    assert len(rounds) == 3 and min(rounds) > 0 and max(rounds) < sum(rounds)
