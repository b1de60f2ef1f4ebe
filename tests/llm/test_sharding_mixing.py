"""Shards: sizes, slots and cut groups; mixing: planted domains, targets and odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import __spark_entry__ as entry
import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import mixing, sharding


def check(out, texts, shards):
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r.slot)
    sizes = [len(by_shard[s]) for s in range(shards)]
    assert set(by_shard) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert Counter((r.size, r.text_crc32) for r in out) == Counter(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts
    )


def test_query_keeps_groups_together(spark, folder):
    out = entry.queries()["op3_sharding"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    check(out, texts.values(), 16)
    groups = defaultdict(list)
    for r in out:
        groups[texts[r.doc_id]].append(r.shard)
    linked = [g for g in groups.values() if len(g) > 1]
    assert sum(len(set(g)) == 1 for g in linked) >= 0.9 * len(linked)


def test_a_group_larger_than_a_shard(spark):
    rows = [(i, "hot") for i in range(150)] + [(i, f"pair{i // 2}") for i in range(150, 210)]
    rows += [(i, f"single{i}") for i in range(210, 400)] + [(None, None), (1, ""), (1, ""), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x"))
    out = sharding.shard_documents(frame, 4).collect()
    check(out, [t for _, t in rows], 4)
    hot = Counter(r.shard for r in out if r.text_crc32 == zlib.crc32(b"hot"))
    assert sorted(hot.values())[-1] >= 90  # a shard of 101 all but filled
    assert sharding.shard_documents(frame.limit(0), 4).count() == 0


def test_rates_reach_their_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 400)
    rows = [([float(x) for x in q], int(n)) for q, n in zip(p, rng.integers(10, 500, 400))]
    frame = spark.createDataFrame(rows, "p array<double>, n long")
    targets = [20000.0, 30000.0, 10000.0]
    taken = mixing.fit_rates(frame, targets, steps=200)
    got = frame.withColumn("r", mixing.rate_of(taken, 3, None)).agg(
        *[F.sum(F.col("r") * F.col("n") * F.col("p")[i]) for i in range(3)], F.min("r")).first()
    assert np.allclose(got[:3], targets, rtol=0.01) and got[3] >= 0
    assert mixing.fit_rates(frame.limit(0), targets) == []


def by_gradient(p, n, targets, most, steps=60_000):
    """Rates by many plain projected gradient steps."""
    a = (p * n[:, None]).T
    rate, length = np.ones(len(n)), 1 / np.linalg.eigvalsh(a @ a.T).max()
    for _ in range(steps):
        rate = np.clip(rate - length * (a.T @ (a @ rate - targets)), 0, most or np.inf)
    return a @ rate


@pytest.mark.parametrize("share, leak, most", [(0.01, 0.0, 1.0), (0.01, 0.02, 1.0), (0.005, 0.1, 1.0), (0.02, 0.02, None), (0.3, 0.05, 1.0)])
def test_rates_of_a_rare_domain_against_a_plain_solver(spark, share, leak, most):
    rng = np.random.default_rng(8)
    rare = rng.random(3000) < share
    sure = np.where(rare, 1 - leak * rng.random(3000), leak * rng.random(3000))
    p, n = np.column_stack([1 - sure, sure]), rng.integers(20, 400, 3000).astype(float)
    held = (p * n[:, None]).sum(0)
    targets = np.array([held[0] * 0.95, 0.0 if most else 3 * held[1]])
    frame = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(p, n)], "p array<double>, n long")
    taken = mixing.fit_rates(frame, targets.tolist(), most)
    rates = np.array([r.r for r in frame.select(mixing.rate_of(taken, 2, most).alias("r")).collect()])
    off, plain = (p * n[:, None] * rates[:, None]).sum(0) - targets, by_gradient(p, n, targets, most) - targets
    assert off @ off <= plain @ plain * 1.1 + (1e-3 * n.sum()) ** 2
    if most and leak <= 0.02:
        assert rates[rare].max() < 0.1 and rates[~rare].mean() > 0.9


def documents(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        text = list(rng.choice(words, 80))
        domain = ["clean", "clean", "toxic", "poor"][i % 4]
        if domain == "toxic":
            text[10:13] = ["nastyword", "vilething", "nastyword"]
        if domain == "poor":
            text = [w + "%%%" for w in text]
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(domain != "poor"), int(domain == "toxic")))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int"))


def test_chosen_features_are_found_as_word_by_word():
    letters, low = re.compile(r"[^\W\d_]+"), "abcdefghijklmnopqrstuvwxyz"

    def of_word(word):
        parts = letters.findall(word)
        found = {*parts, *[p[:k] + "*" for p in parts for k in (4, 5, 6) if len(p) > k]}
        return found if word[-1].isalnum() else found | {"*" + word[-3:].lstrip(low)}

    texts = ["Abcd abcde abcdef, ABCDEFGH! x\u00b2y \u00b2 don't a_b _ 12ab34 ab* * $$* \u00c9t\u00e9s!!!", "", None, "a\x1cb.\x85c d\u0130bcdefg."]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("aabbccdE \u00e9\u00df.,%_*7 "), 300)) for _ in range(40)]
    every = [set().union(*map(of_word, set((t or "").lower().split()))) for t in texts]
    assert [mixing.features(t) for t in texts] == every
    names = sorted(set().union(*every))[::3]
    model = mixing.Classifier(["a", "b"], names, rng.normal(size=(len(names), 2)), np.zeros(2))
    for text, found in zip(texts, every):
        scores = model.weights[[i for i, name in enumerate(names) if name in found]].sum(axis=0)
        words = (text or "").lower().split()
        assert np.allclose(model.posteriors(words), np.exp(scores) / np.exp(scores).sum())
    assert not any(len(held) > len(names) for held in vars(model).values() if isinstance(held, (dict, set)))  # it keeps no words


def test_mixing_leaves_out_what_has_no_weight(spark):
    docs, labels = documents(spark)
    out = mixing.mix(docs, mixing.label_domains(labels), mixing.CLEAN_WEIGHTS, most=1.0).collect()
    assert len(out) == 900
    for r in out:
        assert r.copies == (1 if r.doc_id % 4 < 2 else 0), (r.doc_id, r.rate)


def test_mixing_repeats_what_has_more_weight(spark):
    docs, labels = documents(spark)
    weights = {"clean": 0.2, "toxic": 0.5, "poor": 0.3}
    out = mixing.mix(docs, mixing.label_domains(labels), weights, tokens=60_000).collect()
    total = Counter()
    for r in out:
        total[["clean", "clean", "toxic", "poor"][r.doc_id % 4]] += r.copies * r.n_tokens
    for domain, weight in weights.items():
        assert abs(total[domain] - 60_000 * weight) < 3000, total


def test_mixing_of_odd_rows(spark):
    _, labels = documents(spark)
    rows = [(1, None, 5), (1, "", 5), (None, "w x", 5), (2, "w " * 9, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, p long")
    domains = mixing.label_domains(labels)
    out = mixing.mix(frame, domains, mixing.CLEAN_WEIGHTS)
    assert out.count() == 4 and "p" in out.columns
    assert mixing.mix(frame, domains.limit(0), mixing.CLEAN_WEIGHTS).count() == 4
    assert mixing.mix(frame.limit(0), domains, mixing.CLEAN_WEIGHTS).count() == 0
