"""Mixing to target weights: soft domain membership, and document rates by least squares."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import free_name, written

WORD = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6)
#: Domains of the labels table with the weights that keep what is good and not toxic.
CLEAN_WEIGHTS = {"clean": 1.0, "toxic": 0.0, "poor": 0.0}


def label_domains(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, domain): toxic before poor (quality 0) before clean; rows with nulls are left aside."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean")
    return labels.where(f"`{key}` is not null and quality is not null and toxic is not null").select(
        F.col(f"`{key}`").alias("doc_id"), domain.alias("domain")
    )


def _parts(words: set[str]) -> tuple[set[str], set[str]]:
    """The runs of letters in words in lower case, and the marks that end words.

    A mark ends a word that does not end in a letter or digit: up to three characters, from the first but a-z on.
    """
    letters = set(filter(str.isalpha, words))
    others = words - letters
    ends = {word[-3:].lstrip("abcdefghijklmnopqrstuvwxyz") for word in others if not word[-1].isalnum()}
    return letters.union(WORD.findall(" ".join(others))), ends


def features(text: str | None) -> set[str]:
    """Of all words of a text: their letters in lower case, the first 4 to 6 where there are more, and the marks at their ends."""
    parts, marks = _parts(set((text or "").lower().split()))
    starts = [{part[:size] + "*" for part in parts if len(part) > size} for size in STARTS]
    return parts.union(*starts, {"*" + mark for mark in marks})


def _features_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted(features(t)))


class Classifier:
    """Softmax regression on the presence of chosen features; posteriors for one text at a time."""

    def __init__(self, domains: list[str], names: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = domains, weights, bias
        at = {name: i for i, name in enumerate(names)}
        self.whole = {name: i for name, i in at.items() if "*" not in name}
        self.marks = {name[1:]: i for name, i in at.items() if name[0] == "*"}
        starts = {name[:-1]: i for name, i in at.items() if name not in self.whole and name[0] != "*"}
        self.starts = {size: {s: i for s, i in starts.items() if len(s) == size} for size in STARTS}
        self.leads = {s[: STARTS[0]] for s in starts}

    def posteriors(self, words: list[str]) -> np.ndarray:
        """Of a text, from its words in lower case; only the chosen features are looked up."""
        parts, marks = _parts(set(words))
        at = {self.whole[part] for part in parts & self.whole.keys()}
        at.update([self.marks[mark] for mark in marks & self.marks.keys()])
        leads, least = self.leads, STARTS[0]
        led = [part for part in parts if part[:least] in leads]
        for size, chosen in self.starts.items():
            at.update([chosen[part[:size]] for part in led if len(part) > size and part[:size] in chosen])
        scores = self.bias + self.weights[sorted(at)].sum(axis=0)
        scores = np.exp(scores - scores.max())
        return scores / scores.sum()


def train(
    docs: DataFrame, domains: DataFrame, names: list[str], key: str = "doc_id", text: str = "text",
    most_labelled: int = 12_000, most_features: int = 1500, steps: int = 200, ridge: float = 3e-4, least_gain: float = 8.0,
) -> Classifier:
    """A classifier from a bounded sample: the ``most_labelled`` labelled documents of least hash.

    Features are counted per domain over the sample. Those that tell a domain from the rest by a
    log-likelihood ratio of ``least_gain`` or more, the best ``most_features`` at most, are weighted
    by full-batch gradient steps on the driver, whose memory the two bounds limit. Rows of rare
    domains weigh more. Without labelled documents every text belongs to all domains alike.
    """
    chosen = (
        domains.where(F.col("domain").isin(names)).groupBy("doc_id").agg(F.max("domain").alias("domain"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most_labelled)
    )
    found = F.pandas_udf(_features_of, "array<string>")
    sample = written(
        docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_text"))
        .join(F.broadcast(chosen), "doc_id")  # ``most_labelled`` rows at most; the texts stay where they are
        .select("domain", found("_text").alias("found")),
        "sample",
    )
    totals = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    rows = sum(totals.values())
    bias = np.zeros(len(names))
    if not rows:
        return Classifier(names, [], np.zeros((0, len(names))), bias)

    counts = sample.select("domain", F.explode("found").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("domain") == d).cast("long")).alias(d) for d in names]
    ).where("n >= 5")
    apart = []
    for d in names:
        share = totals.get(d, 0) / rows
        if 0 < share < 1:
            inside, outside = F.col(d), F.col("n") - F.col(d)
            gain = F.when(inside > 0, inside * F.log(inside / (F.col("n") * share))).otherwise(0.0) + F.when(
                outside > 0, outside * F.log(outside / (F.col("n") * (1 - share)))).otherwise(0.0)
            apart.append(gain)
    if not apart:
        bias = np.array([0.0 if totals.get(d) else -50.0 for d in names])
        return Classifier(names, [], np.zeros((0, len(names))), bias)
    score = F.greatest(*apart) if len(apart) > 1 else apart[0]
    best = counts.withColumn("score", score).where(F.col("score") >= least_gain).orderBy(F.col("score").desc(), "feature").limit(most_features)
    chosen_names = [r["feature"] for r in best.select("feature").collect()]
    index = {name: i for i, name in enumerate(chosen_names)}
    wanted = sample.select("domain", F.array_intersect(
        "found", F.split(F.lit("\x01".join(chosen_names)), "\x01")
    ).alias("found")).collect()

    x = np.zeros((len(wanted), len(index)), dtype=np.float32)
    y = np.zeros((len(wanted), len(names)), dtype=np.float32)
    for i, r in enumerate(wanted):
        x[i, [index[f] for f in r["found"]]] = 1
        y[i, names.index(r["domain"])] = 1
    weight = y @ np.array([np.sqrt(rows / max(1, totals.get(d, 0))) for d in names], dtype=np.float32)
    weight /= weight.sum()
    theta, speed = np.zeros((len(index), len(names))), np.zeros((len(index), len(names)))
    shift = np.log(np.array([max(totals.get(d, 0), 1e-6) for d in names]) / rows)
    bias_speed = np.zeros(len(names))
    rate = 4 / max(1.0, float((weight @ (x * x).sum(axis=1))))
    for _ in range(steps):
        scores = x @ (theta + 0.9 * speed).astype(np.float32) + shift
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = ((p - y) * weight[:, None]).astype(np.float32)
        speed = 0.9 * speed - rate * (x.T @ error + ridge * theta)
        bias_speed = 0.9 * bias_speed - rate * error.sum(axis=0)
        theta, shift = theta + speed, shift + bias_speed
    return Classifier(names, chosen_names, theta, shift)


def with_posteriors(
    docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text", into: str = "posteriors",
    tokens: str = "n_tokens",
) -> DataFrame:
    """``docs`` with the posteriors of each whole text and its number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<p:array<double>,n:long>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        posteriors, counts = [], []
        for text in texts:
            words = (text or "").lower().split()
            posteriors.append(shared.value.posteriors(words))
            counts.append(len(words))
        return pd.DataFrame({"p": posteriors, "n": counts})

    name = free_name(docs, "judged")
    return docs.withColumn(name, judge(F.col(f"`{text}`").cast("string"))).withColumns(
        {into: F.col(name)["p"], tokens: F.col(name)["n"]}
    ).drop(name)


def fit_rates(
    judged: DataFrame, targets: list[float], most: float | None = None, steps: int = 12, close: float = 1e-4
) -> list[list[float]]:
    """Steps that bring the expected domain tokens of ``judged`` (p, n) to ``targets``.

    The squares of expected total less target are lowered over rates of at least 0 (at most
    ``most``), from a rate of 1 on. A step moves a document's rate by its posteriors times one number
    per domain, and clips it, so the rate of a document follows from the list of steps alone and no
    iteration writes a table. The numbers are those of a Newton step: they solve for the
    differences over the documents that the bounds leave free to move, so a rare domain reaches its
    target as fast as a common one. A step that does not lower the squares is damped, which turns it
    towards the gradient.

    It ends when every total is within ``close`` of all tokens of its target, when no step lowers
    the squares by a thousandth any more (targets that no rates reach), or after ``steps`` steps of
    two aggregations each, or some more where one is damped.
    """
    k = len(targets)
    p, aims = F.col("p"), np.array(targets)
    tokens = float(judged.agg(F.sum("n")).first()[0] or 0)
    if not tokens:
        return []

    def totals(taken: list[list[float]]) -> np.ndarray:
        rated = judged.withColumn("r", rate_of(taken, k, most))
        sums = rated.agg(*[F.sum(F.col("r") * F.col("n") * p[i]) for i in range(k)]).first()
        return np.array([float(v or 0) for v in sums]) - aims

    taken: list[list[float]] = []
    off = totals(taken)
    for _ in range(steps):
        if np.abs(off).max() <= close * tokens:
            break
        rated = judged.withColumn("r", rate_of(taken, k, most))
        pull = sum((p[i] * float(off[i]) for i in range(k)), F.lit(0.0))
        free = ((F.col("r") > 0) | (pull < 0)) & (F.lit(most is None) | (F.col("r") < F.lit(float(most or 0))) | (pull > 0))
        sums = rated.where(free).agg(*[F.sum(F.col("n") * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
        spread = np.array([float(v or 0) for v in sums]).reshape(k, k)
        for damping in (1e-9, 1e-3, 1e-2, 1e-1, 1.0):
            step = np.linalg.solve(spread + damping * max(spread.trace(), 1e-9 * tokens) * np.eye(k), off)
            after = totals([*taken, step.tolist()])
            if after @ after < 0.999 * (off @ off):
                break
        else:
            break
        taken.append(step.tolist())
        off = after
    return taken


def rate_of(taken: list[list[float]], domains: int, most: float | None):
    """The rate of a row with posteriors ``p`` after the steps ``taken``."""
    if not taken:
        return F.lit(1.0)
    steps = F.from_json(F.lit(str(taken)), "array<array<double>>")

    def move(rate, step):
        total = F.lit(0.0)
        for i in range(domains):
            total = total + step[i] * F.col("p")[i]
        moved = F.greatest(F.lit(0.0), rate - total)
        return moved if most is None else F.least(F.lit(float(most)), moved)

    return F.aggregate(steps, F.lit(1.0), move)


def mix(
    docs: DataFrame, domains: DataFrame, weights: dict[str, float], tokens: float | None = None,
    most: float | None = None, key: str = "doc_id", text: str = "text", seed: str = "mix", **training,
) -> DataFrame:
    """``docs`` with n_tokens, p_<domain>, rate and copies: how often each document is to be used.

    ``domains`` (doc_id, domain) labels some documents; a classifier trained on a bounded sample of
    them gives every document its posteriors. Rates of 0 to ``most`` bring the expected tokens of
    each domain to ``weights`` of ``tokens`` in all. Without ``tokens``, that is the most that the
    domains can give without repeating a document: the least of a domain's expected tokens over
    its weight. A rate's whole part is the sure number of copies, its fraction the chance of one
    more, drawn by a hash of the key and the text; from 0.95 on a fraction counts as 1.

    Null and empty texts have no tokens; their rate only follows from the prior. Rows with null or
    repeated keys are judged one by one and all rows return, also those with 0 copies. Columns of
    the new names are replaced. An empty table stays empty.
    """
    names = list(weights)
    model = train(docs, domains, names, key, text, **training)
    dropped = [c for c in docs.columns if c in {"n_tokens", "rate", "copies", "posteriors", *[f"p_{d}" for d in names]}]
    judged = written(with_posteriors(docs.drop(*dropped), model, key, text), "posteriors")
    small = judged.select(F.col("posteriors").alias("p"), F.col("n_tokens").alias("n"))
    held = small.agg(*[F.sum(F.col("n") * F.col("p")[i]) for i in range(len(names))]).first()
    if tokens is None:
        tokens = min((float(h or 0) / weights[d] for d, h in zip(names, held) if weights[d] > 0), default=0.0)
    total = sum(weights.values()) or 1.0
    taken = fit_rates(small, [tokens * weights[d] / total for d in names], most)
    p = free_name(judged, "p")
    rated = judged.withColumn(p, F.col("posteriors"))
    rate = rate_of(taken, len(names), most)
    if p == "p":
        rated = rated.withColumn("rate", rate)
    else:
        rated = rated.withColumnRenamed("p", "_kept_p").withColumnRenamed(p, "p").withColumn("rate", rate)
        rated = rated.drop("p").withColumnRenamed("_kept_p", "p")
    chance = F.pmod(
        F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")), F.lit(1 << 30)
    ) / float(1 << 30)
    fraction = F.col("rate") - F.floor("rate")
    rated = rated.withColumn(
        "copies", (F.floor("rate") + F.when((fraction >= 0.95) | (fraction > chance), 1).otherwise(0)).cast("long")
    ).withColumns({f"p_{d}": F.col("posteriors")[i] for i, d in enumerate(names)})
    return rated.drop("posteriors", *(["p"] if p == "p" else []))
