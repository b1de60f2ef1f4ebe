"""Quality rules: text statistics, and decision lists learned from labelled rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import LOWER, UPPER, WHITE_SPACE, free_name, words, written

_FILTER = 1 << 20  # cells of the filter that picks rows before an exact join
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test: ratios and sizes made from the counted columns.
TESTED = [
    "n_words", "word_size", "symbol_share", "repeat_share", "dup_line_share", "upper_share",
    "digit_share", "mark_share", "distinct_share", "line_words",
]


def _without(text: str, characters: str) -> Column:
    return F.translate(text, characters, "")


def text_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the counts of each whole text.

    n_words, word_chars (code points in words), n_symbols, n_lines and n_dup_lines (lines with a
    word; those equal to an earlier one), n_repeat_words (words inside 3-word windows that occur
    at least twice), n_distinct, n_upper, n_digits and n_marks. A null text has no words. Windows
    are compared by a 64-bit hash within one text; they are sorted inside the row, so no window
    leaves its row and the time of a text grows with n log n of its words.
    """
    keep = keep or []
    word = F.col("_w")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    rows = rows.withColumn("_w", words("_t"))
    windows = F.when(F.size("_w") < 3, F.array().cast("array<struct<h:bigint,at:int>>")).otherwise(
        F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size("_w") - 3),
            lambda i: F.struct(
                F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)).alias("h"),
                i.alias("at"),
            ),
        ))
    )
    rows = rows.withColumn("_s", windows)
    sorted_windows = F.col("_s")
    repeated = F.sort_array(F.filter(F.transform(
        sorted_windows,
        lambda x, j: F.when(
            (F.get(sorted_windows, j - 1)["h"] == x["h"]) | (F.get(sorted_windows, j + 1)["h"] == x["h"]), x["at"]
        ),
    ), lambda at: at.isNotNull()))
    rows = rows.withColumn("_r", repeated)
    starts = F.col("_r")
    covered = F.aggregate(
        F.transform(starts, lambda at, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - at, F.lit(3)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    lines = F.filter(F.split("_t", "\n"), lambda line: F.length(F.translate(line, WHITE_SPACE, "")) > 0)
    rows = rows.withColumn("_l", lines)
    length = F.length("_t")
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.length(_without("_t", WHITE_SPACE)),
        "n_symbols": length - F.length(_without("_t", SYMBOLS)),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": covered,
        "n_lines": F.size("_l"),
        "n_distinct": F.size(F.array_distinct("_w")),
        "n_upper": length - F.length(_without("_t", UPPER)),
        "n_lower": length - F.length(_without("_t", LOWER)),
        "n_digits": length - F.length(_without("_t", "0123456789")),
        "n_marks": length - F.length(_without("_t", "!?;:")),
    }
    return rows.select(*[F.col(f"`{c}`") for c in keep], *[e.cast("long").alias(n) for n, e in counts.items()])


def tested_columns() -> dict[str, Column]:
    """The columns of ``TESTED`` from those of :func:`text_statistics`; never null."""
    def share(a: str, b: str | Column) -> Column:
        below = F.col(b) if isinstance(b, str) else b
        return F.when(below > 0, F.col(a) / below).otherwise(F.lit(0.0))

    letters = F.col("n_upper") + F.col("n_lower")
    return {
        "word_size": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "upper_share": share("n_upper", letters),
        "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "distinct_share": share("n_distinct", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """``column > cut`` (above) or ``column <= cut``."""

    column: str
    above: bool
    cut: float

    def holds(self) -> Column:
        return F.col(self.column) > F.lit(self.cut) if self.above else F.col(self.column) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.column} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects what all its tests hold for."""

    tests: tuple[Test, ...]

    def holds(self) -> Column:
        held = F.lit(True)
        for test in self.tests:
            held = held & test.holds()
        return held

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def _cuts(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Candidate thresholds: cut points of equal frequency of each class and column."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.groupBy("bad").agg(*[
        F.percentile_approx(c, shares, 10_000).alias(c) for c in TESTED
    ]).collect()
    return {c: sorted({float(v) for r in found for v in r[c] or []}) for c in TESTED}


def _grow(rows: DataFrame, rule: Rule, cuts: dict[str, list[float]]) -> tuple[Test | None, float]:
    """The test whose addition gains most (FOIL), from one aggregation over the grow rows."""
    def bin_of(column: str) -> Column:
        below = F.filter(F.lit(cuts[column]), lambda cut: cut < F.col(column))
        return F.struct(F.lit(column).alias("column"), F.size(below).alias("bin"))

    binned = [bin_of(c) for c in TESTED if cuts[c]]
    if not binned:
        return None, 0.0
    counts: dict[str, dict[int, tuple[int, int]]] = {}
    stats = (
        rows.where("grow").where(rule.holds())
        .select("bad", F.inline(F.array(*binned)))
        .groupBy("column", "bin")
        .agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    )
    for r in stats.collect():
        counts.setdefault(r["column"], {})[r["bin"]] = (r["p"], r["n"] - r["p"])
    best, gain = None, 0.0
    for column, by_bin in sorted(counts.items()):
        all_p = sum(p for p, _ in by_bin.values())
        all_n = sum(n for _, n in by_bin.values())
        if not all_p:
            continue
        before = math.log2(all_p / (all_p + all_n))
        p = n = 0
        for i, cut in enumerate(cuts[column]):
            more = by_bin.get(i, (0, 0))
            p, n = p + more[0], n + more[1]
            for above, a, b in ((False, p, n), (True, all_p - p, all_n - n)):
                if a and (now := a * (math.log2(a / (a + b)) - before)) > gain + 1e-9:
                    best, gain = Test(column, above, cut), now
    return best, gain


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The start of the rule that does best on the prune rows, and what it covers there."""
    sums = []
    for k in range(1, len(rule.tests) + 1):
        held = Rule(rule.tests[:k]).holds()
        sums += [F.sum((held & F.col("bad")).cast("long")), F.sum((held & ~F.col("bad")).cast("long"))]
    counts = [v or 0 for v in rows.where("not grow").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    scored = []
    for k in range(len(rule.tests)):
        p, n = counts[2 * k], counts[2 * k + 1]
        scored.append(((p - n) / (p + n) if p + n else -1.0, p, -k, n))
    _, p, k, n = max(scored)
    return Rule(rule.tests[: 1 - k]), p, n


def learn_rules(
    labelled: DataFrame, precision: float = 0.95, most_rules: int = 12, most_tests: int = 4, bins: int = 32,
    least: int = 5,
) -> list[Rule]:
    """An ordered list of rejecting rules by sequential covering.

    ``labelled`` has the columns of ``TESTED`` and boolean ``bad`` and ``grow``; all its rows
    count. Each rule grows on the grow rows one threshold test at a time, is cut back to the start
    that does best on the others, and is taken while it is right for ``precision`` of at least
    ``least`` of those that it covers; then its rows leave. Only counts per column and threshold
    come to the driver. Rows without bad ones, and empty tables, give no rule.
    """
    cuts = _cuts(labelled, bins)
    rules: list[Rule] = []
    rest = labelled
    while len(rules) < most_rules:
        rule = Rule(())
        while len(rule.tests) < most_tests:
            test, _ = _grow(rest, rule, cuts)
            if test is None:
                break
            rule = Rule(rule.tests + (test,))
        if not rule.tests:
            break
        rule, right, wrong = _prune(rest, rule)
        if right < least or right < precision * (right + wrong):
            break
        rules.append(rule)
        rest = rest.where(~rule.holds())
    return rules


def decision(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.holds(), F.lit(str(rule))).otherwise(out)
    return out


def judge_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None,
    **options,
) -> DataFrame:
    """Each document with its counts, base_failed, the rule that rejects it (or null) and kept.

    ``labels`` has ``key`` and quality (0 bad, 1 good); rows with a null in either are left aside,
    of several labels of a key the least holds. Rules are learned from all labelled documents that
    pass the base test; two thirds of them by a hash of the key grow rules, the rest prune them.
    Without labels only the base test rejects. Every row of ``docs`` gives one row, also with a
    null or repeated key; null and empty texts fail the base test. ``carry`` names the columns to
    keep besides the key (default: none).
    """
    keep = [key, *[c for c in carry or [] if c != key]]
    counted = written(text_statistics(docs, text, keep), "quality").withColumns(tested_columns())
    counted = counted.withColumn("base_failed", base_failed())
    marks = (
        labels.select(F.col(f"`{key}`").alias("_key"), F.col("quality").alias("_quality")).dropna()
        .groupBy("_key").agg((F.min("_quality") == 0).alias("bad"))
    )
    labelled = written(
        counted.where("not base_failed").join(marks, F.col(f"`{key}`") == F.col("_key"))
        .select("bad", *TESTED, (F.pmod(F.xxhash64(F.col("_key").cast("string")), F.lit(3)) > 0).alias("grow")),
        "labelled",
    )
    rules = learn_rules(labelled, **options)
    return counted.withColumn("rule", decision(rules)).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    ).select(*[F.col(f"`{c}`") for c in keep], *BASE, "base_failed", "kept", "rule")


def drop_rejected(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that :func:`judge_quality` keeps, as they are.

    What is judged depends on the text alone, so texts are judged under two 64-bit hashes of theirs and
    no text is written: rows are joined to the hashes of rejected texts, but for those that a filter of
    fixed size spares.
    """
    h, g, cell = (free_name(docs, name) for name in ("text_hash", "text_hash_2", "text_cell"))
    whole = F.col(f"`{text}`").cast("string")
    named = docs.withColumn(h, F.xxhash64(whole)).withColumn(g, F.xxhash64(F.lit("text"), whole))
    judged = judge_quality(named, labels, key, text, carry=[h, g], **options)
    rejected = judged.where("not kept").select(h, g).distinct()
    marked = named.withColumn(cell, F.pmod(h, F.lit(_FILTER)))
    filled = F.broadcast(rejected.select(F.pmod(h, F.lit(_FILTER)).alias(cell)).distinct())
    spared = marked.join(filled, cell, "left_anti")
    touched = marked.join(filled, cell, "left_semi").join(rejected, [h, g], "left_anti")
    return spared.select(docs.columns).unionAll(touched.select(docs.columns))
