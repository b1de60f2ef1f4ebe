"""Repeated lines: an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import WHITE_SPACE, drop_written, free_name, lower_ascii, written, written_in_rounds

_CELLS = 1 << 16  # of the count sketch
_FILTER = 1 << 20  # cells of the filters that pick lines and documents before an exact join
_HOT = 10_000  # a line is hot with more than this part of all lines; so there are no more of them
#: Where letters outside A-Z that have a lower case are: in these ranges, with many others.
_OTHER_UPPER = r"[\u00C0-\u00DE\u0100-\u1FFF\u2100-\x{10FFFF}]"
_ROUNDS = 3  # at most, in which prefix tokens meet and pairs are verified; each has its own shuffles
_ROUND = 100_000  # lines from which another round pays
_MOST = 255  # sizes and places from here on are packed as this one, and pass every filter


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, t, at, line): every line of every document with its place.

    A document is named by its key and a hash of its text, so rows that share a key, or lack one,
    are documents of their own unless they are equal.
    """
    whole = F.col(f"`{text}`").cast("string")
    return docs.select(
        F.col(f"`{key}`").alias("doc"), F.xxhash64(whole).alias("t"), F.posexplode(F.split(whole, "\n")).alias("at", "line")
    )


def _place() -> Column:
    """Order of lines: by document, those without a key last, then by line."""
    return F.struct(F.col("doc").isNull().alias("no_key"), F.col("doc").alias("doc"), F.col("t").alias("t"), F.col("at").alias("at"))


def _hashes(line: str = "line") -> list[Column]:
    """Two 64-bit hashes that name a line's text."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit("line"), F.col(line)).alias("g")]


def _words() -> Column:
    """The words of a line, A-Z in lower case.

    ``lower`` does just that to lines without other capitals, and much faster than ``translate``.
    """
    line = F.col("line")
    plain = (F.length(line) == F.octet_length(line)) | ~line.rlike(_OTHER_UPPER)
    line = F.when(plain, F.lower(line)).otherwise(lower_ascii(line))
    spaced = F.when(F.col("line").rlike(r"[\t-\r]"), F.translate(line, WHITE_SPACE, " " * len(WHITE_SPACE))).otherwise(line)
    return F.array_remove(F.split(spaced, " "), "")


def _shingles(n: int, hashed: Callable[..., Column]) -> Column:
    """``hashed`` of the words of each n-word shingle of a line, in their order; a shorter line is one shingle."""

    def hashes(w: Column) -> Column:
        shingles = F.transform(
            F.sequence(F.lit(0), F.size(w) - n), lambda i: hashed(*[F.get(w, i + k) for k in range(n)])
        )
        return F.when(F.size(w) >= n, shingles).otherwise(F.array(hashed(w)))

    # The array around the words names them, so that they are split once and not for each use.
    return F.get(F.transform(F.array(_words()), hashes), F.lit(0))


def _grams(n: int) -> Column:
    """Hashes of the distinct n-word shingles of a line, in order of size."""
    return F.array_distinct(F.sort_array(_shingles(n, F.xxhash64)))


def _with_halves(lines: DataFrame, n: int) -> DataFrame:
    """``lines`` with ``tokens``, half a hash for each distinct shingle: enough to find candidates, which whole hashes verify.

    Shingles that share one stay apart in the array, so sizes are right and common tokens are no
    fewer than common shingles. Where all halves of a line differ, so do its shingles; in other
    lines a second hash beside the half tells which are the same.
    """
    def whole(*words: Column) -> Column:
        second = F.xxhash64(*words).bitwiseAND(F.lit((1 << 32) - 1))
        return F.shiftleft(F.hash(*words).cast("long"), 32).bitwiseOR(second)

    apart = F.transform(F.array_distinct(F.sort_array(_shingles(n, whole))), lambda g: F.shiftright(g, 32).cast("int"))
    every, different = free_name(lines, "every"), free_name(lines, "different")
    found = lines.withColumn(every, F.sort_array(_shingles(n, F.hash))).withColumn(different, F.array_distinct(every))
    same = F.size(every) == F.size(different)
    return found.withColumn("tokens", F.when(same, F.col(every)).otherwise(apart)).drop(every, different)


def _rare_first(tokens: Column, hot_cells: list[int]) -> Column:
    """The tokens with those of hot cells last, and in order of size otherwise."""
    if not hot_cells:
        return tokens

    def ordered(parts: Column) -> Column:
        rare = F.filter(parts["all"], lambda t: ~_cell(t).isin(hot_cells))
        return F.when(F.size(parts["hot"]) == 0, parts["all"]).otherwise(F.concat(rare, parts["hot"]))

    hot = F.filter(tokens, lambda t: _cell(t).isin(hot_cells))
    return F.get(F.transform(F.array(F.struct(tokens.alias("all"), hot.alias("hot"))), ordered), F.lit(0))


def _cell(token: Column | str) -> Column:
    return F.pmod(token, F.lit(_CELLS))


def _common_cells(tokens: DataFrame) -> list[int]:
    """Cells of a fixed-size count sketch, over all lines, that hold far more shingles than others."""
    counts = tokens.select(F.explode("tokens").alias("token")).groupBy(_cell("token").alias("cell")).agg(
        F.count(F.lit(1)).alias("n")
    )
    found = counts.select("cell", "n").collect()
    mean = sum(r["n"] for r in found) / _CELLS
    return sorted(r["cell"] for r in found if r["n"] > mean + 5 * mean**0.5 + 5)


def _needed(a: Column, b: Column, num: int, den: int) -> Column:
    """Common tokens that sets of sizes a and b need for a similarity of num/den."""
    return F.ceil((a + b) * num / (num + den))


def _part(packed: Column | str, shift: int) -> Column:
    return F.shiftright(packed, shift).bitwiseAND(F.lit(255))


def _packed(token: Column, order: Column, size: Column, pos: Column) -> Column:
    """Token, rough order, size and place in one number: shuffled rows are two numbers long."""
    return (
        F.shiftleft(token.cast("long"), 32)
        .bitwiseOR(F.shiftleft(order.cast("long"), 16))
        .bitwiseOR(F.shiftleft(F.least(size, F.lit(_MOST)).cast("long"), 8))
        .bitwiseOR(F.least(pos, F.lit(_MOST)).cast("long"))
    )


def _may_match(one: Column | str, two: Column | str, num: int, den: int) -> Column:
    """Whether sizes and places in the prefix still allow the similarity; packed maxima say nothing."""
    a, b, i, j = _part(one, 8), _part(two, 8), _part(one, 0), _part(two, 0)
    sized = den * F.least(a, b) >= num * F.greatest(a, b)
    rest = F.least(a - i, b - j) + F.least(i, j) >= _needed(a, b, num, den)
    return (F.greatest(a, b, i, j) >= _MOST) | (sized & rest)


def _enough(a: Column, b: Column, shared: Column, num: int, den: int) -> Column:
    """Whether ``shared`` common tokens of two prefixes still allow the similarity of sets of sizes a and b.

    Of the set whose prefix ends first in the order, every common token up to there is in both
    prefixes, and what comes behind it is all that the two can share besides.
    """
    behind = F.greatest(F.ceil(a * num / den), F.ceil(b * num / den)) - 1
    return (F.greatest(a, b) >= _MOST) | (shared + behind >= _needed(a, b, num, den))


def _halves(lines: DataFrame, n: int) -> DataFrame:
    """(h, g, order, tokens): the half hashes of each line, and a rough order of the lines as they are read.

    The order has 16 bits and only chooses which line of a token goes first.
    """
    at = F.monotonically_increasing_id()
    order = F.shiftright(at, 33) % 1024 * 64 + F.least(F.shiftright(at % (1 << 33), 14), F.lit(63))
    return _with_halves(lines.select("h", "g", order.alias("order"), "line"), n).select("h", "g", "order", "tokens")


def _heads(halves: DataFrame, hot_cells: list[int], num: int, den: int) -> DataFrame:
    """(a, h): a row for each prefix token of each line, ``a`` as :func:`_packed`."""
    ordered = halves.select("h", "order", F.size("tokens").alias("size"), _rare_first(F.col("tokens"), hot_cells).alias("tokens"))
    prefix = F.col("size") - F.ceil(F.col("size") * num / den).cast("int") + 1
    heads = ordered.select("h", "order", "size", F.posexplode(F.slice("tokens", F.lit(1), prefix)).alias("pos", "token"))
    return heads.select(_packed(F.col("token"), F.col("order"), F.col("size"), F.col("pos")).alias("a"), "h")


def _shared(heads: DataFrame) -> DataFrame:
    """(token, a, h, times, first_a, first): rows of tokens that two lines share, with the first line of the token.

    ``times`` says how many of the line's shingles have that token. A token of one line ends here,
    and it is what most tokens are.
    """
    by_token = Window.partitionBy("token")
    marked = heads.repartition(F.shiftright("a", 32)).withColumn("token", F.shiftright("a", 32)).select(
        "token", "a", "h", F.min(F.struct("a", "h")).over(by_token).alias("least"),
        (F.min("h").over(by_token) < F.max("h").over(by_token)).alias("two"),
    )
    rows = marked.where("two").groupBy("token", "h").agg(
        F.min("a").alias("a"), F.count(F.lit(1)).alias("times"), F.min("least").alias("least")
    )
    return rows.select("token", "a", "h", "times", F.col("least.a").alias("first_a"), F.col("least.h").alias("first"))


def _candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (one, two) of rows (one, two, a, b, times) for common tokens: pairs that share enough of their prefixes.

    Lines of 255 shingles and more pass; of equal halves in one line no more count than both hold.
    """
    possible = rows.where(_may_match("a", "b", num, den))
    pairs = possible.groupBy("one", "two").agg(
        F.sum("times").alias("times"), F.max(_part("a", 8)).alias("a"), F.max(_part("b", 8)).alias("b")
    )
    return pairs.where(_enough(F.col("a"), F.col("b"), F.col("times"), num, den)).select("one", "two")


def later_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, similarity: tuple[int, int] = (3, 4),
    paths: list[str] | None = None,
) -> DataFrame:
    """(doc, t, at, h): lines, and the hash of their text, that equal or resemble an earlier line.

    Lines come in order of document and line. A line's tokens are its distinct n-word shingles, A-Z
    in lower case, or its whole sequence of words if it has fewer; lines without words are left
    alone. Two lines match when the Jaccard similarity of their tokens is at least num/den. Tokens
    are ordered by rarity (a count sketch over all lines tells common ones), and lines that share
    tokens of their prefixes are candidates if their sizes, the tokens' places and the number of
    those tokens still allow the similarity; candidates are verified on all tokens.

    Candidates come in two rounds: first each line against one early line of each of its tokens,
    which settles most near copies of one line, then what is left against all lines that share a
    token. A line needs one earlier match to go, so a group of near copies is hardly ever compared
    all against all. Lines of equal text are one candidate; of lines of which the cluster has very
    many copies only the first takes part: at most 10,000 of those, which bounds what is broadcast.

    A step's tables are deleted when the next one is written; those that the result reads are added
    to ``paths``, for the caller to delete with :func:`drop_written` once the result is written.
    """
    num, den = similarity
    spark, read, halved, tokens, passing = docs.sparkSession, [] if paths is None else paths, [], [], []
    named = _lines(docs, key, text).where(F.col("line").rlike(r"[^ \t-\r]")).select("doc", "t", "at", "line", *_hashes())
    classes = written(
        named.groupBy("h", "g").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("copies")), "lines", read,
    )
    total = classes.agg(F.sum("copies")).first()[0] or 0
    hot = classes.where(F.col("copies") > max(2, total // _HOT)).select("h", "g", F.col("first").alias("only"))
    once = named.join(F.broadcast(hot), ["h", "g"], "left").where(F.col("only").isNull() | (F.col("only") == _place()))

    drop_written(spark, [])
    halves = written(_halves(once, n), "line-halves", halved)
    heads = _heads(halves, _common_cells(halves), num, den)
    rounds = min(_ROUNDS, 1 + total // _ROUND)
    in_round = F.pmod(F.shiftright("a", 32), F.lit(rounds))
    shared = written_in_rounds((_shared(heads.where(in_round == r)) for r in range(rounds)), "line-tokens", tokens)
    star = written(_candidates(shared.where(F.col("h") != F.col("first")).select(
        F.col("first").alias("one"), F.col("h").alias("two"), F.col("first_a").alias("a"), F.col("a").alias("b"), "times"
    ), num, den), "line-pairs", passing)
    drop_written(spark, [])
    near = _near(star, halves, num, den, rounds, passing)
    sets = written(_sets(once, classes, near, n), "line-sets", passing)
    gone = written(_later_of(near, sets, num, den), "line-gone", read)
    stay = sets.join(gone, ["h", "g"], "left_anti").select("h")
    settled = written(gone.select("h").distinct().join(stay, "h", "left_anti"), "line-settled", tokens)
    drop_written(spark, passing)

    # Each pair with an open line meets once per token, from its open line or the one with the smaller hash.
    rows = shared.join(settled.withColumn("settled", F.lit(True)), "h", "left").select(
        "token", "a", "h", "times", F.col("settled").isNull().alias("open")
    )
    other = rows.toDF("token", "b", "other", "other_times", "other_open")
    met = rows.where("open").join(other, "token").where(
        (F.col("h") != F.col("other")) & (~F.col("other_open") | (F.col("h") < F.col("other")))
    ).select(F.col("h").alias("one"), F.col("other").alias("two"), "a", "b", F.least("times", "other_times").alias("times"))
    rest = written(_candidates(met, num, den), "line-pairs", passing)
    drop_written(spark, tokens)
    passing += halved
    near = _near(rest, halves, num, den, rounds, passing)
    sets = written(_sets(once, classes, near, n), "line-sets", passing)
    gone = written(gone.unionByName(_later_of(near, sets, num, den)).distinct(), "line-gone", read)
    drop_written(spark, passing)
    gone = gone.withColumn("gone", F.lit(True))

    affected = classes.join(gone, ["h", "g"], "left").where((F.col("copies") > 1) | F.col("gone")).select(
        "h", "g", "first", F.coalesce("gone", F.lit(False)).alias("gone")
    )
    return named.select("doc", "t", "at", "h", "g").join(affected, ["h", "g"]).where(
        F.col("gone") | (F.col("first") != _place())
    ).select("doc", "t", "at", "h")


def _picked(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``lines`` whose hash is in ``wanted`` (h), and a few others: a filter of fixed size before an exact join."""
    filled = wanted.select(F.pmod("h", F.lit(2 * _FILTER)).alias("cell")).distinct()
    return lines.withColumn("cell", F.pmod("h", F.lit(2 * _FILTER))).join(F.broadcast(filled), "cell", "left_semi")


def _sets(lines: DataFrame, classes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(h, g, first, tokens): whole hashes of all shingles of the lines of pairs (one, two)."""
    wanted = pairs.select(F.explode(F.array("one", "two")).alias("h")).distinct()
    firsts = classes.join(wanted, "h", "left_semi").select("h", "g", "first")
    texts = _picked(lines, wanted).groupBy("h", "g").agg(F.first("line").alias("line"))
    return texts.join(firsts, ["h", "g"]).select("h", "g", "first", _grams(n).alias("tokens"))


def _both(pairs: DataFrame, sets: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs (one, two) with the columns of ``sets`` for their first line and those of ``other`` for their second."""
    one = sets.select(*[F.col(c).alias(f"{c}_one") for c in sets.columns])
    two = other.select(*[F.col(c).alias(f"{c}_two") for c in other.columns])
    return pairs.join(one, F.col("one") == F.col("h_one")).join(two, F.col("two") == F.col("h_two"))


def _alike(common: Column, num: int, den: int) -> Column:
    return den * common >= num * (F.size("tokens_one") + F.size("tokens_two") - common)


def _near(pairs: DataFrame, halves: DataFrame, num: int, den: int, rounds: int, paths: list[str]) -> DataFrame:
    """(one, two): pairs that the first 16 bits of their half hashes allow.

    Common cut hashes, and as many more as a line holds twice, are no fewer than common shingles; the
    lines' hashes of :func:`_halves` have them, so no text is read for pairs that fall short. Pairs are
    compared in rounds by their first line. ``paths`` has the tables that nothing reads after it; they
    are deleted, and it then names the result.
    """
    spark = pairs.sparkSession
    lines = pairs.select(F.explode(F.array("one", "two")).alias("h")).distinct()
    cut = F.transform("tokens", lambda t: F.shiftright(t, 16).cast("short"))
    slim = _picked(halves, lines).groupBy("h", "g").agg(F.first(cut).alias("tokens")).join(lines, "h", "left_semi")
    cuts = written(slim.select(
        "h", "tokens", (F.size("tokens") - F.size(F.array_distinct("tokens"))).alias("twice")
    ), "line-cuts", paths)
    drop_written(spark, [])
    common = F.size(F.array_intersect("tokens_one", "tokens_two")) + F.least("twice_one", "twice_two")

    def compared(r: int) -> DataFrame:
        some, own = (df.where(F.pmod(c, F.lit(rounds)) == r) for df, c in ((pairs, "one"), (cuts, "h")))
        return _both(some, own, cuts).where(_alike(common, num, den)).select("one", "two").distinct()

    found: list[str] = []
    near = written_in_rounds((compared(r) for r in range(rounds)), "line-near", found)
    drop_written(spark, paths)
    paths += found
    return near


def _later_of(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(h, g): the later line of each pair (one, two) whose similarity is enough."""
    later = F.col("first_one") > F.col("first_two")
    common = F.size(F.array_intersect("tokens_one", "tokens_two"))
    return _both(pairs, sets, sets).where(_alike(common, num, den)).select(
        F.when(later, F.col("h_one")).otherwise(F.col("h_two")).alias("h"),
        F.when(later, F.col("g_one")).otherwise(F.col("g_two")).alias("g"),
    ).distinct()


def drop_later_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, similarity: tuple[int, int] = (3, 4),
    removed: str = "n_removed",
) -> DataFrame:
    """``docs`` without the lines of :func:`later_lines`, and how many each has lost in ``removed``.

    A document loses a line when an earlier one, of a document with a smaller key or above in the
    same document, matches it; the earliest of all is never lost. Rows without a key come last.
    Rows of one key, or without one, are ordered by a hash of their texts; only if the texts are
    equal too do they count as one document, and keep the same lines. Null texts stay null; other
    columns and rows stay as they are, and a column ``removed`` is replaced. An empty table stays
    empty.
    """
    paths = []
    lost = later_lines(docs, key, text, n, similarity, paths).groupBy("doc", "t").agg(
        F.collect_set(F.xxhash64("at", "h")).alias("lost")  # lines of one text at most
    )
    docs = docs.drop(removed) if removed in docs.columns else docs
    doc, same, gone, cell = (free_name(docs, name) for name in ("doc", "t", "lost", "cell"))
    lost = written(lost.withColumnsRenamed({"doc": doc, "t": same, "lost": gone}), "lost-lines")
    drop_written(docs.sparkSession, paths)
    # Rows that lose nothing, as a filter of fixed size tells for most of them, are spared the join.
    whole = F.col(f"`{text}`").cast("string")
    marked = docs.withColumn(cell, F.pmod(F.xxhash64(F.col(f"`{key}`"), F.xxhash64(whole)), F.lit(_FILTER)))
    filled = lost.select(F.pmod(F.xxhash64(F.col(doc), F.col(same)), F.lit(_FILTER)).alias("_cell")).distinct()
    hit = marked[cell] == filled["_cell"]
    spared = marked.join(F.broadcast(filled), hit, "left_anti").drop(cell)
    touched = marked.join(F.broadcast(filled), hit, "left_semi").drop(cell)
    joined = touched.join(lost, touched[key].eqNullSafe(lost[doc]) & (F.xxhash64(touched[text].cast("string")) == lost[same]), "left")
    lines = F.split(whole, "\n")
    stays = F.filter(lines, lambda line, i: ~F.array_contains(gone, F.xxhash64(i, F.xxhash64(line))))
    stay = free_name(docs, "stays")
    joined = joined.withColumn(stay, F.when(F.col(gone).isNotNull(), stays))
    kept = F.array_join(stay, "\n")
    cut = joined.select(
        *[F.when(F.col(gone).isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`")
          for c in docs.columns],
        F.coalesce(F.when(F.col(stay).isNotNull(), F.size(lines) - F.size(stay)), F.lit(0)).cast("long").alias(removed),
    )
    return cut.unionAll(spared.withColumn(removed, F.lit(0).cast("long")))
