"""URL filters: a sort-merge range join of urls with nested prefix rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import lower_ascii, written

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above these


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    text = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    text = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _host_key(labels: Column) -> Column:
    """Labels from the top one down, each closed by a dot, so that a parent is a prefix."""
    return F.concat(F.array_join(labels, "."), F.lit("."))


def _labels(host: str | Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def rule_chains(rules: DataFrame) -> DataFrame:
    """One row per usable rule: its key, its depth in labels, and its chain.

    The key is the reversed host followed by the path. The chain holds the rules whose key is a
    prefix of this key, the rule itself last: the stack that a sweep in key order has when it
    stands at the rule. A chain is no longer than the key it belongs to.
    """
    usable = (
        rules.select(
            lower_ascii(F.coalesce("host", F.lit(""))).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            F.col("verdict").cast("string").alias("verdict"),
        )
        .where((F.col("path") == "") | F.col("path").startswith("/"))
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", F.concat(_host_key(_labels("host")), "path"))
        .withColumn("depth", F.size(_labels("host")))
    )
    entry = F.struct(
        F.length("key").alias("size"), "key", F.concat("host", "path").alias("rule"), "verdict",
        F.length("host").alias("host_size"),
    )
    outer = usable.select(F.col("key").alias("prefix"), entry.alias("entry"))
    inner = usable.select(
        "key",
        "depth",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n)
        )).alias("prefix"),
    )
    return (
        inner.join(outer, "prefix")
        .groupBy("key", "depth")
        .agg(F.sort_array(F.collect_list("entry")).alias("chain"))
    )


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule of every (host, path) of ``urls`` that has one.

    ``rules`` has host, path and verdict. A rule fits its host and all its subdomains when the
    path starts with the rule's path. The longest rule (host and path as written) wins; of equally
    long ones the longer host, then the greater text. Of rules with one host and path the greatest
    verdict holds (``block`` over ``allow``). Rules with a path that does not start with ``/`` fit
    nothing.

    A url takes part once for every host level that some rule has: at that level, a rule is an
    interval of keys, and intervals nest or are disjoint. Keys of rules and urls are sorted
    together over all tasks; the last rule at or before a url carries the stack of active rules,
    from which those that ended before the url are popped by a prefix test. One row per partition
    tells which rule was last before it. Equal keys may be split over tasks.
    """
    chains = rule_chains(rules)
    depths = chains.agg(F.collect_set("depth").alias("depths"))
    probes = (
        urls.select("host", "path")
        .distinct()
        .crossJoin(F.broadcast(depths))
        .withColumn("labels", _labels("host"))
        .withColumn("depth", F.explode(F.filter("depths", lambda d: d <= F.size("labels"))))
        .select(
            F.concat(_host_key(F.slice("labels", 1, F.col("depth"))), "path").alias("key"),
            F.lit(1).alias("kind"),
            F.lit(None).cast(chains.schema["chain"].dataType).alias("chain"),
            "host",
            "path",
        )
    )
    events = chains.select(
        "key", F.lit(0).alias("kind"), "chain", F.lit("").alias("host"), F.lit("").alias("path")
    ).unionByName(probes)
    order = ["key", "kind", "host", "path"]
    swept = written(
        events.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()),
        "urls",
    ).withColumn("part", F.shiftright("at", _ROW_BITS))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        swept.groupBy("part")
        .agg(F.max_by("chain", F.when(F.col("kind") == 0, F.col("at"))).alias("chain"))
        .select("part", F.last("chain", ignorenulls=True).over(before).alias("carried"))
    )
    so_far = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stacked = (
        swept.withColumn("stack", F.last("chain", ignorenulls=True).over(so_far))
        .where("kind = 1")
        .join(F.broadcast(carried), "part")
        .withColumn("stack", F.coalesce("stack", "carried"))
        .withColumn("active", F.filter("stack", lambda r: F.col("key").startswith(r["key"])))
        .where(F.size("active") > 0)
        .withColumn("won", F.element_at("active", -1))
    )
    return stacked.groupBy("host", "path").agg(
        F.max(F.struct(
            F.length("won.rule").alias("size"),
            F.col("won.host_size").alias("host_size"),
            F.col("won.rule").alias("rule"),
            F.col("won.verdict").alias("verdict"),
        )).alias("won")
    ).select("host", "path", F.col("won.rule").alias("rule"), F.col("won.verdict").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict; urls without a rule get ``default``.

    A null url, and one without ``://``, has an empty host and path. Rows are kept as they are,
    repeated ones too; columns of these four names are replaced. Without rules every row gets the
    default. Equal urls are matched once.
    """
    kept = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"} or c == url]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept]).withColumns(
        {"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))}
    )
    return rows.join(match_rules(rows, rules), ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in kept],
        "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
