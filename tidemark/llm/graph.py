"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import written


def components(links: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the smallest node reachable.

    Each round joins all links with the smallest neighbour of their nodes, writes what is left and
    compares the number and a hash of the links, so the driver sees two numbers a round. The
    number of rounds grows with the logarithm of the longest chain. Links of a node with itself
    and repeated links do not matter; nulls are left out. A hub's links are never gathered: they
    only meet one row, its smallest neighbour. Tables written on the way are added to ``paths``.
    """
    def once(pairs: DataFrame) -> DataFrame:
        return pairs.where("a > b").distinct()

    edges = written(
        once(links.dropna(subset=["a", "b"]).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))),
        "links", paths,
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = once(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        edges = written(
            once(small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
                low.select("a", F.col("low").alias("b"))
            )),
            "links", paths,
        )
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
