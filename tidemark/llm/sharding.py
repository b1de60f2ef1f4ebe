"""Shards of equal size: balanced label propagation over groups of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import written
from tidemark.operators.ranks import number_rows
from tidemark.session import literal_rows


def _quotas(wanted: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> dict[tuple[int, int], int]:
    """How many rows may move from shard i to j so that every shard keeps its size.

    Wishes in opposite directions are exchanged; what is left of a wish is exchanged for rows of
    the target shard that have no neighbour anywhere. Returned moves of free rows are under
    (j, i) as negative numbers.
    """
    quota: dict[tuple[int, int], int] = {}
    free = dict(free)
    for i in range(shards):
        for j in range(i + 1, shards):
            both = min(wanted.get((i, j), 0), wanted.get((j, i), 0))
            if both:
                quota[i, j] = quota[j, i] = both
    for (i, j), n in sorted(wanted.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - quota.get((i, j), 0), free.get(j, 0))
        if more > 0:
            quota[i, j] = quota.get((i, j), 0) + more
            free[j] -= more
            quota[j, i, "free"] = more
    return quota


def balance(rows: DataFrame, shards: int, rounds: int = 5) -> DataFrame:
    """``rows`` (row, neighbours) with a shard: neighbours together, counts at most one apart.

    ``row`` numbers the rows from 0; rows with one value of ``neighbours`` are linked with each
    other, rows with a null there with none. Shards start even by row number. In each round every
    linked row wishes for the shard that holds most of its neighbours among those that still can
    take rows; wishes are granted up to quotas that exchange rows one for one, so sizes never
    change. Only the counts of wishes per pair of shards come to the driver. Rows of a group are
    never gathered: groups are counted per shard, and granted rows are found by their rank.
    """
    sizes = rows.where("neighbours is not null").groupBy("neighbours").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    state = written(
        rows.join(sizes, "neighbours", "left").select(
            "row", F.when(F.col("n") > 1, F.col("neighbours")).alias("neighbours"),
            F.pmod("row", F.lit(shards)).cast("int").alias("shard"),
        ),
        "shards",
    )
    for turn in range(rounds):
        counts = state.where("neighbours is not null").groupBy("neighbours", "shard").agg(F.count(F.lit(1)).alias("here"))
        free = {r["shard"]: r["count"] for r in state.where("neighbours is null").groupBy("shard").count().collect()}
        takers = [s for s in range(shards) if turn == 0 or free.get(s)]
        best = counts.where(F.col("shard").isin(takers)).groupBy("neighbours").agg(
            F.max(F.struct("here", (-F.col("shard")).alias("shard"))).alias("best")
        ).select("neighbours", (-F.col("best.shard")).alias("target"), F.col("best.here").alias("gain"))
        better = (F.col("target") != F.col("shard")) & (F.col("gain") >= F.col("here"))
        wishes = written(
            state.join(counts.join(best, "neighbours"), ["neighbours", "shard"], "left")
            .select("row", "neighbours", "shard", F.when(better, F.col("target")).alias("target"), "gain"),
            "wishes",
        )
        wanted = {(r["shard"], r["target"]): r["count"]
                  for r in wishes.where("target is not null").groupBy("shard", "target").count().collect()}
        quota = _quotas(wanted, free, shards)
        if not quota:
            break
        state = written(_granted(wishes, quota, shards), "shards")
    return state.select("row", "neighbours", "shard")


def _granted(wishes: DataFrame, quota: dict, shards: int) -> DataFrame:
    """Shards after the granted moves: the first rows of each kind of wish, and of the free rows."""
    kind = F.when(F.col("target").isNotNull(), F.lit(0)).when(F.col("neighbours").isNull(), F.lit(1)).otherwise(F.lit(2))
    moving = wishes.withColumn("kind", kind).where("kind < 2")
    numbered = number_rows(moving, ["kind", "shard", "target", F.col("gain").desc(), "neighbours", "row"], "place", "total")
    starts = {}
    for r in numbered.groupBy("kind", "shard", "target").agg(F.min("place").alias("start")).collect():
        starts[r["kind"], r["shard"], r["target"]] = r["start"]
    ranges = []
    for (k, i, j), start in starts.items():
        if k == 0 and (i, j) in quota:
            ranges.append((0, i, start, start + quota[i, j], j))
        elif k == 1:
            for to in range(shards):
                if more := quota.get((i, to, "free")):
                    ranges.append((1, i, start, start + more, to))
                    start += more
    table = literal_rows(wishes.sparkSession, ranges, "kind int, shard int, low long, high long, to int")
    moves = numbered.join(F.broadcast(table), ["kind", "shard"]).where("low <= place and place < high").select("row", "to")
    return wishes.join(moves, "row", "left").select(
        "row", "neighbours", F.coalesce("to", "shard").cast("int").alias("shard")
    )


def with_slots(rows: DataFrame, shard: str = "shard", slot: str = "slot", order: str = "row") -> DataFrame:
    """A gapless number from 0 within each shard, by ranks over all tasks."""
    numbered = number_rows(rows, [shard, order], "_place", "_total").drop("_total")
    starts = numbered.groupBy(F.col(shard).alias("_shard")).agg(F.min("_place").alias("_start"))
    return numbered.join(F.broadcast(starts), F.col(shard) == F.col("_shard")).withColumn(
        slot, F.col("_place") - F.col("_start")
    ).drop("_place", "_shard", "_start")


def shard_documents(
    docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", rounds: int = 5
) -> DataFrame:
    """Each document with its size, text_crc32, shard and slot; equal texts meet in a shard.

    Counts of shards are at most one apart (the law ``rows``); a group of equal texts larger than
    a shard fills whole shards as far as exchanges allow. size is the text's UTF-8 bytes plus 1
    (a null text has none, and no neighbours). Texts are compared by SHA-256, so only digests are
    shuffled. Every row is a document, with null or repeated keys too; slots follow the key.
    """
    value = F.col(f"`{text}`").cast("string")
    base = written(docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(value, F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(value, 256)).alias("neighbours"),
    ), "sizes")
    numbered = number_rows(base, ["doc_id", "text_crc32", "neighbours"], "row", "row_total").withColumn(
        "row", F.col("row") - 1
    ).drop("row_total")
    placed = balance(numbered.select("row", "neighbours"), shards, rounds)
    joined = numbered.drop("neighbours").join(placed.select("row", "shard"), "row")
    return with_slots(joined).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
