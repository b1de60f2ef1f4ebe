"""Records of delimited text whose quoted values hold line breaks, read in splits.

A split cannot know whether its first line lies inside a quote. So each split says where it would
end up from either state; these small functions are composed file by file, and then every split
starts in its true state. Records that lie in one split are put together there, the few that cross
a border are joined from their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Splits that start inside a quote, sent along with the tasks; beyond, lines are shuffled by split.
_FEW_SPLITS = 50_000


def quote_open(line: bytes, sep: bytes, inside: bool) -> bool:
    """Whether a quote is open after a line. Quotes open at the start of a value, and are doubled inside."""
    if b'"' not in line:
        return inside
    at = 0
    if not inside and line.startswith(b'"'):
        inside, at = True, 1
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == b'"':
                at += 2
                continue
            inside, at = False, at + 1
        at = line.find(sep + b'"', at)
        if at < 0:
            return False
        inside, at = True, at + len(sep) + 1


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )


def _open_splits(lines: DataFrame, sep: bytes) -> DataFrame:
    """(path, block) of the splits that start inside a quote."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, after = None, (False, True)

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"path": split[0], "block": split[1], "closed": after[0], "open": after[1]}])

        for batch in batches:
            for path, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, block) != split:
                    if split:
                        yield ended()
                    split, after = (path, block), (False, True)
                if b'"' in line:
                    after = tuple(quote_open(line, sep, state) for state in after)
        if split:
            yield ended()

    ends = lines.mapInArrow(scan, "path string, block long, closed boolean, open boolean")
    # One row per split meets its file here, never the lines.
    files = ends.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "closed", "open"))).alias("splits"))
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<long>").alias("found"))
    walked = F.aggregate("splits", start, lambda so_far, split: F.struct(
        F.when(so_far["inside"], split["open"]).otherwise(split["closed"]).alias("inside"),
        F.when(so_far["inside"], F.concat(so_far["found"], F.array(split["block"]))).otherwise(so_far["found"]).alias("found"),
    ))
    return files.select("path", F.explode(walked["found"]).alias("block"))


def quoted_records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(path, first, record): the records of all files as bytes, ``first`` for the first of a file.

    Blank lines between records are left out. A quote that is never closed runs to the end of its file.
    """
    mark = sep.encode()
    lines = _lines(spark, path)
    inside = _open_splits(lines, mark).withColumn("inside", F.lit(True)).withColumnsRenamed({"path": "_p", "block": "_b"})
    same = (F.col("path") == F.col("_p")) & (F.col("block") == F.col("_b"))
    if inside.limit(_FEW_SPLITS + 1).count() <= _FEW_SPLITS:
        marked = lines.join(F.broadcast(inside), same, "left")  # lines keep their order
    else:
        numbered = lines.withColumn("_at", F.monotonically_increasing_id()).join(inside.hint("merge"), same, "left")
        marked = numbered.repartition("path", "block").sortWithinPartitions("path", "block", "_at")
    marked = marked.select("path", "block", "line", F.coalesce("inside", F.lit(False)).alias("inside"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, held, begun, first, rows = None, False, [], True, False, []

        def ended() -> None:
            if split and held:
                rows.append((*split, first and begun, 2 if begun else 1, b"\n".join(held)))

        for batch in batches:
            for path, block, line, starts_inside in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, block) != split:
                    ended()
                    split, inside, held, begun, first = (path, block), starts_inside, [], not starts_inside, block == 0
                if not inside and not line.strip():
                    continue
                held.append(line)
                inside = quote_open(line, mark, inside)
                if not inside:
                    rows.append((path, block, first and begun, 3 if begun else 0, b"\n".join(held)))
                    first, held, begun = first and not begun, [], True
            yield _batch(rows)
            rows = []
        ended()
        yield _batch(rows)

    # Kinds: 0 ends a record begun in an earlier split, 1 is inside one, 2 begins one, 3 is whole.
    parts = marked.mapInArrow(assemble, "path string, block long, first boolean, kind int, record binary")
    whole = parts.where("kind = 3").select("path", "first", "record")
    in_file = Window.partitionBy("path").orderBy("block", "kind")  # two rows a split at most
    torn = parts.where("kind < 3").withColumn("chain", F.sum((F.col("kind") == 2).cast("int")).over(in_file))
    chains = torn.groupBy("path", "chain").agg(
        F.max("first").alias("first"),
        F.array_sort(F.collect_list(F.struct("block", "kind", F.hex("record").alias("record")))).alias("parts"),
    )
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: p["record"]), "0A"))
    return whole.unionAll(chains.select("path", "first", joined.alias("record")))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("path", pa.string()), ("block", pa.int64()), ("first", pa.bool_()), ("kind", pa.int32()), ("record", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])
