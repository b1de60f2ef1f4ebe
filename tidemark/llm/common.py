"""Pieces the corpus operators share: words, shingles, and tables written to the shared folder."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import scratch_path

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, return.
WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, purpose: str, paths: list[str] | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors.

    The path is added to ``paths``, for :func:`drop_written` once nothing reads the table any more.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_in_rounds(
    rounds: Iterable[DataFrame], purpose: str, paths: list[str], spent: list[str] | None = None
) -> DataFrame:
    """The rows of all ``rounds`` as one table of :func:`written`.

    A round's shuffles, and the tables in ``spent``, are deleted before the next round is asked for, so
    no more than one round's share of what is shuffled is on the disks at a time.
    """
    path = None
    for df in rounds:
        if path is None:
            path, spark, schema = scratch_path(df.sparkSession, purpose), df.sparkSession, df.schema
            paths.append(path)
        df.write.mode("append").parquet(path)
        drop_written(spark, [] if spent is None else spent)
    return spark.read.schema(schema).parquet(path)


def drop_written(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of :func:`written` that nothing reads any more, and empty ``paths``.

    What the driver holds of finished queries is collected too: Spark then deletes their shuffles,
    which otherwise stay on the executors' disks until the driver happens to run short of memory.
    Frames that Python has let go are given up by the JVM once a second, hence the wait; those that
    only hold each other, as frames and functions do, wait for Python's own collection first.
    """
    gc.collect()
    time.sleep(1.2)
    jvm = spark.sparkContext._jvm
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def lower_ascii(text: str | Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: str | Column) -> Column:
    """The runs of other characters than white space; an empty array for a null."""
    parts = F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), r"[ \t-\r]+")
    return F.filter(parts, lambda word: word != "")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has that name."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
