"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; extra settings override them.

    Shuffle partition counts are left to the cluster: adaptive execution coalesces them, so the
    configured number is an upper bound sized for the largest job.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode, where driver and tasks share one disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows known when the plan is built, as plan literals rather than a job over a list."""
    names = [part.split()[0] for part in schema.split(",")]
    kinds = [part.split()[1] for part in schema.split(",")]
    records = [
        F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(row, kinds, names)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*records)))
