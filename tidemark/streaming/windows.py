"""Event-time windows over streams, and alert rules on them. The same code runs on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numbers import number


def stream_kpis(
    events: DataFrame,
    time: str,
    value: str,
    dimension: str,
    window: str = "1 hour",
    slide: str | None = None,
    lateness: str = "10 minutes",
) -> DataFrame:
    """(window_start, window_end, dimension, events, total, mean) per event-time window.

    On a stream in append mode a window comes out once the watermark passes its end, and rows
    later than ``lateness`` are dropped. A table gives all windows.
    """
    rows = events.select(
        F.col(time).cast("timestamp").alias("at"),
        F.col(f"`{dimension}`").alias(dimension),
        number(events, value).alias("v"),
    )
    span = F.window("at", window, slide) if slide else F.window("at", window)
    grouped = rows.withWatermark("at", lateness).groupBy(span.alias("w"), dimension)
    return grouped.agg(
        F.count(F.lit(1)).alias("events"),
        F.round(F.sum("v"), 2).alias("total"),
        F.round(F.round(F.sum("v"), 6) / F.count("v"), 4).alias("mean"),
    ).select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        dimension,
        "events",
        "total",
        "mean",
    )


def stream_rule_alerts(windows: DataFrame, rules: DataFrame) -> DataFrame:
    """Windows that break a rule: the window columns with rule_id, severity, observed, threshold.

    Rules are ``(rule_id, metric, condition, threshold, severity)`` where the metric is ``events``,
    ``total`` or ``mean`` and the condition ``gt`` or ``lt``; others never fire. A window is taken
    apart into its metrics, which meet the rules on them by name, so any number of rules will do.
    The join is stream-static.
    """
    metrics = ("events", "total", "mean")
    kept = [c for c in windows.columns if c not in metrics]
    cells = F.array(*[F.struct(F.lit(m).alias("_metric"), F.col(m).cast("double").alias("observed")) for m in metrics])
    observed = windows.select(*kept, F.inline(cells))
    named = rules.select("rule_id", F.col("metric").alias("_of"), "condition", "threshold", "severity")
    above, below = F.col("observed") > F.col("threshold"), F.col("observed") < F.col("threshold")
    fires = F.when(F.col("condition") == "gt", above).when(F.col("condition") == "lt", below)
    return observed.join(named, F.col("_metric") == F.col("_of")).where(fires).select(
        *kept, "rule_id", "severity", "observed", "threshold"
    )


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all input there is, then return all rows that it has written to ``folder``.

    ``folder`` holds the rows and the progress: a further call with the same folder goes on where
    the last one stopped, also after a crash, with the windows that were still open then. Rows are
    written once, as the sink's log counts only finished batches. In append mode windows stay
    open, and out of the result, until the watermark passes them.
    """
    folder = folder.rstrip("/")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
