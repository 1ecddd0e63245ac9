"""Live request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.operators.logs import metrics_by_module
from tessella.sources.annotations import log_entries


def windowed_metrics(lines: DataFrame, window: str = "1 day", late: str = "1 hour", col: str = "value") -> DataFrame:
    """Metrics per event-time window and module from a stream (or a table) of log lines."""
    entries = log_entries(lines, col)
    if lines.isStreaming:
        entries = entries.withWatermark("timestamp", late)
    m = metrics_by_module(entries, F.window("timestamp", window).alias("w"))
    return m.withColumn("window_start", F.col("w.start")).drop("w")


def run_to_folder(result: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Process what is there and stop; every trigger replaces the result table at ``path``."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(replace).start()
    q.awaitTermination()
