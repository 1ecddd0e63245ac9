"""Request metrics from JSON-line logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def metrics_by_module(entries: DataFrame, *keys: Column | str) -> DataFrame:
    """Count, success, errors and durations per module; missing fields take their defaults."""
    ok = F.coalesce("status", F.lit("success")) == "success"
    ms = F.coalesce(F.col("duration_ms").try_cast("double"), F.lit(0.0))
    return (
        entries.groupBy(*keys, F.coalesce("module", F.lit("unknown")).alias("module"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(ok.cast("int")).alias("success"), F.sum((~ok).cast("int")).alias("errors"),
            F.min(ms).alias("min_ms"), F.greatest(F.max(ms), F.lit(0.0)).alias("max_ms"), F.sum(ms).alias("total_ms"),
        )
        .withColumn("avg_ms", F.col("total_ms") / F.col("n"))
        .withColumn("success_rate", F.col("success") / F.col("n"))
    )
