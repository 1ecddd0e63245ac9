"""Plug points: user models over rows, user metrics over sequences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


def score_rows(df: DataFrame, load: Callable[[], Callable], schema: str) -> DataFrame:
    """Run a user model over Arrow batches: ``load`` builds it once per task, its result maps a batch."""

    def run(batches):
        predict = load()
        for pdf in batches:
            yield predict(pdf)

    return df.mapInPandas(run, schema)


def linear_model() -> Callable:
    """The smallest possible model, as an example of a loader."""
    return lambda pdf: pdf.assign(model_score=pdf.x1 * 0.5 + pdf.x2)


@dataclass(frozen=True)
class Metric:
    """Per-sequence rows and how they combine; both are plain DataFrame functions."""

    per_sequence: Callable[[DataFrame, str], DataFrame]
    combine: Callable[[DataFrame], DataFrame]


METRICS: dict[str, Metric] = {}


def register(name: str, metric: Metric) -> None:
    METRICS[name] = metric


def evaluate(metric: Metric, rows: DataFrame, seq: str) -> DataFrame:
    """Per-sequence results and, last, the combined one (sequence NULL)."""
    per = metric.per_sequence(rows, seq)
    total = metric.combine(per).withColumn(seq, F.lit(None).cast(per.schema[seq].dataType))
    return per.unionByName(total)


def _counts(rows: DataFrame, seq: str) -> DataFrame:
    from tessella.operators.evalmetrics import sequence_counts

    return sequence_counts(rows, seq)


register("counts", Metric(_counts, lambda per: per.agg(*[F.sum(c).alias(c) for c in ("dets", "ids", "frames")])))
