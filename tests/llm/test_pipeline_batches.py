"""pipeline: how much text a Python worker gets at a time."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.test_batch_memory import KEY, SMALL, largest


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_hand_over_few_bytes_at_a_time(spark, k):
    spark.conf.unset(KEY)
    _, stage = corpus_pipeline.STAGES[k]
    stage(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert largest(spark) < 5 << 20


def test_a_size_that_a_user_has_set_stays(spark):
    spark.conf.set(KEY, "1m")
    corpus_pipeline.secrets(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert spark.conf.get(KEY) == "1m" and largest(spark) < 2 << 20
    spark.conf.unset(KEY)
