"""Conversation history operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def prune(messages: DataFrame, is_tool_call: Column, keep_head: int = 2) -> DataFrame:
    """First turns plus everything from the latest assistant turn that calls the tool.

    The cut point per conversation is a partial aggregate joined back, not a window, so a very
    long conversation is never sorted in one task. Without such a turn only the head stays.
    """
    call = F.when((F.col("role") == "assistant") & (F.col("turn") >= keep_head) & is_tool_call, F.col("turn"))
    cut_at = messages.groupBy("conv_id").agg(F.max(call).alias("_from"))
    return messages.join(cut_at, "conv_id").where((F.col("turn") < keep_head) | (F.col("turn") >= F.col("_from"))).drop("_from")


def count_images(messages: DataFrame) -> DataFrame:
    """Image parts per conversation (``content``: array of parts with a ``type``)."""
    n = F.size(F.filter("content", lambda p: p["type"] == "image"))
    return messages.groupBy("conv_id").agg(F.sum(n).alias("n_images"))
