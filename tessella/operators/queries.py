"""Edits of query texts and prompts; draws are hashes of the query id, so retries agree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessella.operators.datasets import uniform


def with_affixes(text: Column, prefix: str | None, suffix: str | None, only: list[str] | None = None) -> Column:
    """Prefix and suffix, for the listed texts only when a list is given; 'geometric' stays."""
    out = F.concat(F.lit(prefix or ""), text, F.lit(suffix or ""))
    skip = text == "geometric"
    if only is not None:
        skip = skip | ~F.lower(F.trim(text)).isin([t.lower().strip() for t in only])
    return F.when(skip, text).otherwise(out)


def overwritten(text: Column, new: str, probability: float, seed: str, *key: str) -> Column:
    return F.when(uniform(seed, *key) <= probability, F.lit(new)).otherwise(text)


def as_visual(text: Column, has_box: Column, stage: Column, has_objects: Column, probability: float, seed: str, *key: str) -> Column:
    """Turn first-stage text queries with objects into visual ones."""
    return F.when(~has_box & (stage == 0) & has_objects & (uniform(seed, *key) <= probability), "visual").otherwise(text)


def without_box(box: Column) -> Column:
    return F.lit(None).cast("array<double>")
