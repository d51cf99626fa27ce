"""Samples joined to their ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_truth(samples: DataFrame, truth: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples with their truth. Both sides are unique on the key, so nothing is hot;
    the join strategy is left to the sizes adaptive execution measures."""
    return samples.join(truth, key)


def without_truth(samples: DataFrame, truth: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples whose truth is missing."""
    return samples.join(truth.select(key), key, "left_anti")
