"""Join helpers for wide tables.

Joins carry no hints: Spark broadcasts a side only after checking its size, otherwise it sort-merges
and the adaptive planner splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def left_join_all(base: DataFrame, *steps: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Chain of left joins; keys appear once in the result."""
    for side, keys in steps:
        base = base.join(side, list(keys), "left")
    return base


def inner_join_all(base: DataFrame, *steps: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    for side, keys in steps:
        base = base.join(side, list(keys), "inner")
    return base
