"""Helpers of the training-data operators: stored intermediate tables, checked broadcasts, word patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.session import materialize, work_dir

__all__ = ["BROADCAST_ROWS", "LOWER", "UPPER", "WHITE_CHARS", "WHITE_SPACE", "bind", "load", "lower_ascii", "materialize", "small_side", "text_key",
           "white_words", "work_dir"]

# ASCII white space, as a class for patterns and as plain characters.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A stored table of narrow rows (a few numbers each) is broadcast up to this number of rows, about 16 MB.
BROADCAST_ROWS = 400_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which must be a stored table of narrow rows, marked for broadcast only if its counted size allows it.

    Otherwise the join stays a shuffle join, whose skewed keys the adaptive planner splits.
    """
    return F.broadcast(df) if df.count() <= rows else df


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where ``use`` refers to it in a lambda."""
    return F.transform(F.array(value), use)[0]


def white_words(text: Column) -> Column:
    """The words between ASCII white space, as an array; null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_SPACE))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text, as two numbers; null text has a key of its own."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text, F.length(text)).alias("b"))
