"""Value -> range lookup (an IP number to the region whose address range holds it)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

BUCKET_BITS = 16


def _cut_to_buckets(ranges: DataFrame, lo: str, hi: str, bits: int) -> DataFrame:
    """One row per range and bucket of ``2**bits`` values it touches."""
    buckets = F.sequence(F.shiftright(F.col(lo), bits), F.shiftright(F.col(hi), bits))
    return ranges.where(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(buckets))


def range_lookup(values: DataFrame, value: str, ranges: DataFrame, lo: str, hi: str, payload: Sequence[str],
                 bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Left lookup of distinct ``value`` rows in disjoint ranges; ``payload`` is null outside all ranges.

    Values and range starts are merged into one ordering per bucket and each value takes the last start
    before it: the work is a sort, with no candidate pairs and nothing broadcast. Pass distinct values (see
    :func:`count_by_range`): a bucket then holds at most ``2**bucket_bits`` of them.
    """
    info = F.struct(F.col(hi).alias("_hi"), *[F.col(p) for p in payload])
    starts = _cut_to_buckets(ranges.select(lo, hi, *payload), lo, hi, bucket_bits).select(
        "_bucket", F.greatest(F.col(lo), F.shiftleft(F.col("_bucket"), bucket_bits)).alias("_at"),
        F.lit(0).alias("_side"), info.alias("_range"), F.lit(None).cast(values_struct(values)).alias("_row"))
    rows = values.select(
        F.shiftright(F.col(value), bucket_bits).alias("_bucket"), F.col(value).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(starts.schema["_range"].dataType).alias("_range"), F.struct(*values.columns).alias("_row"))
    w = Window.partitionBy("_bucket").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_range", ignorenulls=True).over(w)
    found = rows.unionByName(starts).withColumn("_hit", last).where(F.col("_side") == 1)
    inside = F.col("_at") <= F.col("_hit._hi")
    return found.select("_row.*", *[F.when(inside, F.col(f"_hit.{p}")).alias(p) for p in payload])


def values_struct(values: DataFrame):
    return values.select(F.struct(*values.columns).alias("s")).schema["s"].dataType


def count_by_range(rows: DataFrame, value: str, ranges: DataFrame, lo: str, hi: str, payload: Sequence[str],
                   name: str = "num", bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Row counts per ``payload``; rows in no range (or without a value) count under null.

    Rows are first counted per distinct value, so a value that makes up much of the data reaches the
    lookup as one row.
    """
    distinct = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    looked = range_lookup(distinct, value, ranges, lo, hi, payload, bucket_bits)
    return looked.groupBy(*payload).agg(F.sum("_n").alias(name))
