"""Payment history with validity ranges (slowly changing dimension, type 2).

A version opens on every day with a payment, carries the running total and closes when the next
one opens. Windows run over one row per key and day, never over raw payments, so a key's window is
bounded by the number of days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

OPEN_END = "9999-12-31"


def scd2_history(daily: DataFrame, keys: Sequence[str], start: str, measure: str, end: str = "end_time") -> DataFrame:
    """Versions from one row per key and day: running ``measure`` and the closing day."""
    w = Window.partitionBy(*keys).orderBy(start)
    return (daily
            .withColumn(end, F.coalesce(F.lead(start).over(w), F.lit(OPEN_END)))
            .withColumn(measure, F.sum(measure).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def scd2_daily(history: DataFrame, keys: Sequence[str], start: str, measure: str, end: str = "end_time") -> DataFrame:
    """Inverse of :func:`scd2_history`: the amount each version added."""
    w = Window.partitionBy(*keys).orderBy(start)
    before = F.coalesce(F.lag(measure).over(w), F.lit(0))
    return history.withColumn(measure, F.col(measure) - before).drop(end)


def scd2_apply(history: DataFrame, day_rows: DataFrame, keys: Sequence[str], start: str, measure: str,
               end: str = "end_time", days: Sequence[str] = ()) -> DataFrame:
    """Fold new daily rows into a history.

    ``days`` are replaced as a whole: versions that start on them count as withdrawn unless ``day_rows`` brings
    them again. A row for another day already present replaces that row, a row for an earlier day splits the version
    it falls into (late day). Only keys with a new row or a version on a replaced day are recomputed; all other versions
    pass through. Null key values are values.
    """
    columns = history.columns
    packed = F.struct(*[F.col(k) for k in keys]).alias("_key")
    old = history.withColumn("_key", packed)
    replaced = F.col(start).isin(list(days)) if days else F.lit(False)
    touched_keys = day_rows.select(packed).union(old.where(replaced).select("_key")).distinct()
    marked = old.join(touched_keys.withColumn("_touched", F.lit(True)), "_key", "left")
    untouched = marked.where(F.col("_touched").isNull())
    touched = scd2_daily(marked.where("_touched").select(*columns, "_key"), keys, start, measure, end)
    brought = day_rows.select(packed, F.col(start).alias("_start"))
    kept = touched.where(~replaced).join(
        brought, (touched["_key"] == brought["_key"]) & (F.col(start) == F.col("_start")), "left_anti").drop("_key")
    money_type = history.schema[measure].dataType
    rebuilt = scd2_history(kept.unionByName(day_rows.select(*kept.columns)), keys, start, measure, end)
    return untouched.select(*columns).unionByName(
        rebuilt.withColumn(measure, F.col(measure).cast(money_type)).select(*columns))
