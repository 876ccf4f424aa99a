"""Merge a result table with a batch of updates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], add: Sequence[str] = (),
           replace: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Full outer merge on ``keys`` (one row per key on each side; a null key equals a null key).

    ``add`` columns are summed, ``replace`` columns take the update where there is one, ``keep``
    columns are written once and then left alone.
    """
    keys = list(keys)
    t = target.select(*[F.col(k).alias(f"_t_{k}") for k in keys], *[F.col(c).alias(f"_t_{c}") for c in (*add, *replace, *keep)], F.lit(True).alias("_t"))
    u = updates.select(*[F.col(k).alias(f"_u_{k}") for k in keys], *[F.col(c).alias(f"_u_{c}") for c in (*add, *replace, *keep)], F.lit(True).alias("_u"))
    same = reduce(and_, [F.col(f"_t_{k}").eqNullSafe(F.col(f"_u_{k}")) for k in keys])
    both = t.join(u, same, "full_outer")
    out = {k: F.when(F.col("_u").isNotNull(), F.col(f"_u_{k}")).otherwise(F.col(f"_t_{k}")) for k in keys}
    out |= {c: (F.coalesce(F.col(f"_t_{c}"), F.lit(0)) + F.coalesce(F.col(f"_u_{c}"), F.lit(0))) for c in add}
    out |= {c: F.when(F.col("_u").isNotNull(), F.col(f"_u_{c}")).otherwise(F.col(f"_t_{c}")) for c in replace}
    out |= {c: F.when(F.col("_t").isNotNull(), F.col(f"_t_{c}")).otherwise(F.col(f"_u_{c}")) for c in keep}
    types = {f.name: f.dataType for f in target.schema.fields}
    return both.select(*[
        out[c].cast(types[c]).alias(c) for c in target.columns])
