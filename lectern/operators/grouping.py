"""Counts, rates, band lists and top-n per group.

Every operator aggregates map-side before it shuffles, so a group that holds a large part of
the rows costs one small partial row per task instead of one large task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import scalars as S
from lectern.session import materialize


def count_by(df: DataFrame, key: str, by: Sequence[str] = ("dn", "dt"), counted: str = "uid",
             name: str = "num") -> DataFrame:
    """Rows with a non-null ``counted`` per key; a null key is a group of its own."""
    return df.groupBy(key, *by).agg(F.count(counted).alias(name))


def count_by_each(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ("dn", "dt"), counted: str = "uid",
                  name: str = "num") -> DataFrame:
    """The counts of :func:`count_by` for several keys in one scan and one shuffle.

    One row per ``(dim, key)``: ``dim`` names the key column, ``key`` holds its value as text.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(k).alias("dim"), F.col(k).cast("string").alias("key")) for k in keys]))
    return (df.select(*by, counted, pairs.alias("_p"))
            .select(*by, counted, "_p.dim", "_p.key")
            .groupBy("dim", "key", *by).agg(F.count(counted).alias(name)))


def sum_by_each(df: DataFrame, keys: Sequence[str], measure: str, name: str = "total") -> DataFrame:
    """``sum(measure)`` for several keys at once, rows as in :func:`count_by_each`."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(k).alias("dim"), F.col(k).cast("string").alias("key")) for k in keys]))
    return (df.select(measure, pairs.alias("_p")).select(measure, "_p.dim", "_p.key")
            .groupBy("dim", "key").agg(F.sum(measure).alias(name)))


def rate_by(df: DataFrame, keys: Sequence[str], part: Column, other: Column, names: tuple[str, str, str],
            inner_only: bool = False, scale: int = 2) -> DataFrame:
    """Two conditional counts per group and ``part / (part + other)`` in one pass.

    ``inner_only`` keeps only groups in which both counts occur. Groups with neither are left out.
    """
    part_name, other_name, rate_name = names
    out = (df.where(part | other).groupBy(*keys)
           .agg(F.count_if(part).alias(part_name), F.count_if(other).alias(other_name)))
    if inner_only:
        out = out.where((F.col(part_name) > 0) & (F.col(other_name) > 0))
    return out.withColumn(rate_name, S.rate(F.col(part_name), F.col(other_name), scale))


def top_n(df: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int = 3,
          rank: str = "rownum") -> DataFrame:
    """First ``n`` rows per group by ``order``, which must end in a tie-break.

    The rank filter becomes a map-side group limit, so at most ``n`` rows per group and task
    are shuffled.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_n_ties(df: DataFrame, partition: Sequence[str], value: str, n: int = 3, ascending: bool = False,
               rank: str = "rk") -> DataFrame:
    """All rows whose ``value`` is among the ``n`` best distinct values of the group (dense rank).

    Three steps, none of which sends a group's rows to one task:

    * ranks of the distinct values per group, which partial aggregation has made few;
    * each task keeps only rows among the best values of its own part of a group, a superset of the
      answer however rows are spread, so just those rows are shuffled;
    * a join of the two on group and value, which the adaptive planner can split.

    A null value ranks first ascending and last descending, as in a plain window.
    """
    order = F.col(value).asc_nulls_first() if ascending else F.col(value).desc_nulls_last()
    ranks = top_n(df.select(*partition, value).distinct(), partition, [order], n, rank)
    ranks = ranks.select(*[F.col(c).alias(f"_{c}") for c in (*partition, value)], rank)
    local = Window.partitionBy(*partition, "_task").orderBy(order)
    likely = (df.withColumn("_task", F.spark_partition_id()).withColumn("_local", F.dense_rank().over(local))
              .where(F.col("_local") <= n).drop("_task", "_local"))
    condition = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*partition, value)])
    return likely.join(ranks, condition, "inner").drop(*[f"_{c}" for c in (*partition, value)])


def among_best(df: DataFrame, partition: Sequence[str], value: str, n: int = 3, ascending: bool = False) -> DataFrame:
    """The rows that :func:`top_n_ties` ranks, as a stored table; for a ``df`` that is itself the result of joins.

    The best values are found in a pass over groups and values alone and stored. The rows are then cut by a semi join, which the
    planner moves below the joins of ``df``, so that only rows that qualify go through these with all their columns.
    """
    order = F.col(value).asc_nulls_first() if ascending else F.col(value).desc_nulls_last()
    best = top_n(df.select(*partition, value).distinct(), partition, [order], n).drop("rownum")
    best = materialize(best.select(*[F.col(c).alias(f"_{c}") for c in best.columns]), "best-values")
    condition = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*partition, value)])
    return materialize(df.join(best, condition, "left_semi"), "best-rows")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``, then by every other column, so the choice is stable."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    columns = [F.col(c).asc_nulls_last() for c in (*order, *rest)]
    return top_n(df, keys, columns, 1, "_first").drop("_first")


def ids_in_parts(df: DataFrame, keys: Sequence[str], member: str, name: str, distinct: bool = True,
                 part_width: int = 10_000, copy_width: int = 8) -> DataFrame:
    """Comma-joined sorted ids per group, split so that no row grows with the data.

    A group's ids go to numbered parts by ``id div part_width``: a part holds at most
    ``part_width`` distinct ids. With ``distinct=False`` an id appears as often as it occurs, at most
    ``copy_width`` times per row; further copies go to rows with a higher ``copy`` number. All parts of
    a group together are its whole list.
    """
    part = F.call_function("div", F.col(member).cast("bigint"), F.lit(part_width).cast("bigint")).alias("part")
    if distinct:
        lists = df.select(*keys, member, part).groupBy(*keys, "part").agg(
            F.sort_array(F.collect_set(member)).alias("_ids"))  # equal ids meet within tasks first
        return lists.select(*keys, "part",
                            F.array_join(F.transform("_ids", lambda i: i.cast("string")), ",").alias(name))
    grouped = df.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("_n"))
    width = F.lit(copy_width).cast("bigint")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("_n") - 1, width)))
    spread = grouped.select(*keys, member, part, "_n", copies.alias("copy")).withColumn(
        "_k", F.least(width, F.col("_n") - F.col("copy") * width).cast("int"))
    lists = spread.groupBy(*keys, "part", "copy").agg(
        F.sort_array(F.collect_list(F.struct(member, "_k"))).alias("_ids"))
    repeated = F.flatten(F.transform("_ids", lambda i: F.array_repeat(i[member].cast("string"), i["_k"])))
    return lists.select(*keys, "part", "copy", F.array_join(repeated, ",").alias(name))


def top_overall(df: DataFrame, order: Iterable[Column], n: int = 3) -> DataFrame:
    """The ``n`` best rows of a small result (a report limit, planned as take-ordered)."""
    return df.orderBy(*order).limit(n)
