"""Interval coverage and merging for plays of a video.

Merging is a sweep over slices of :data:`SLICE_WIDTH` positions, one 64-bit number each. An interval sets bits in the slices of its two ends
and opens (+1) and closes (-1) the whole slices between them; bits and openings of a slice are combined before
the shuffle. Running sums of the openings, over the few slices of a key, then tell which slices are covered whole.

New coverage needs the order of plays: the furthest end of all earlier ones is the maximum over earlier slices (one
row per slice) and over earlier rows of the same slice. In both, a key with very many plays spreads over its slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import scalars as S

SLICE_WIDTH = 64


def _slice(start: str, width: int) -> Column:
    return F.floor(F.col(start) / F.lit(width)).cast("bigint")


def _with_reach(df: DataFrame, keys: Sequence[str], start: str, end: str, width: int, name: str) -> DataFrame:
    """Add the furthest ``end`` of all earlier rows of the key, by ``(start, end)``; null for the first.

    There is about a row of ``carry`` per row, but plays parsed from lines are planned for as a few bytes each. So the join is
    a sort-merge join by hint: by its estimate the planner would collect and broadcast all slices.
    """
    sliced = df.withColumn("_slice", _slice(start, width))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (sliced.groupBy(*keys, "_slice").agg(F.max(end).alias("_top"))
             .withColumn("_carry", F.max("_top").over(earlier)).drop("_top"))
    within = Window.partitionBy(*keys, "_slice").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return (sliced.withColumn("_local", F.max(end).over(within))
            .join(carry.hint("merge"), [*keys, "_slice"], "inner")
            .withColumn(name, F.greatest("_carry", "_local")).drop("_carry", "_local"))


def interval_coverage(plays: DataFrame, keys: Sequence[str], start: str = "ps", end: str = "pe",
                      slice_width: int | None = SLICE_WIDTH, known: DataFrame | None = None) -> DataFrame:
    """Add ``new_len`` to distinct intervals: positions no earlier interval of the key has covered.

    ``plays`` holds each ``(key, start, end)`` once. Order is ``(start, end)``. ``known`` has a row per key with the disjoint
    intervals stored for it, as an array ``known`` of ``s``, ``e``; what these cover is not new. Its other columns are
    added to the rows of the key. A ``slice_width`` of None sorts all rows of a key in one task: for parts of a
    stream, whose size is capped, that saves three shuffles.
    """
    if slice_width is None:
        before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
        reached = plays.withColumn("_reach", F.max(end).over(before))
    else:
        reached = _with_reach(plays, keys, start, end, slice_width, "_reach")
    begin = F.least(F.col(end), F.greatest(F.col(start), F.coalesce(F.col("_reach"), F.col(start)))).cast("bigint")
    new = F.col(end).cast("bigint") - begin
    if known is not None:
        reached = reached.join(known, list(keys), "left")
        new = new - known_length(F.col("known"), begin, F.col(end).cast("bigint"))
    return reached.withColumn("new_len", new).drop("_reach", "_slice", "known")


def _ones(count: Column) -> Column:
    """``count`` (1 to 64) low bits."""
    return F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (F.lit(SLICE_WIDTH) - count).cast("int"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))


def slice_events(start: Column, end: Column) -> Column:
    """What an interval adds to slices: ``slice``, covered ``bits``, ``open`` (whole slices from here on), ``dots`` (zero
    length). Three events at most, however long it is."""
    first, last = F.floor(start / SLICE_WIDTH).cast("bigint"), F.floor((end - 1) / SLICE_WIDTH).cast("bigint")
    low, high = start - first * SLICE_WIDTH, end - last * SLICE_WIDTH
    none = F.lit(0).cast("bigint")

    def event(at: Column, bits: Column = none, opened: Column = none, dots: Column = none) -> Column:
        return F.struct(at.alias("slice"), bits.alias("bits"), opened.alias("open"), dots.alias("dots"))

    def shifted(count: Column) -> Column:
        return F.call_function("shiftleft", _ones(count), low.cast("int"))

    return (F.when(end <= start, F.array(event(first, dots=_bit(low))))
            .when(first == last, F.array(event(first, shifted(end - start))))
            .otherwise(F.array(event(first, shifted(SLICE_WIDTH - low)), event(first + 1, opened=none + 1),
                               event(last, _ones(high), none - 1))))


def _bit_runs(bits: Column, base: Column) -> Column:
    """Runs of set bits as ``s``, ``e``; their numbers start at ``base``."""
    before, after = (F.call_function(f, bits, F.lit(1)) for f in ("shiftleft", "shiftrightunsigned"))
    places = F.sequence(F.lit(0), F.lit(SLICE_WIDTH - 1))

    def set_in(mask: Column) -> Column:
        return F.filter(places, lambda i: F.call_function("getbit", mask, i) == 1)

    starts, ends = set_in(bits.bitwiseAND(F.bitwise_not(before))), set_in(bits.bitwiseAND(F.bitwise_not(after)))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct((base + s).alias("s"), (base + e + 1).alias("e")))
    return F.when(bits != 0, runs).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))


def interval_merge(intervals: DataFrame, keys: Sequence[str], start: str = "ps", end: str = "pe") -> DataFrame:
    """Disjoint intervals per key; overlapping and touching ones are joined, one of zero length alone stays.

    Positions are whole numbers. The first shuffle brings together the events of a slice, the second one the slices of a key.
    """
    kind = {c: intervals.schema[c].dataType for c in (start, end)}
    events = intervals.where(F.col(start) <= F.col(end)).select(*keys, F.explode(slice_events(
        F.col(start).cast("bigint"), F.col(end).cast("bigint"))).alias("_v")).select(*keys, "_v.*")
    slices = events.groupBy(*keys, "slice").agg(F.bit_or("bits").alias("bits"), F.sum("open").alias("open"),
                                                F.bit_or("dots").alias("dots"))
    along = Window.partitionBy(*keys).orderBy("slice")
    base, whole = F.col("slice") * SLICE_WIDTH, F.col("whole") > 0
    swept = slices.withColumn("whole", F.sum("open").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "next", F.lead("slice").over(along))
    covered = F.array(F.struct(base.alias("s"), (F.col("next") * SLICE_WIDTH).alias("e")))
    dots = F.transform(_bit_runs(F.col("dots"), base), lambda r: F.sequence(r["s"], r["e"] - 1))
    parts = swept.select(*keys, F.explode(F.concat(
        F.when(whole, covered).otherwise(_bit_runs(F.col("bits"), base)),
        F.transform(F.flatten(dots), lambda p: F.struct(p.alias("s"), p.alias("e"))))).alias("_r")).select(*keys, "_r.*")
    in_order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(reach >= F.col("s"), 0).otherwise(1)
    return (parts.withColumn("_apart", apart)
            .withColumn("_island", F.sum("_apart").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*keys, "_island").agg(F.min("s").cast(kind[start]).alias(start), F.max("e").cast(kind[end]).alias(end))
            .drop("_island"))


def known_length(known: Column, start: Column, end: Column) -> Column:
    """Positions from ``start`` to ``end`` that the disjoint intervals ``known`` (``s``, ``e``) cover; null knows none."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.coalesce(known, F.array().cast("array<struct<s:bigint,e:bigint>>")), zero, lambda sum_, i: sum_ + F.greatest(
        zero, F.least(i["e"], end) - F.greatest(i["s"], start)))


def fold_plays(plays: DataFrame, keys: Sequence[str], seconds: str = "seconds") -> DataFrame:
    """Equal plays as one row: ``_all`` seconds of all, and those of the ``_first`` by stamps."""
    first = F.min_by(seconds, F.struct("ts", "te", seconds))
    return plays.groupBy(*keys, "ps", "pe").agg(F.sum(seconds).alias("_all"), first.alias("_first"))


def video_time(plays: DataFrame, keys: Sequence[str] = ("uid", "cwareid", "videoid"), seconds: str = "seconds",
               slice_width: int = SLICE_WIDTH) -> DataFrame:
    """Total, effective and completed seconds per key over one set of plays.

    * ``totaltime``     all wall seconds
    * ``effecttime``    wall seconds scaled by the share of each play that was new
    * ``completetime``  video positions watched at least once

    Plays are taken in ``(ps, pe, ts, te)`` order: of equal plays only the first can be new.
    """
    distinct = fold_plays(plays, keys, seconds)
    covered = interval_coverage(distinct, keys, "ps", "pe", slice_width)
    return _times(covered, keys)


def _times(covered: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    effective = S.effective_seconds(F.col("_first"), F.col("ps"), F.col("pe"), F.col("new_len"))
    return covered.groupBy(*keys).agg(
        F.sum("_all").alias("totaltime"), F.sum(effective).alias("effecttime"),
        F.sum("new_len").alias("completetime"), *more)


def video_time_after(folded: DataFrame, before: DataFrame | None, keys: Sequence[str] = ("uid", "cwareid", "videoid"),
                     slice_width: int | None = None) -> DataFrame:
    """Times and ``play_interval`` (``s-e`` texts) of the keys in ``folded`` (see :func:`fold_plays`), carried on from ``before``.

    ``before`` has the columns of the result, one row per key. What it covers is not new; its times are added. The text of a
    key holds its disjoint intervals, so it is bounded by the length of the video. All that is joined is partitioned by key.
    """
    keys, times, stored = list(keys), ("totaltime", "effecttime", "completetime"), None
    plays = folded.select(*keys, "ps", "pe")
    if before is not None:
        stored = before.join(folded.select(*keys).distinct(), keys, "left_semi").select(
            *keys, *[F.col(t).alias(f"_{t}") for t in times], S.parse_intervals(F.col("play_interval")).alias("known"))
        plays = plays.union(stored.select(*keys, F.explode("known").alias("_k")).select(*keys, "_k.s", "_k.e"))
    covered = interval_coverage(folded, keys, "ps", "pe", slice_width, stored)
    if stored is None:
        now = _times(covered, keys)
    else:
        now = _times(covered, keys, *[F.coalesce(F.max(f"_{t}"), F.lit(0)).alias(f"_{t}") for t in times]).select(
            *keys, *[(F.col(t) + F.col(f"_{t}")).alias(t) for t in times])
    merged = interval_merge(plays, keys).groupBy(*keys).agg(S.format_intervals(F.sort_array(F.collect_list(
        F.struct(F.col("ps").alias("s"), F.col("pe").alias("e"))))).alias("play_interval"))
    return now.join(merged, keys)
