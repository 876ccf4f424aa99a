"""Mixing sources to target weights by fitting a subset-sum budget over document lengths.

Targets are shares of the words of all documents by weight, stopped at a multiple of their source's size. A source is
taken whole as often as it fits; what remains of its target is a budget of words, filled from the histogram of its
document lengths: first in proportion, then in a seeded order, and the last part by a knapsack over all lengths left that
looks for the exact sum. The result says how many documents of each length are taken; a hash of the document, seeded, says which.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm.common import materialize, small_side, white_words

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: The greedy passes leave so many words of a budget to the knapsack, which may use every length that is left.
OPEN_WORDS = 20_000


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 42,
          carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``_carry``, ``source``, ``size`` in words and ``rnd``, the seeded place of a document among its equals in length."""
    rnd = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    return docs.select(F.struct(*[F.col(c) for c in carry]).alias("_carry"), F.col(source).alias("_source"),
                       F.size(white_words(F.col(text))).cast("long").alias("size"), rnd.alias("rnd"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``_source``, ``source_size`` and ``target`` per source; ``sizes`` has ``_source`` and ``size`` per document.

    Sources in code point order, null last, take the weights in turn. Stopping a target at ``most`` times its size and
    sharing the excess again by weight ends at one level L with target = min(most * size, L * weight): sources are
    ordered by size / weight, and L is the first level at which the next source stays below its stop. The windows run over
    one row per source.
    """
    per_source = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1) % len(weights) + 1)
    ranked = materialize(per_source.select("_source", "source_size", weight.alias("w")), "sources")
    before = Window.orderBy(F.col("source_size") / F.col("w"), F.col("_source")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / F.nullif(F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)), F.lit(0.0))
    levels = ranked.select("*", level.alias("level"), (F.col("source_size") / F.col("w")).alias("ratio"))
    open_level = levels.where(most * F.col("ratio") >= F.col("level")).agg(
        F.min(F.struct("ratio", F.col("_source"), "level"))["level"].alias("l")).first()["l"]  # one number
    stop = F.col("source_size") * float(most)
    return ranked.select("_source", "source_size", F.least(stop, F.lit(open_level) * F.col("w")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take so that the lengths sum to ``budget`` or as little below as can be found."""
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    share = counts * (min(budget, total) / total)
    take = np.minimum(counts, np.floor(share).astype(np.int64))
    rng = np.random.Generator(np.random.PCG64(seed))
    order, chance = rng.permutation(len(lengths)), rng.random(len(lengths))
    rest = budget - int((lengths * take).sum())
    for k in order:  # once in proportion: the broken part of a share is a chance
        if share[k] - np.floor(share[k]) > chance[k] and lengths[k] <= rest - OPEN_WORDS and take[k] < counts[k]:
            take[k] += 1
            rest -= int(lengths[k])
    for k in order:  # then whatever fits
        if 0 < lengths[k] <= rest - OPEN_WORDS:
            n = int(min(counts[k] - take[k], (rest - OPEN_WORDS) // lengths[k]))
            take[k] += n
            rest -= n * int(lengths[k])
    usable = [k for k in order if 0 < lengths[k] <= rest and take[k] < counts[k]]
    by = np.full(rest + 1, -1)  # by which item a sum was met first; all sums before its own item are met by earlier ones
    met, items = np.zeros(rest + 1, dtype=bool), []
    met[0] = True
    for k in usable:
        left, part = int(min(counts[k] - take[k], rest // lengths[k])), 1
        while left > 0 and not met[rest]:  # counts in binary parts, so that each part is taken or not
            n = min(part, left)
            step = n * int(lengths[k])
            new = np.flatnonzero(met[:rest + 1 - step] & ~met[step:]) + step
            met[new], by[new] = True, len(items)
            items.append((k, n))
            left -= n
            part *= 2
    best = int(np.flatnonzero(met)[-1])
    while best:
        k, n = items[by[best]]
        take[k] += n
        best -= n * int(lengths[k])
    return take


def _fit_source(pdf: pd.DataFrame, most: int, seed: int) -> pd.DataFrame:
    """One source: its histogram of lengths in, the copies and the extra documents per length out."""
    pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    whole = min(most, int(target // size)) if size else 0
    budget = 0 if whole >= most else round(target - whole * size)
    pdf["whole"] = np.int32(whole)
    pdf["extra"] = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), budget, seed)
    return pdf[["_source", "size", "source_size", "target", "whole", "extra"]]


def plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: int = 42) -> DataFrame:
    """Per source and length: ``whole`` copies of every document, and ``last``: one more of each up to this ``rnd``.

    ``sizes`` is stored: ``_source``, ``size``, ``rnd`` per document. A source goes to one task only as its histogram
    (one row per different length). The documents of one source and length may be a third of all rows, so their order is
    found in two steps: counts per slice of the hash range first, then ranks within the one slice that the cut falls in.
    """
    goal = targets(sizes, weights, most)
    histogram = sizes.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("n"))
    goal = goal.withColumnRenamed("_source", "_s")
    lengths = histogram.join(goal, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    fitted = materialize(lengths.groupBy("_source").applyInPandas(
        lambda pdf: _fit_source(pdf, most, seed),
        "_source string, size long, source_size long, target double, whole int, extra long"), "fitted")
    chosen = small_side(fitted.where("extra > 0").select(F.col("_source").alias("_s"), F.col("size").alias("_z"), "extra"))
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    slice_of = F.shiftright("rnd", 54).alias("slice")
    rows = sizes.join(chosen, same).select("_source", "size", "extra", "rnd", slice_of)
    group = Window.partitionBy("_source", "size")
    cells = (rows.groupBy("_source", "size", "extra", "slice").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("upto", F.sum("n").over(group.orderBy("slice")))
             .where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("n") < F.col("extra")))
             .select(F.col("_source").alias("_s"), F.col("size").alias("_z"), F.col("slice").alias("_l"),
                     (F.col("extra") - F.col("upto") + F.col("n")).alias("rank")))
    inside = rows.join(cells, same & (F.col("slice") == F.col("_l")))
    last = (inside.withColumn("r", F.row_number().over(Window.partitionBy("_source", "size", "slice").orderBy("rnd")))
            .where("r = rank").select(F.col("_source").alias("_s"), F.col("size").alias("_z"), F.col("rnd").alias("last")))
    return fitted.join(last, same, "left").select("_source", "size", "source_size", "target", "whole", "last")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: int = 42,
        carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``_carry``, ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``most``) per document.

    Documents with null or empty text have no words; they take part in whole copies only. A null source is a source.
    Equal rows (same id, same text) are taken alike; copies under other ids are told apart by their ids. An empty table
    gives no rows. The same input and seed give the same mix, in any partitioning.
    """
    sizes = materialize(sized(docs, text, source, doc_id, seed, (source,)).drop("_carry"), "sizes")
    decided = small_side(materialize(plan(sizes, weights, most, seed), "mix-plan")).withColumnsRenamed(
        {"_source": "_s", "size": "_z"})
    joined = sized(docs, text, source, doc_id, seed, carry).join(
        decided, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    more = F.when(F.col("rnd") <= F.col("last"), F.lit(1)).otherwise(F.lit(0))
    return joined.select("_carry", "size", "source_size", "target", (F.col("whole") + more).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as :func:`mix` takes it, with its own columns."""
    chosen = mix(docs, carry=docs.columns, **options).where("copies > 0")
    return chosen.select("_carry", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).select("_carry.*")
