"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every ``u`` hangs under one ``v`` only, and that under none. Links are distinct."""
    ends = (edges.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
            .union(edges.select("v", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")))
    return not ends.agg(F.count_if((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0)))).first()[0]  # one number


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """``id`` and ``label`` (the smallest id of its component) for every id of ``links``; links need not be distinct.

    Each round hangs every id's larger neighbours under its smallest neighbour, then its smaller ones too. The smallest
    neighbours are found by a partial aggregation and joined back, so an id with very many links needs no list of them. Rounds
    are logarithmic in the longest chain; every round is a stored table. It ends when all components are stars, so links that
    are stars already, as labels of an earlier call, take no round.
    """
    u, v = F.col("u"), F.col("v")
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(u != v).distinct(),
                        "edges")
    turn = 0
    while not _stars(edges):
        turn += 1
        both = edges.select("u", "v").union(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        large = materialize(large, f"large-{turn}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v)
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = materialize(small, f"small-{turn}")
    stars = edges.select(u.alias("id"), v.alias("label"))
    roots = stars.select(F.col("label").alias("id"), "label").distinct()
    return stars.union(roots)
