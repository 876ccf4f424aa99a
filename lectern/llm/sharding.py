"""Balanced label propagation: linked documents into the same shard, shards of equal row counts.

Nodes are groups of equal texts; two nodes are linked where they share a line. Nobody writes out the pairs: a line is a
hub that all its nodes are joined to, and what a hub passes on is how many of its rows each shard holds. In each round
every linked node asks for the shard in which most of its neighbours' rows are, its own left out. The first node of a hub in
the order of hashes decides ties, and one that is first in all its hubs stays, so two linked nodes don't change places. Requests are granted in both directions
alike, plus what room a shard has, so that no shard grows past its quota. In the end linked nodes keep their shards and
the others fill the rest to the exact row: all ranks are counts per cell first and ranks within a cell second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.common import WHITE_CHARS, materialize, small_side

#: What the shard of a hub's first node weighs beside the shares of the rows, which add up to 1: it decides ties.
LEAD = 1e-3
#: Cells per shard in the final ranking; a cell is the unit that is sorted in one task.
CELLS = 1024
#: Documents of one group are spread over so many cells if the group is large.
GROUP_CELLS = 64


def rows_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
            carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``_carry``, ``size`` (UTF-8 bytes and one), ``text_crc32``, ``node`` (of equal texts) and ``salt`` per document."""
    value = F.col(text)
    return docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("_carry"), (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(value, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(value, F.lit(1)).alias("node"),
        F.xxhash64(F.lit(2), F.col(doc_id), value).alias("salt"))


def shared_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``node`` and ``hub``: the lines (with a word) that at least two different texts hold."""
    lines = F.array_distinct(F.filter(F.split(F.col(text), "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != ""))
    held = docs.select(F.xxhash64(F.col(text), F.lit(1)).alias("node"),
                       F.explode(F.transform(lines, lambda x: F.xxhash64(x, F.lit(3)))).alias("hub"))
    hubs = held.groupBy("hub").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    return held.join(hubs.where("low < high").select("hub"), "hub", "left_semi").distinct()


def propagate(nodes: DataFrame, links: DataFrame, room: Sequence[int], rounds: int = 4, slack: float = 0.05,
              fixed: dict[int, Sequence[int]] | None = None) -> DataFrame:
    """``node`` and ``label`` for the nodes of ``links`` and those of several rows; ``nodes`` has ``node`` and ``rows``.

    Quotas share the linked rows in proportion to the ``room`` of each shard, with ``slack`` on top. A node of more rows
    than that slack starts on a shard and stays.

    ``fixed`` nodes, a few, have their rows per shard: they are not labelled, but their neighbours are pulled there, as far as
    the shard has room, the whole of which is their quota. A shard without room is asked for by nobody.
    """
    fixed = fixed or {}
    is_fixed = F.col("node").isin(list(fixed)) if fixed else F.lit(False)
    if fixed:
        there = [F.sum(F.coalesce(*[F.when(F.col("node") == g, F.lit(r[s]).cast("long")) for g, r in fixed.items()], F.lit(0)))
                 for s in range(len(room))]
        anchors = small_side(materialize(links.where(is_fixed).groupBy("hub").agg(F.array(*there).alias("anchored")), "anchors"))
    nodes, links = nodes.where(~is_fixed), links.where(~is_fixed)
    shards, whole = len(room), max(1, sum(room))
    ends = [sum(room[:s + 1]) / whole for s in range(shards)]
    linked = links.select("node").distinct().withColumn("_linked", F.lit(True))
    draw = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    start = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends[:-1]]), lambda e: e <= F.col("_draw")))
    labels = materialize(
        nodes.join(linked, "node", "left").where(F.col("_linked") | (F.col("rows") > 1))
        .withColumn("_draw", draw).select("node", "rows", start.cast("int").alias("label")), "labels-0")
    total = labels.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]  # one number
    quota = [max(total * r / whole * (1 + slack), r if any(g[s] for g in fixed.values()) else 0) for s, r in enumerate(room)]
    held = [F.sum(F.when(F.col("label") == s, F.col("rows")).otherwise(0)) for s in range(shards)]
    for turn in range(rounds):
        labelled = links.join(labels, "node")
        hubs = labelled.groupBy("hub").agg(F.array(*held).alias("held"), F.min(F.struct("node", "label")).alias("lead"))
        if fixed:
            hubs = hubs.join(anchors, "hub", "left").select("hub", F.when(F.col("anchored").isNull(), F.col("held")).otherwise(
                F.zip_with("held", "anchored", lambda x, y: x + y)).alias("held"),
                F.when(F.col("anchored").isNull(), F.col("lead")).alias("lead"))
        hubs = materialize(hubs, f"hubs-{turn}")
        others = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x) - F.col("rows")
        leads = F.coalesce(F.col("lead.node") == F.col("node"), F.lit(False))

        def pull(s: int) -> Column:
            theirs = F.get("held", F.lit(s)) - F.when(F.col("label") == s, F.col("rows")).otherwise(0)
            towards = F.when(~leads & (F.col("lead.label") == s), F.lit(LEAD)).otherwise(F.lit(0.0))
            return F.sum(F.when(others > 0, theirs / others + towards).otherwise(0.0))

        wishes = labelled.join(hubs, "hub").groupBy("node").agg(
            F.array(*[pull(s) if room[s] else F.lit(0.0) for s in range(shards)]).alias("pull"), F.bool_and(leads).alias("leads"))
        best = F.array_max(F.transform("pull", lambda p, s: F.struct(p.alias("p"), (-s).alias("s"))))
        asked = labels.join(wishes, "node", "left").select(
            "node", "rows", "label", F.when((best["p"] > F.get("pull", F.col("label"))) & ~F.col("leads") & (F.col("rows") <= max(1, total * slack)),
                                            -best["s"]).otherwise(F.col("label")).cast("int").alias("wish"),
            (F.pmod(F.xxhash64("node", F.lit(100 + turn)), F.lit(1 << 20)) / float(1 << 20)).alias("draw"))
        asked = materialize(asked, f"wishes-{turn}")
        counts = {(r["label"], r["wish"]): r["n"] for r in asked.groupBy("label", "wish").agg(
            F.sum("rows").alias("n")).collect()}  # shards x shards numbers
        if all(a == b for a, b in counts):
            break
        now = [sum(n for (a, _), n in counts.items() if a == s) for s in range(shards)]
        granted = []
        space = [max(0.0, q - n) for q, n in zip(quota, now)]
        for (a, b), n in sorted(counts.items()):
            if a != b:
                wanted = sum(m for (c, d), m in counts.items() if d == b and c != b)
                there_and_back = min(n, counts.get((b, a), 0))
                part = min(1.0, (there_and_back + space[b] * n / wanted) / n)
                granted.append((F.col("label") == a) & (F.col("wish") == b) & (F.col("draw") < part))
        moves = F.lit(False)
        for grant in granted:
            moves = moves | grant
        labels = materialize(asked.select("node", "rows", F.when(moves, F.col("wish")).otherwise(F.col("label"))
                                          .alias("label")), f"labels-{turn + 1}")
    return labels.select("node", "label")


def shard(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", rounds: int = 4,
          carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``_carry``, ``size``, ``text_crc32``, ``node``, ``shard`` and ``slot`` per document.

    Row counts of the shards differ by one at most; slots of a shard run from 0 without gaps. Null texts are one group of
    equal texts and empty texts another; neither is linked by lines. Equal rows get different slots. Groups of more than
    half a shard are laid out first, one after the other, and go on in the next shard where one is full; texts that share
    lines with them are pulled to their shards as far as room is left. An empty table gives no rows.

    No rank needs all rows of a shard or of a group in one task: rows are counted per cell (shard, slice of the node hash,
    and for large groups slice of the row hash), the counts of the cells give each cell's first rank, and only rows of one
    cell are ordered together. The number of cells is fixed. Carried columns move once, to their cell.
    """
    rows = materialize(rows_of(docs, text, doc_id, [doc_id]).select("node", "salt"), "rows")
    nodes = materialize(rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows")), "nodes")
    links = materialize(shared_lines(docs, text), "links")
    n = rows.count()
    room = [n // shards + (s < n % shards) for s in range(shards)]
    starts = [sum(room[:s]) for s in range(shards)]
    # groups of more than half a shard, twice the number of shards at most, fill whole shards from the first on
    giants = [r["node"] for r in nodes.where(F.col("rows") > n / shards / 2).orderBy(F.desc("rows"), "node").collect()]
    giant_rows = nodes.where(F.col("node").isin(giants)).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] if giants else 0
    filled = [min(room[s], max(0, giant_rows - starts[s])) for s in range(shards)]
    left = [room[s] - filled[s] for s in range(shards)]
    size_of = {r["node"]: r["rows"] for r in nodes.where(F.col("node").isin(giants)).collect()} if giants else {}
    fixed, at = {}, 0  # the rows of a giant per shard, as they are laid out
    for g in giants:
        fixed[g] = [max(0, min(at + size_of[g], starts[s] + room[s]) - max(at, starts[s])) for s in range(shards)]
        at += size_of[g]
    labels = small_side(propagate(nodes, links, left, rounds, fixed=fixed))
    giant = F.array_position(F.array(*[F.lit(g) for g in giants]).cast("array<bigint>"), F.col("node")).cast("int")
    large = small_side(materialize(nodes.where(F.col("rows") > max(n // CELLS, 1_000)).select(
        "node", F.lit(True).alias("large")), "large-nodes"))

    def placed(df: DataFrame) -> DataFrame:
        """Label: a shard, ``shards`` for no shard, one more for giants; and the cell."""
        return (df.join(labels, "node", "left").join(large, "node", "left")
                .withColumn("label", F.when(giant > 0, shards + 1).otherwise(F.coalesce("label", F.lit(shards))))
                .withColumn("cell", F.when(giant > 0, giant.cast("long")).otherwise(
                    F.pmod(F.xxhash64("node", F.lit(11)), F.lit(CELLS))))
                .withColumn("part", F.when(F.col("large"), F.pmod("salt", F.lit(GROUP_CELLS))).otherwise(F.lit(-1)))
                .drop("large"))

    cells = placed(rows).groupBy("label", "cell", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("label").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(cells.withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0))), "cells")
    held = {r["label"]: r["n"] for r in cells.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # shards + 2 numbers
    own = [min(left[s], held.get(s, 0)) for s in range(shards)]
    over = [held.get(s, 0) - own[s] for s in range(shards)]
    inside = Window.partitionBy("label", "cell", "part").orderBy("node", "salt")
    first = F.broadcast(cells.drop("n"))  # a fixed number of cells
    ranked = (placed(rows_of(docs, text, doc_id, carry)).join(first, ["label", "cell", "part"])
              .withColumn("rank", F.col("first") + F.row_number().over(inside) - 1))

    def lookup(values: Sequence[int], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), at + 1)

    def last_start(values: Sequence[int], at: str) -> Column:
        """A shard without slots starts where the next one does, so the last start at or before the rank is meant."""
        return F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in values]), lambda v: v <= F.col(at))) - 1

    # rows beyond their shard's room, then the rows of no shard, fill the free slots of the shards in turn
    pool_start = [sum(over[:s]) for s in range(shards)] + [sum(over), 0]
    free_start = [sum(left[:s]) - sum(own[:s]) for s in range(shards)]
    label, is_giant = F.col("label"), F.col("label") == shards + 1
    stays = F.col("rank") < lookup(own + [0, 0], label)
    return (ranked.withColumn("pool", F.col("rank") - lookup(own + [0, 0], label) + lookup(pool_start, label))
            .withColumn("shard", F.when(is_giant, last_start(starts, "rank")).when(stays, label)
                        .otherwise(last_start(free_start, "pool")).cast("int"))
            .withColumn("slot", F.when(is_giant, F.col("rank") - lookup(starts, F.col("shard")))
                        .when(stays, F.col("rank") + lookup(filled, label))
                        .otherwise(lookup([f + o for f, o in zip(filled, own)], F.col("shard")) + F.col("pool")
                                   - lookup(free_start, F.col("shard"))))
            .select("_carry", "size", "text_crc32", "node", "shard", "slot"))


def with_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The documents with their own columns, then ``shard`` and ``slot`` (or, where a column has that name already,
    ``shard_1`` and ``slot_1``)."""
    placed = shard(docs, shards, carry=docs.columns)
    names = {n: n if n not in docs.columns else f"{n}_1" for n in ("shard", "slot")}
    return placed.select("_carry.*", *[F.col(n).alias(alias) for n, alias in names.items()])
