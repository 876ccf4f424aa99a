"""Jaccard self-join of documents on word shingles, as a size-aware join of light and heavy sets.

Texts with equal sets form a node. Two different nodes that link share many shingles, so under any fixed order of all
shingles they share one among their first few (the prefix), and two among one more. The order puts shingles that many
documents hold last, so prefixes are made of rare ones.

* Light sets, up to a boundary, are found by the pairs (subsets of two) of their prefix: many keys, short lists.
* Heavy sets scan inverted lists of single prefix shingles: few keys, longer lists. Light sets near the boundary are in
  these lists as well, for pairs across it.
* The boundary is the one of least cost, with keys and scans counted on the sizes of all sets.

Lists of up to :data:`LIST` members are compared in pairs. A longer list, as a large group of near copies makes, never is:
its most central member becomes the pivot and all others are compared with that. Members that link to the pivot need no
comparison among each other, they are in one component already. A member that doesn't link to the pivot can link to a third only if both
differ from the pivot in the same shingles, and in a number of them that follows from the sizes; so these differences
are the sets of the next level, with prefixes and lists of their own (:func:`_differences`). The links found so far are
gathered into components before each level, and only members of different components are compared. So no link between
components is lost, and a group costs about one comparison per member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import materialize, small_side
from lectern.llm.components import connected
from lectern.llm.shingles import FACTORS, WordHashes, mixed, set_key, shingle_set, word_hashes

#: Longest list that is compared in pairs, and the count from which a shingle goes to the end of the order.
LIST = 32
#: At most so many shingles are known as frequent (8 bytes each in every task); it bounds only that order, not the result.
FREQUENT = 500_000
#: Cost of reading one entry of an inverted list against the cost of one key.
SCAN = 4
#: The same for lists of differences, in which only pairs across components are compared.
LATER_LIST = 512
#: One in so many long lists counts for the choice of shared pivots, which changes cost, never the result.
COUNTED = 2
#: After so many levels lists are compared in pairs whatever their length.
LEVELS = 8

Batches = Iterator[pa.RecordBatch]


def _ceil(part: int, whole: int) -> int:
    return -(-part // whole)


def prefix_length(size: int, percent: int) -> int:
    """Shingles of which a partner must hold one."""
    return size - _ceil(percent * size, 100) + 1


def _each_set(batches: Batches, width: int, *columns: str) -> Iterator[list[tuple]]:
    """Per batch: the named columns and the set of every text."""
    memo = WordHashes()
    for batch in batches:
        texts = batch.column("text")
        others = [batch.column(c).to_pylist() for c in columns]
        yield [(*(o[i] for o in others), shingle_set(word_hashes(texts[i].as_py(), memo), width))
               for i in range(batch.num_rows)]


def _ordered(values: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """``values`` with the frequent ones last, and how many these are."""
    if not len(frequent):
        return values, 0
    at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
    common = frequent[at] == values
    return np.concatenate([values[~common], values[common]]), int(common.sum())


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def nodes_of(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``tie`` (hash of the text), ``node`` (key of the set), ``n`` (its size) and ``sig`` (:func:`_signature`) per
    document; ``sig`` only once per set and batch."""
    def run(batches: Batches) -> Batches:
        for rows in _each_set(batches, width, "doc_id", "tie"):
            nodes, signatures, seen = [set_key(r[2]) for r in rows], [], set()
            for node, (_, _, values) in zip(nodes, rows):
                signatures.append(_signature(values) if len(values) and node not in seen else None)
                seen.add(node)
            yield _batch(doc_id=pa.array([r[0] for r in rows], pa.int64()), tie=pa.array([r[1] for r in rows], pa.int64()),
                         node=pa.array(nodes, pa.int64()), n=pa.array([len(r[2]) for r in rows], pa.int64()),
                         sig=pa.array(signatures, pa.binary()))
    return docs.withColumn("tie", F.xxhash64("text")).mapInArrow(run, "doc_id long, tie long, node long, n long, sig binary")


def frequent_shingles(docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """The shingles that come into question for a prefix and that :data:`LIST` documents or more hold, sorted.

    Counted over all documents, to twice the depth of a prefix. If they are too many, the more frequent ones.
    """
    def run(batches: Batches) -> Batches:
        held, size = [], 0
        for rows in _each_set(batches, width):
            for (values,) in rows:
                held.append(values[:2 * prefix_length(len(values), percent) + 8])
                size += len(held[-1])
                if size > 1_000_000:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return _batch(h=h.view(np.int64), c=c.astype(np.int64))

    counts = materialize(docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
                         .where(F.col("c") >= LIST), "frequent-shingles")
    least = LIST
    while counts.where(F.col("c") >= least).count() > FREQUENT:
        least *= 2
    return np.sort(counts.where(F.col("c") >= least).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def boundary(sizes: Sequence[tuple[int, int]], percent: int) -> int:
    """Largest light size: the least sum of subset keys of light sets, and keys and scans of the lists.

    Pairs of a prefix grow with its square, so sets of more than a few hundred shingles are heavy at any cost of a scan
    and ``sizes`` may leave them out.
    """
    def cost(limit: int) -> int:
        total = 0
        for size, count in sizes:
            p = prefix_length(size, percent)
            if size <= limit:
                total += count * p * (p + 1) // 2
            if size > limit or 100 * size >= percent * (limit + 1):
                total += count * p * (1 + SCAN)
        return total

    candidates = [0, *sorted(size for size, _ in sizes)]
    return min(candidates, key=cost)


def postings(docs: DataFrame, width: int, percent: int, frequent: np.ndarray, light: int) -> DataFrame:
    """Keys of every set: ``key``, ``node``, ``n``, ``rest`` (an upper bound of common shingles if this key is the first
    in common), ``cost`` and ``base`` (two entries need (cost + cost - base) / (100 + percent) in common to link) and
    ``part``: two entries of a list with equal parts need no comparison. Light sets have one part in the
    lists of single shingles, all others are a part of their own."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Batches) -> Batches:
        for rows in _each_set(batches, width):
            seen, out = set(), []
            for (values,) in rows:
                n = len(values)
                node = set_key(values)
                if n == 0 or node in seen:
                    continue
                seen.add(node)
                ordered, _ = _ordered(values, known.value)
                p = prefix_length(n, percent)
                if n <= light and n > 1:
                    i, j = np.triu_indices(min(p + 1, n), 1)
                    keys = mixed(ordered[i] * FACTORS[0] + ordered[j] * FACTORS[1])
                    out.append((keys, node, n, n - j + 1, node))
                if n > light or 100 * n >= percent * (light + 1):
                    out.append((ordered[:p], node, n, n - np.arange(p), 0 if n <= light else node))
            if out:
                yield _postings_batch(out, percent)

    return docs.mapInArrow(run, POSTING)


POSTING = "key long, node long, n long, rest long, cost long, base long, part long"


def _postings_batch(out: list[tuple], percent: int) -> pa.RecordBatch:
    lengths = [len(o[0]) for o in out]
    def spread(at: int, dtype) -> np.ndarray:
        return np.repeat(np.array([o[at] for o in out], dtype=dtype), lengths)
    n = spread(2, np.int64)
    return _batch(key=np.concatenate([o[0] for o in out]).view(np.int64), node=spread(1, np.int64), n=n,
                  rest=np.concatenate([np.asarray(o[3], dtype=np.int64) for o in out]), cost=percent * n, base=0 * n,
                  part=spread(4, np.int64))


def _pairs_in_lists(percent: int) -> Callable[[Batches], Batches]:
    """Pairs within runs of equal keys, for partitions sorted by key; runs may go on in the next batch."""
    names = ("key", "node", "n", "rest", "cost", "base", "part")

    def pairs(c: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        found, size = [], len(c["key"])
        left = np.arange(size)
        lag = 1
        while len(left):
            left = left[left + lag < size]
            left = left[c["key"][left] == c["key"][left + lag]]
            x, y = left, left + lag
            low, high = np.minimum(c["n"][x], c["n"][y]), np.maximum(c["n"][x], c["n"][y])
            keep = ((c["node"][x] != c["node"][y]) & (c["part"][x] != c["part"][y]) & (100 * low >= percent * high)
                    & ((100 + percent) * np.minimum(c["rest"][x], c["rest"][y])
                       >= c["cost"][x] + c["cost"][y] - c["base"][x]))
            a, b = c["node"][x[keep]], c["node"][y[keep]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            lag += 1
        both = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        if not len(both):
            return None
        both = np.unique(both, axis=0)
        return _batch(a=np.ascontiguousarray(both[:, 0]), b=np.ascontiguousarray(both[:, 1]))

    def run(batches: Batches) -> Batches:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            if rest is not None:
                c = {k: np.concatenate([rest[k], c[k]]) for k in names}
            if not len(c["key"]):
                continue
            cut = int(np.searchsorted(c["key"], c["key"][-1]))
            rest = {k: v[cut:] for k, v in c.items()}
            if cut and (out := pairs({k: v[:cut] for k, v in c.items()})) is not None:
                yield out
        if rest is not None and (out := pairs(rest)) is not None:
            yield out

    return run


def _signature(values: np.ndarray) -> bytes:
    """Parity bits: a shingle flips the bit its hash names. Two to four bits per shingle, a power of two in all."""
    size = max(64, 1 << (2 * max(1, len(values)) - 1).bit_length())
    bits = np.bincount((values % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _flipped(x: bytes, y: bytes) -> int:
    """Bits in which two signatures differ: no more than the shingles that only one of the sets holds."""
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    while len(x) > len(y):  # the halves of a signature, flipped together, are the signature of half the size
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures allow a link, a superset of the links. Signatures are a tenth of the sets or less."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "n", "m"))):
                both = (n + m - _flipped(x, y)) // 2
                keep.append(100 * both >= percent * (n + m - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    signed = (pairs.join(sets.select(F.col("node").alias("a"), F.col("sig").alias("x"), "n"), "a")
              .join(sets.select(F.col("node").alias("b"), F.col("sig").alias("y"), F.col("n").alias("m")), "b"))
    return signed.mapInArrow(run, "a long, b long")


def _signatures(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node``, ``n`` and ``sig`` of all nodes of ``pairs``."""
    paired = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "paired")
    signed = nodes.where("sig IS NOT NULL").select("node", "n", "sig").join(small_side(paired), "node", "left_semi")
    return materialize(signed.dropDuplicates(["node"]), "signatures")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs ``a, b`` that link."""
    return _linked(materialize(_likely(pairs, sets, percent), name), sets, percent)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link, by their full sets."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = _common(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, sets).mapInArrow(run, "a long, b long")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the sets ``x`` of ``a`` and ``y`` of ``b``."""
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b"))


def _inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which values of ``x`` are in ``y``, both sorted."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return int(_inside(x, y).sum())


def _differences(stars: DataFrame, sets: DataFrame, percent: int, frequent: np.ndarray) -> DataFrame:
    """Members ``b`` against their pivots ``a``: ``linked``, and the keys of the next level.

    With A_x = p - x and N_x = x - p, two members have in common |p| - |A_x| - |A_y| + s and together
    |p| + |N_x| + |N_y| - s, where s counts what A_x, A_y and N_x, N_y have in common. With t = percent / 100 they link if
    (1 + t) s >= t |N_x| + |A_x| + t |N_y| + |A_y| - (1 - t) |p|. If y alone doesn't link to p, its part of that sum is positive
    and s >= t |N_y| + |A_y| - (1 - t) |p|; for x follows (1 + t) s > t |N_x| + |A_x|. So each needs one common difference
    among its first |A| + |N| - s + 1, in an order fixed per pivot. The sum itself, and how many differences are left from a
    place in that order on, then rule out most pairs of a list.
    """
    known = stars.sparkSession.sparkContext.broadcast(frequent)
    pq = percent

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(k) for k in ("a", "b", "x", "y"))):
                p, x = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                lost, new = p[~_inside(p, x)], x[~_inside(x, p)]
                over = pq * len(new) + 100 * len(lost) - (100 - pq) * len(p)
                linked = over <= 0
                s = max(1, _ceil(pq * len(new) + 100 * len(lost), 100 + pq) if linked else _ceil(over, 100))
                fresh, common = _ordered(new, known.value)
                cut = len(fresh) - common
                salt = np.uint64(a.as_py() & 0xFFFFFFFFFFFFFFFF)
                delta = mixed(np.concatenate([fresh[:cut] + salt, lost * FACTORS[2] + salt, fresh[cut:] + salt]))
                keys = delta[:max(0, len(delta) - s + 1)].view(np.int64)
                out.append((a.as_py(), b.as_py(), len(x), linked, pq * len(new) + 100 * len(lost), (100 - pq) * len(p),
                            len(delta), keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(),
                     pa.list_(pa.int64())))],
                names=["a", "b", "n", "linked", "cost", "base", "total", "keys"])

    return _with_sets(stars, sets).mapInArrow(
        run, "a long, b long, n long, linked boolean, cost long, base long, total long, keys array<long>")


def _split_lists(rows: DataFrame, longest: int | None, percent: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of the short lists, and ``key`` and ``node`` of the long ones. Lists of one part are left out."""
    if longest is None:
        other = rows.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("part").alias("t"),
                            F.col("rest").alias("r"), F.col("cost").alias("c"))
        every = rows.join(other, "key").where("node < b AND part <> t").where(
            (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
            & ((100 + percent) * F.least("rest", "r") >= F.col("cost") + F.col("c") - F.col("base")))
        return materialize(every.select(F.col("node").alias("a"), "b").distinct(), f"{name}-pairs"), None
    lists = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("part").alias("low"), F.max("part").alias("high"))
    long = materialize(lists.where(F.col("m") > longest).select("key", (F.col("low") < F.col("high")).alias("open")),
                       f"{name}-long")
    long = small_side(long)
    short = rows.join(long, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    pairs = materialize(short.mapInArrow(_pairs_in_lists(percent), "a long, b long").distinct(), f"{name}-pairs")
    return pairs, materialize(rows.join(long.where("open"), "key").select("key", "node").distinct(), f"{name}-members")


def _held_often(held: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that ``least`` of the sets ``held`` or more hold, sorted, and the numbers of these sets.

    If these are more than :data:`FREQUENT`, those of the larger numbers.
    """
    def count(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                h, c = np.unique(np.concatenate([np.frombuffer(v.as_py(), dtype=np.uint64) for v in batch.column("s")]),
                                 return_counts=True)
                yield _batch(h=h.view(np.int64), c=c.astype(np.int64))

    counts = materialize(held.select("s").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
                         .where(F.col("c") >= least), "member-shingles")
    while counts.where(F.col("c") >= least).count() > FREQUENT:
        least *= 2
    table = counts.where(F.col("c") >= least).toPandas()
    order = np.argsort(table["h"].to_numpy(np.int64).view(np.uint64))
    return table["h"].to_numpy(np.int64).view(np.uint64)[order], table["c"].to_numpy(float)[order]


def _central(held: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``node`` and ``core`` of all members of long lists, whose sets are ``held``, and the shingles that many of these hold.

    ``core`` is the mean number of members that hold a shingle of the set: of a group of near copies, the text that the others
    were made from has the largest. Only counts from :data:`LIST` on are told apart, and at most :data:`FREQUENT`.
    """
    shingles, number = _held_often(held, LIST)
    known = held.sparkSession.sparkContext.broadcast((shingles, number))

    def core(batches: Batches) -> Batches:
        shingles, number = known.value
        for batch in batches:
            means = []
            for v in batch.column("s"):
                v = np.frombuffer(v.as_py(), dtype=np.uint64)
                at = np.minimum(np.searchsorted(shingles, v), max(0, len(shingles) - 1))
                means.append(float(number[at[shingles[at] == v]].sum() / len(v)) if len(shingles) else 0.0)
            yield _batch(node=batch.column("node"), core=pa.array(means, pa.float64()))

    return materialize(held.select("node", "s").mapInArrow(core, "node long, core double"), "cores"), shingles


def _listed(members: DataFrame) -> DataFrame:
    """``node`` and ``core`` of all members of long lists: the number of a member's lists times their mean length, of one in :data:`COUNTED`.

    Where a group has many lists, as keys of its signatures, the text that the others were made from is in most of them. No set is read.
    """
    lists = members.where(F.pmod(F.xxhash64("key"), F.lit(COUNTED)) == 0)
    lengths = small_side(materialize(lists.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "list-lengths"))
    found = lists.join(lengths, "key").select("node", "m", F.lit(0).alias("one")).union(
        members.select("node", F.lit(None).cast("long"), F.lit(1)))
    core = F.coalesce(F.avg("m"), F.lit(0.0)) * F.sum("one")
    return materialize(found.groupBy("node").agg(core.alias("core")), "cores")


def _stars(members: DataFrame, cores: DataFrame, name: str, shared: bool) -> DataFrame:
    """``a``, the pivot of a long list, and ``b``, each of its members.

    The pivot is the most central member, or, as any set may be the pivot of a list, with ``shared`` the most central one that
    this member shares a list with: the many lists of one group then have one pivot, and each member is compared once.
    """
    best = F.max(F.struct("core", "node")).alias("best")
    ranked = members.join(cores, "node").groupBy("key").agg(best)
    if not shared:
        pivots = ranked.select("key", F.col("best.node").alias("a"))
        return materialize(members.join(pivots, "key").select("a", F.col("node").alias("b")).distinct(), name)
    firsts = small_side(materialize(ranked, f"{name}-first"))
    met = materialize(members.join(firsts, "key").select("best", "node").distinct(), f"{name}-met")
    chosen = met.select(F.col("best.node").alias("node")).distinct()
    tops = (met.join(chosen, "node", "left_semi").groupBy("node").agg(F.max("best").alias("top"))
            .select(F.col("node").alias("first"), F.col("top.node").alias("a")))
    return materialize(met.join(tops, F.col("best.node") == F.col("first")).select("a", F.col("node").alias("b")).distinct(), name)


def linked_nodes(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` between nodes that connect all nodes which links connect."""
    sizes = [(int(r["n"]), int(r["count"])) for r in nodes.where("n > 0 AND n <= 400").groupBy("n").count().collect()]
    frequent = frequent_shingles(docs, width, percent)
    rows = materialize(postings(docs, width, percent, frequent, boundary(sizes, percent)), "postings")
    pairs, members = _split_lists(rows, LIST, percent, "level-0")
    likely = materialize(_likely(pairs, _signatures(nodes, pairs), percent), "level-0-likely")
    sets = sets_of(docs, nodes, likely, members, width)
    links = materialize(_linked(likely, sets, percent), "links-0")
    return with_long_lists(links, members, sets, percent)


def with_long_lists(links: DataFrame, members: DataFrame | None, sets: DataFrame, percent: int,
                    shared_pivots: bool = False) -> DataFrame:
    """``links`` and those within long lists, as far as components need them. ``members`` are ``key`` and ``node`` of
    lists in which every pair that links may be met; ``sets`` holds the sets of all their nodes (:func:`sets_of`).
    ``shared_pivots`` suits lists of which a group has many (:func:`_stars`)."""
    held, cores, frequent = sets.where("member"), None, None
    for level in range(LEVELS):
        if members is None or members.isEmpty():
            return links
        if cores is None:
            cores, frequent = (_listed(members), None) if shared_pivots else _central(held)
        stars = _stars(members, cores, f"level-{level}-stars", shared_pivots)
        if frequent is None:  # what groups have in common is in their pivots
            pivots = small_side(materialize(stars.select(F.col("a").alias("node")).distinct(), "pivots"))
            frequent, _ = _held_often(held.join(pivots, "node", "left_semi"), 1)
        compared = materialize(_differences(stars, held, percent, frequent), f"level-{level}-compared")
        labels = connected(links.union(compared.where("linked AND a <> b").select("a", "b")), "a", "b")
        labelled = (compared.join(labels.withColumnRenamed("id", "b"), "b", "left")
                    .withColumn("part", F.coalesce("label", "b")).drop("label"))
        labelled = (labelled.join(labels.withColumnsRenamed({"id": "a", "label": "own"}), "a", "left")
                    .withColumn("own", F.coalesce("own", "a")))
        labelled = materialize(labelled, f"level-{level}-labelled")
        open_pivots = labelled.where("part <> own").select("a").distinct()
        rows = labelled.join(open_pivots, "a", "left_semi").select(
            F.posexplode("keys").alias("at", "key"), F.col("b").alias("node"), "n", "total", "cost", "base", "part").select(
            "key", "node", "n", (F.col("total") - F.col("at")).alias("rest"), "cost", "base", "part")
        rows = materialize(rows, f"level-{level + 1}-rows")
        longest = None if level + 1 == LEVELS else LATER_LIST
        pairs, members = _split_lists(rows, longest, percent, f"level-{level + 1}")
        # from here on the labels stand for the links they came from
        links = materialize(labels.select(F.col("id").alias("a"), F.col("label").alias("b"))
                            .union(_verify(pairs, held, percent, f"level-{level + 1}-likely")), f"links-{level + 1}")
    return links


def sets_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``node``, size ``n``, signature ``sig``, set ``s`` and ``member`` (it is in a long list) of all nodes that are compared,
    from one document of each."""
    named = (pairs.select(F.col("a").alias("node")).union(pairs.select("b")).withColumn("member", F.lit(False))
             .union(members.select("node", F.lit(True))))
    wanted = named.groupBy("node").agg(F.max("member").alias("member"))
    ids = materialize(nodes.join(wanted, "node").groupBy("node").agg(
        F.min("doc_id").alias("id"), F.max("member").alias("member")), "wanted")

    def run(batches: Batches) -> Batches:
        for rows in _each_set(batches, width):
            yield _batch(node=pa.array([set_key(r[0]) for r in rows], pa.int64()),
                         n=pa.array([len(r[0]) for r in rows], pa.int64()),
                         sig=pa.array([_signature(r[0]) for r in rows], pa.binary()),
                         s=pa.array([r[0].tobytes() for r in rows], pa.binary()))

    picked = docs.join(small_side(ids.select("id").distinct()), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = picked.select("text").mapInArrow(run, "node long, n long, sig binary, s binary")
    return materialize(sets.join(small_side(ids.select("node", "member")), "node").dropDuplicates(["node"]), "sets")


def labelled_nodes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The stored rows of :func:`nodes_of`, and ``node`` and ``label`` (equal for linked nodes) of all non-empty sets."""
    nodes = materialize(nodes_of(docs, width), "nodes")
    labels = connected(linked_nodes(docs, nodes, width, percent), "a", "b").withColumnRenamed("id", "node")
    filled = nodes.where("n > 0").select("node").distinct().join(labels, "node", "left")
    return nodes, materialize(filled.select("node", F.coalesce("label", "node").alias("label")), "labelled")


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4,
                       percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (smallest id reachable by links) per document.

    Documents without words have an empty set and are linked with nothing, copies of them neither: their component is
    their own id. Equal sets of one shingle or more are linked. Rows with equal ids are returned each; rows without an id take
    part, and the component of rows without any id is null. An empty table gives no rows. Shingles and sets are
    compared by 64-bit hashes.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    nodes, labelled = labelled_nodes(docs, width, percent)
    classes = nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")).join(labelled, "node")
    classes = materialize(classes, "classes")
    least = classes.groupBy("label").agg(F.min("first").alias("component"))
    known = materialize(classes.join(least, "label").select("node", "component"), "node-components")
    return nodes.join(known, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5,
                         percent: int = 80) -> DataFrame:
    """One document of each group of linked ones, with its own columns: that of the smallest id (null last, equal ids by
    a hash of the text). Of rows equal in id and text one stays. Documents without words are in no group and all stay.

    What is joined with the documents is the keys of those that go; texts move only if these are too many for a broadcast, and
    those of repeated rows.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    nodes, labelled = labelled_nodes(slim, width, percent)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("tie").alias("t"))
    members = nodes.join(labelled, "node").groupBy("label", "doc_id", "tie").agg(F.count(F.lit(1)).alias("m"))
    members = materialize(members.withColumn("place", place), "members")
    first = members.groupBy("label").agg(F.min("place").alias("first"))
    judged = materialize(members.join(first, "label").select(
        F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "m", (F.col("place") == F.col("first")).alias("stays")),
        "judged")
    gone = small_side(materialize(judged.where("NOT stays").select("_id", "_tie"), "gone"))
    repeated = materialize(judged.where("stays AND m > 1").select("_id", "_tie"), "repeated")
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"),
                         F.col(doc_id).cast("long").alias("_i"), F.xxhash64(F.col(text)).alias("_t"))
    same = F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tie"))
    kept = packed.join(gone, same, "left_anti")
    if not repeated.isEmpty():
        repeated = small_side(repeated)
        kept = kept.join(repeated, same, "left_anti").unionByName(
            kept.join(repeated, same, "left_semi").dropDuplicates(["_i", "_t"]))
    return kept.select("_row.*")
