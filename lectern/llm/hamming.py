"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A set of word shingles has a signature of :data:`SYMBOLS` symbols: of the least value under each hash function, the lowest
:data:`BITS` bits. Two sets of similarity J differ in a symbol with a probability of about 1 - J, so sets that link differ in few.
All pairs that differ in up to r symbols are found: the signature is cut into chunks with allowances of errors t1, t2..., where the
t + 1 sum to r + 1. If every chunk of a pair had more errors than its allowance, the pair would have more than r; so one chunk
at least is within it (pigeonhole). A chunk within t errors is met by a key: every choice of its symbols without t is one, and
equal keys meet in one list.

Pairs of short lists are compared by whole signatures, and those within the radius are confirmed on their full sets. A list of more
than :data:`LIST` members, as a large group of near copies makes, is never compared in pairs: its members are compared with a pivot,
and what remains open is joined by the differences from it (:func:`lectern.llm.jaccard.with_long_lists`).

The join loses no pair within the radius. The radius follows from the similarity asked for: a link at exactly that similarity is
outside with a probability of :data:`MISSED` at most (the tail of a binomial distribution), a more similar one with less.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import materialize, small_side
from lectern.llm.components import connected
from lectern.llm.jaccard import sets_of, with_long_lists
from lectern.llm.shingles import FACTORS, WordHashes, mixed, set_key, shingle_set, word_hashes

#: Symbols of a signature and bits of each, and symbols of a chunk.
SYMBOLS, BITS, CHUNK = 128, 16, 4
#: Most probable loss of a link at the least similarity that links.
MISSED = 1e-6
#: Longest list that is compared in pairs.
LIST = 32
#: From so many pairs a document on, only pairs between components that the first pair of each leaves apart have their sets compared.
MANY = 32
#: Shingles that are hashed at once; bounds the memory of a very long text.
BLOCK = 4096

Batches = Iterator[pa.RecordBatch]
NUMBERS = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
SLOPES, SHIFTS = mixed(NUMBERS * FACTORS[1]) | np.uint64(1), mixed(NUMBERS * FACTORS[2])


def signature(values: np.ndarray) -> np.ndarray:
    """The symbols of a non-empty set of shingle hashes."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), BLOCK):
        block = values[at:at + BLOCK, None] * SLOPES + SHIFTS
        least = np.minimum(least, block.min(axis=0))
    return (mixed(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def radius_of(percent: int) -> int:
    """Symbols in which sets of a similarity of ``percent`` may differ: more are less likely than :data:`MISSED`."""
    different, radius, beyond = 1 - percent / 100, 0, 1.0
    while beyond > MISSED and radius < SYMBOLS:
        radius += 1
        beyond = sum(comb(SYMBOLS, k) * different ** k * (1 - different) ** (SYMBOLS - k) for k in range(radius + 1, SYMBOLS + 1))
    return radius


def allowances(radius: int) -> list[int]:
    """Errors allowed in each chunk: one less than its share of ``radius + 1``, so none where the share is nothing (-1)."""
    chunks = SYMBOLS // CHUNK
    share, more = divmod(radius + 1, chunks)
    return [share - 1 + (i < more) for i in range(chunks)]


def choices(radius: int) -> list[list[int]]:
    """The symbols of every key: of each chunk, every choice that leaves out as many as its allowance."""
    return [[CHUNK * i + k for k in chosen] for i, errors in enumerate(allowances(radius)) if errors >= 0
            for chosen in combinations(range(CHUNK), CHUNK - errors)]


def keys_of(signatures: np.ndarray, chosen_symbols: list[list[int]]) -> np.ndarray:
    """The keys of each row of signatures, one column per choice; up to four symbols of 16 bits enter a key whole."""
    keys = np.empty((len(signatures), len(chosen_symbols)), np.uint64)
    for k, chosen in enumerate(chosen_symbols):
        word = np.zeros(len(signatures), np.uint64)
        for at in chosen:
            word = (word << np.uint64(BITS)) | signatures[:, at].astype(np.uint64)
        keys[:, k] = mixed(word ^ mixed(np.array([k + 1], np.uint64) * FACTORS[0]))
    return keys


def signed(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``node`` (key of the set), ``n`` (its size) and ``sig`` per document; ``sig`` only once per set and batch."""
    def run(batches: Batches) -> Batches:
        memo = WordHashes()
        for batch in batches:
            seen: set[int] = set()
            nodes, sizes, signatures = [], [], []
            for text in batch.column("text"):
                values = shingle_set(word_hashes(text.as_py(), memo), width)
                node = set_key(values)
                nodes.append(node)
                sizes.append(len(values))
                signatures.append(signature(values).tobytes() if len(values) and node not in seen else None)
                seen.add(node)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())],
                names=["doc_id", "node", "n", "sig"])

    return docs.mapInArrow(run, "doc_id long, node long, n long, sig binary")


def _rows_of(column: pa.Array) -> np.ndarray:
    """Signatures as rows of symbols."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """``key``, ``node``, ``n`` for all keys of sets that can link to a different one."""
    chosen = choices(radius_of(percent))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = keys_of(_rows_of(part.column("sig")), chosen)
                node, n = (np.repeat(part.column(c).to_numpy(), keys.shape[1]) for c in ("node", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(node), pa.array(n)],
                                                 names=["key", "node", "n"])

    able = sets.where((F.col("n") > 0) & (100 * F.col("n") >= percent * (F.col("n") + 1)))
    return able.select("node", "n", "sig").mapInArrow(run, "key long, node long, n long")


def _list_pairs(percent: int):
    """Pairs within runs of equal keys, for partitions sorted by key; the last run of a batch may go on in the next."""
    def pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray) -> np.ndarray:
        found, left, lag = [np.empty((0, 2), np.int64)], np.arange(len(key)), 1
        while len(left):
            left = left[left + lag < len(key)]
            left = left[key[left] == key[left + lag]]
            x, y = left, left + lag
            fits = (node[x] != node[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            a, b = node[x[fits]], node[y[fits]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            lag += 1
        return np.unique(np.concatenate(found), axis=0)

    def run(batches: Batches) -> Batches:
        rest = [np.empty(0, np.int64)] * 3
        for batch in batches:
            rest = [np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, ("key", "node", "n"))]
            cut = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
            both = pairs(*(r[:cut] for r in rest))
            rest = [r[cut:] for r in rest]
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
        both = pairs(*rest)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def candidates(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``a, b`` of the short lists, and ``key, node`` of the long ones."""
    lists = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    long = small_side(materialize(lists.where(F.col("m") > LIST).select("key"), "hamming-long"))
    short = rows.join(long, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    pairs = materialize(short.mapInArrow(_list_pairs(percent), "a long, b long").distinct(), "hamming-pairs")
    return pairs, materialize(rows.join(long, "key", "left_semi").select("key", "node"), "hamming-members")


def within_radius(pairs: DataFrame, sets: DataFrame, radius: int) -> DataFrame:
    """The pairs whose signatures differ in ``radius`` symbols or fewer."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                apart = (_rows_of(batch.column("x")) != _rows_of(batch.column("y"))).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(apart <= radius))

    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b"))
    return both.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by their full sets."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b"))
    return both.mapInArrow(run, "a long, b long")


def links_of(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` between nodes that connect all nodes which links connect.

    Where documents have :data:`MANY` pairs each, sets are moved for few of them only: first for one pair of each node, then for those
    between components that these leave apart.
    """
    rows = materialize(postings(nodes, percent), "hamming-postings")
    pairs, members = candidates(rows, percent)
    near = materialize(within_radius(pairs, nodes, radius_of(percent)), "hamming-near")
    sets = sets_of(docs, nodes.withColumnRenamed("id", "doc_id"), near, members, width)
    number, paired = near.agg(F.count(F.lit(1)), F.count_distinct("b")).first()  # two numbers
    if number <= MANY * paired:
        links = materialize(_confirmed(near, sets, percent), "hamming-links")
    else:
        first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        links = materialize(_confirmed(first, sets, percent), "hamming-first")
        labels = materialize(connected(links, "a", "b"), "hamming-labels")
        side = small_side(labels)
        apart = (near.join(side.withColumnsRenamed({"id": "a", "label": "la"}), "a", "left")
                 .join(side.withColumnsRenamed({"id": "b", "label": "lb"}), "b", "left")
                 .where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"))
        apart = materialize(apart.join(first, ["a", "b"], "left_anti"), "hamming-apart")
        links = materialize(links.union(_confirmed(apart, sets, percent)), "hamming-links")
    return with_long_lists(links, members, sets, percent, shared_pivots=True)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept`` (the document is that one).

    Two documents link when their shingle sets have a similarity of ``percent`` / 100 or more. Words stand between ASCII
    white space, A-Z in lower case; a text of fewer than ``width`` words is one shingle. Null texts and texts without words have an empty
    set and are linked with nothing, so each is its own component and kept. Equal sets of one shingle or more are linked. Rows
    with equal ids are answered each; rows without an id take part, and a component of rows without any id is null and kept. An
    empty table gives no rows. Other columns are not read, so their names cannot clash. Very long texts are hashed whole, in
    blocks. Shingles and sets are compared by 64-bit hashes.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(signed(docs, width), "hamming-signed")
    nodes = materialize(rows.where("n > 0").groupBy("node").agg(
        F.max("n").alias("n"), F.max("sig").alias("sig"), F.min("doc_id").alias("id")), "hamming-nodes")
    links = links_of(docs, nodes, width, percent)
    labels = connected(links, "a", "b").withColumnRenamed("id", "node")
    classes = nodes.select("node", "id").join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    classes = materialize(classes, "hamming-classes")
    least = materialize(classes.groupBy("label").agg(F.min("id").alias("component")), "hamming-least")
    known = materialize(classes.join(small_side(least), "label").select("node", "component"), "hamming-known")
    found = rows.join(small_side(known), "node", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))
