"""Language-model scoring by cross-entropy difference.

Two bigram models over one vocabulary, a target model (good documents) and a background model (all documents), give each token two
losses; a document's score is the mean of target loss minus background loss, so lower is closer to the target.
The vocabulary is all words, as hashes of 61 bits, the same for both models; it grows with the corpus, as bigrams do.

The counts of the :data:`KNOWN` most frequent words are in a table in every task, which numbers these words; the others are
rare, so that all tokens of one fit a task. Bigrams of two of the :data:`FREQUENT` most frequent words would each fill a task of
their own. They are counted within tasks, at most ``FREQUENT`` squared of them, and scored from that table where the text is.
Of all other bigrams each document has one row per sum that isn't known to every task, shuffled once by what it is about: the
bigram, if both words are known; its first word, if that is rare; its second word, if that is rare. The rows are counted and
scored where they meet, in order of their keys; a task holds those of one key at once.

Both models interpolate bigrams with single words: p(w | v) = (c(v w) + m p(w)) / (c(v) + m), p(w) = (c(w) + 1) / (N + V).
V is the number of different words.
A document doesn't speak for itself: its own occurrences of v w are left out of c(v w) and c(v), in the background always and in the
target if it is a target document. Otherwise every target document would look like the target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import materialize
from lectern.llm.shingles import FACTORS, WordHashes, word_hashes

#: At most so many of the most frequent words have their counts in a table in every task. This changes cost, never the result.
KNOWN_BITS = 18
KNOWN = 1 << KNOWN_BITS
#: Bits of a word's hash. 0 is the start of a text. Above them, the key of a row says what it is about.
BITS = 61
PAIR, FIRST, SECOND, READY = range(4)
#: So many of the most frequent words have the counts of their bigrams with each other in a table in every task.
FREQUENT = 1024
#: Weight m of the single words against the counts of a bigram's first word.
WEIGHT = 200.0
#: Tokens that a task gathers before it hands on their counts.
GATHERED = 400_000
#: Documents whose bigrams are in memory at once.
SLICE = 250

Batches = Iterator[pa.RecordBatch]


def tokens(text: str | None, memo: WordHashes) -> np.ndarray:
    """Hashes of the words of a text, with the start in front."""
    hashes = (word_hashes(text, memo) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([[np.int64(0)], np.maximum(hashes, 1)])


def _places(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of ``words`` in a sorted table, -1 for those that aren't in it. The table has the start at least."""
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return np.where(table[at] == words, at, -1)


def _pair_counts(docs: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """Counts in target and background of all bigrams of two frequent words, as two rows of a square table each."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Batches) -> Batches:
        memo, frequent = WordHashes(), known.value
        side = len(frequent)
        counts, gathered, size = np.zeros(2 * side ** 2, np.int64), [], 0  # other documents, then those of the target
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                good = part.column("is_target").to_numpy(zero_copy_only=False)
                held = [tokens(t.as_py(), memo) for t in part.column("text")]
                lengths = np.array([len(t) for t in held])
                at = _places(np.concatenate(held), frequent)
                inside = np.ones(len(at), dtype=bool)
                inside[np.cumsum(lengths)[:-1]] = False  # the start has none before it
                both = inside[1:] & (at[:-1] >= 0) & (at[1:] >= 0)
                flag = np.repeat(good, lengths)[1:][both]
                gathered.append((flag * side + at[:-1][both]) * side + at[1:][both])
                size += len(gathered[-1])
                if size >= GATHERED:
                    counts += np.bincount(np.concatenate(gathered), minlength=len(counts))
                    gathered, size = [], 0
        if gathered:
            counts += np.bincount(np.concatenate(gathered), minlength=len(counts))
        other, good = counts.reshape(2, -1)
        at = np.flatnonzero(other + good)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at), "t": pa.array(good[at]), "b": pa.array((other + good)[at])})

    table = docs.select("text", "is_target").mapInArrow(run, "pair long, t long, b long").groupBy("pair").agg(
        F.sum("t").alias("t"), F.sum("b").alias("b")).toPandas()  # FREQUENT squared rows and a few at most
    out = np.zeros((2, len(frequent) ** 2))
    out[:, table["pair"].to_numpy(int)] = table[["t", "b"]].to_numpy(float).T
    return out


def _word_counts(docs: DataFrame) -> DataFrame:
    """``word``, ``w_target`` and ``w_all`` (its tokens), ``v_target`` and ``v_all`` (tokens right after it)."""
    def run(batches: Batches) -> Batches:
        memo, held = WordHashes(), []

        def counted() -> pa.RecordBatch:
            size = [len(t) for t, _ in held]
            words, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            good = np.repeat(np.array([g for _, g in held]), size)
            ends = np.cumsum(size)
            second, first = np.ones(len(at), dtype=bool), np.ones(len(at), dtype=bool)
            second[ends - size], first[ends - 1] = False, False  # the start is no token, nothing follows the last word
            counts = [np.bincount(at[m], minlength=len(words)) for m in (second & good, second, first & good, first)]
            held.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(words), **{f"c{r}": pa.array(c) for r, c in enumerate(counts)}})

        size = 0
        for batch in batches:
            for text, good in zip(batch.column("text"), batch.column("is_target")):
                held.append((tokens(text.as_py(), memo), good.as_py()))
                size += len(held[-1][0])
                if size >= GATHERED:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    names = ("w_target", "w_all", "v_target", "v_all")
    found = docs.select("text", "is_target").mapInArrow(run, "word long, c0 long, c1 long, c2 long, c3 long")
    return materialize(found.groupBy("word").agg(*[F.sum(f"c{r}").alias(n) for r, n in enumerate(names)]), "word-counts")


def _known_words(words: DataFrame, known: int) -> pd.DataFrame:
    """The rows of at most ``known`` frequent words and of the start, by word.

    They are those above a number of tokens, found from a histogram of a fixed number of steps, 16 to an octave.
    """
    step = F.floor(16 * F.log2("w_all")).cast("int")
    tally = sorted(words.where("w_all > 0").groupBy(step.alias("step")).count().collect(), reverse=True)
    most, least = 0, 16 * 64
    for s, n in tally:
        most += n
        if most > known:
            break
        least = s
    return words.where((F.col("word") == 0) | ((F.col("w_all") > 0) & (step >= least))).toPandas().sort_values("word")


def _meeting(shared: Broadcast, sizes: tuple[int, int], weight: float) -> Callable[[Batches], Batches]:
    """``a``, ``total`` and ``n`` (tokens, once a document): what the rows of a key add to the scores, for partitions sorted by ``key``
    and ``other``. The rows of one key are in memory at once; ``shared`` has the single words' part of known second words."""
    names = ("a", "key", "other", "packed", "total")

    def scored(c: list[np.ndarray]) -> pa.RecordBatch:
        a, key, other, packed, total = c
        kind = (key.view(np.uint64) >> np.uint64(BITS)).astype(np.int8)
        ready = kind == READY
        n = np.where(ready, 0, packed >> 1)
        own = (n * (packed & 1), n)
        changed = key[1:] != key[:-1]
        met = np.flatnonzero(np.concatenate([[True], changed]))
        pair = np.flatnonzero(np.concatenate([[True], changed | (other[1:] != other[:-1])]))
        in_met, in_pair = (np.repeat(np.arange(len(x)), np.diff(np.append(x, len(key)))) for x in (met, pair))
        word = np.where(kind == PAIR, key & (KNOWN - 1), np.where(kind == FIRST, np.maximum(other, 0), 0))
        top, low = [], []
        for m in (0, 1):
            around = np.add.reduceat(own[m], met)[in_met]
            p = np.where(kind == SECOND, weight * (around + 1) / sizes[m], shared.value[m][word])
            top.append(np.add.reduceat(own[m], pair)[in_pair] - own[m] + p)
            low.append(around - own[m] + weight)
        found = np.where((kind == FIRST) & (other < 0), 0.0, np.log(top[1] / top[0]))
        first = kind == FIRST
        found[first] += np.log(low[0][first] / low[1][first])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.where(ready, total, n * found)),
                                           pa.array(np.where(ready, packed, 0).astype(np.int32))], names=["a", "total", "n"])

    def run(batches: Batches) -> Batches:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            c = [batch.column(k).to_numpy() for k in names]
            if not batch.num_rows:
                continue
            cut = int(np.searchsorted(c[1], c[1][-1]))
            if held and (cut or held[-1][1][-1] != c[1][0]):  # the key that the last batch ended with ends here
                held.append([x[:cut] for x in c])
                yield scored([np.concatenate(x) for x in zip(*held)])
                held = []
            elif cut:
                yield scored([x[:cut] for x in c])
            held.append([x[cut:] for x in c])
        if held:
            yield scored([np.concatenate(x) for x in zip(*held)])

    return run


def score(docs: DataFrame, text: str = "text", target: str = "is_target", doc_id: str = "doc_id",
          weight: float = WEIGHT, known: int = KNOWN, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``is_target`` and ``score`` per document, lower being closer to the target.

    The score is the mean over all tokens of the whole text. Documents without words, or of null text, have no tokens and a null
    score. A null target flag is not target. Rows are scored each, equal rows alike. Without any target document its model is
    uniform. An empty table gives no rows. ``known`` (:data:`KNOWN` at most) and ``frequent`` change cost, never the result.
    """
    packed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                         F.coalesce(F.col(target), F.lit(False)).alias("is_target"))
    words = _word_counts(packed)
    n_target, n_all, different = (x or 0 for x in words.agg(
        F.sum("w_target"), F.sum("w_all"), F.count_if(F.col("w_all") > 0)).first())  # three numbers
    vocabulary = max(different, 1)
    top = _known_words(words, min(known, KNOWN - 1))
    if not len(top):
        top = pd.DataFrame({c: [0] for c in words.columns})  # no documents
    table = top["word"].to_numpy(np.int64)
    often = np.sort(np.union1d(top.sort_values(["w_all", "word"], ascending=[False, True])["word"].head(frequent), [0]).astype(np.int64))
    pairs = _pair_counts(packed, often)
    rank = _places(table, often)
    single = [weight * (top[w].to_numpy(float) + 1) / (n + vocabulary) for w, n in (("w_target", n_target), ("w_all", n_all))]
    before = [top[v].to_numpy(float) for v in ("v_target", "v_all")]
    shared = packed.sparkSession.sparkContext.broadcast((table, rank, pairs, len(often), single, before))

    def run(batches: Batches) -> Batches:
        memo = WordHashes()
        table, rank, pairs, side, single, before = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                good = part.column("is_target").to_numpy(zero_copy_only=False).astype(np.int64)
                held = [tokens(t.as_py(), memo) for t in part.column("text")]
                every = np.concatenate(held)
                places, begin = _places(every, table), 0
                told = every[:-1].view(np.uint64) * FACTORS[0] + every[1:].view(np.uint64) * FACTORS[1]
                firsts, times = [], []
                for t in held:  # a document's different bigrams; the number that tells them apart is for this document only
                    _, at, n = np.unique(told[begin:begin + len(t) - 1], return_index=True, return_counts=True)
                    firsts.append(at + begin)
                    times.append(n)
                    begin += len(t)
                row = np.repeat(np.arange(len(held)), [len(n) for n in times])
                first, n = np.concatenate(firsts), np.concatenate(times)
                v, w, v_at, w_at, own_good = every[first], every[first + 1], places[first], places[first + 1], n * good[row]
                own = (own_good, n)
                total = np.zeros(len(n))
                has_v = v_at >= 0  # the divisor of such a bigram is known here
                ratio = [before[m][v_at[has_v]] - own[m][has_v] + weight for m in (0, 1)]
                total[has_v] = np.log(ratio[0]) - np.log(ratio[1])
                both = has_v & (w_at >= 0)
                often = both.copy()
                often[both] = (rank[v_at[both]] >= 0) & (rank[w_at[both]] >= 0)
                pair = rank[v_at[often]] * side + rank[w_at[often]]
                p = [pairs[m][pair] - own[m][often] + single[m][w_at[often]] for m in (0, 1)]
                total[often] += np.log(p[1]) - np.log(p[0])
                total = np.bincount(row, total * n, len(held))
                pick = [np.flatnonzero(both & ~often), np.flatnonzero(~has_v), np.flatnonzero(w_at < 0)]
                # beside the word of the key: the number of a known second word, -1 for a rare one; the first word's hash
                keys = [v_at[pick[0]] << KNOWN_BITS | w_at[pick[0]], v[pick[1]] | FIRST << BITS,
                        (w[pick[2]].view(np.uint64) | np.uint64(SECOND << BITS)).view(np.int64)]
                other = [np.zeros(len(pick[0]), np.int64), np.where(w_at >= 0, w_at, -1)[pick[1]], v[pick[2]]]
                own_key = part.column("a").to_numpy().view(np.uint64) >> np.uint64(64 - BITS) | np.uint64(READY << BITS)
                chosen = np.concatenate(pick)
                at = pa.array(np.concatenate([row[chosen], np.arange(len(held))]))
                packed_n = np.concatenate([n[chosen] * 2 + good[row[chosen]], [len(t) - 1 for t in held]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").take(at), pa.array(np.concatenate([*keys, own_key.view(np.int64)])),
                     pa.array(np.concatenate([*other, np.zeros(len(held), np.int64)])), pa.array(packed_n),
                     pa.array(np.concatenate([np.zeros(len(chosen)), total]))], names=["a", "key", "other", "packed", "total"])

    keyed = packed.select(F.xxhash64("doc_id", "text").alias("a"), "text", "doc_id", "is_target")
    rows = keyed.select("a", "is_target", "text").mapInArrow(run, "a long, key long, other long, packed long, total double")
    scored = (rows.repartition("key").sortWithinPartitions("key", "other")
              .mapInArrow(_meeting(packed.sparkSession.sparkContext.broadcast(single), (n_target + vocabulary, n_all + vocabulary), weight),
                          "a long, total double, n int"))
    sums = scored.groupBy("a").agg(F.sum("total").alias("total"), F.sum("n").alias("n_tokens"))
    every = keyed.select("a", "doc_id", "is_target")
    copies = every.groupBy("a").agg(F.count(F.lit(1)).alias("copies"))  # equal rows have added up
    per_row = copies.join(sums, "a", "left").select(
        "a", F.coalesce((F.col("n_tokens") / F.col("copies")).cast("long"), F.lit(0)).alias("n_tokens"),
        F.try_divide("total", "n_tokens").alias("score"))
    return every.join(per_row, "a").select("doc_id", "n_tokens", "is_target", "score")
