"""Line deduplication by winnowing over line hashes.

Lines are cut into units of a sentence's size: at their ends, before words with the least hash of their neighbours, and after
:data:`UNIT_WORDS` words, so that a passage has the same units, but at its ends, wherever it stands in a line. Units are hashed with the
next one; the least hash of every stretch of :data:`STRETCH_WORDS` words is a fingerprint. Equal units of so many words and one more unit
always have one in common; a passage of :data:`RUN_WORDS` words cut out of lines has so many nearly always (see the test).
Fingerprints found twice are joined to the first of their places; around both, equal words are followed both ways. Later runs of
at least :data:`RUN_WORDS` words are deleted.

The first place of a fingerprint may share less with a later one than two later ones do with each other. Where a run comes out too
short, all stretches of ``RUN_WORDS`` words around the places of that fingerprint meet their own first places.

Texts that an earlier document has as a whole are one run each and have no fingerprints of their own.

Every deleted word is in a run with an equal run at an earlier place, and the earliest place of a run is never deleted. Words around
fingerprints are compared by 32 bits each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import BROADCAST_ROWS, materialize, small_side, text_key, white_words
from lectern.llm.shingles import FACTORS, WordHashes, mixed

#: Words that a repeated run must have.
RUN_WORDS = 50
#: A unit starts at a word with the least hash of so many words on either side, and has so many words at most.
UNIT_RADIUS, UNIT_WORDS = 3, 16
#: Words of a stretch of units that has a fingerprint.
STRETCH_WORDS = 15
WORD = re.compile(r"[^\x20\x09-\x0D]+")
Batches = Iterator[pa.RecordBatch]


def line_words(text: str | None, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z in lower case), and the number of words of each line."""
    if text is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lines = [line.split() for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]
    counts = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    words = np.fromiter((memo[w] for line in lines for w in line), dtype=np.uint64, count=counts.sum())
    return words, counts


def units(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per unit: the hash of its words and the next unit's, and its first word. The last unit is hashed alone."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    opens = np.ones(n + 1, bool)
    near = np.pad(mixed(words ^ FACTORS[1]), UNIT_RADIUS, constant_values=np.uint64(2**64 - 1))
    here = near[UNIT_RADIUS:UNIT_RADIUS + n]
    for k in range(UNIT_RADIUS):
        opens[:n] &= (here < near[k:k + n]) & (here <= near[2 * UNIT_RADIUS - k:2 * UNIT_RADIUS - k + n])
    opens[0] = True
    opens[np.cumsum(counts)] = True
    opens = opens[:n]
    starts = np.flatnonzero(opens)
    since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    starts = np.flatnonzero(since % UNIT_WORDS == 0)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    one = np.add.reduceat(mixed(words + place.astype(np.uint64) * FACTORS[0]), starts)
    following = np.append(one[1:], np.uint64(0))
    return mixed(one * FACTORS[2] + following * FACTORS[3]).view(np.int64), starts


def fingerprints(hashes: np.ndarray, words: np.ndarray, run_words: int = RUN_WORDS) -> np.ndarray:
    """Positions of the smallest hash (the last of equals) in every least stretch of lines with ``run_words`` words.

    A stretch starts and ends with a line, or unit, that has words. Empty ones are never fingerprints.
    """
    full = np.flatnonzero(words)
    if not len(full):
        return full
    sums = np.concatenate([[0], np.cumsum(words[full])])
    ends = np.searchsorted(sums, sums[:-1] + run_words)  # stretch of line k: full[k] to full[ends[k] - 1]
    picked, queue, head, reached = [], [], 0, 0
    for k, end in enumerate(ends):
        if end > len(full):
            break
        while reached < end:
            value = hashes[full[reached]]
            while len(queue) > head and hashes[full[queue[-1]]] >= value:
                queue.pop()
            queue.append(reached)
            reached += 1
            head = min(head, len(queue) - 1)
        while queue[head] < k:
            head += 1
        if not picked or picked[-1] != queue[head]:
            picked.append(queue[head])
    return full[np.unique(np.array(picked, dtype=np.int64))] if picked else np.empty(0, np.int64)


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id``, ``tie`` and ``text``: the order of documents is by id (null first), then by a hash of the text."""
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("tie"),
                       F.col(text).alias("text"))


def _places(docs: DataFrame) -> DataFrame:
    """``fp``, ``id``, ``tie`` and ``at`` (number of a word) of all fingerprints."""
    def run(batches: Batches) -> Batches:
        memo = WordHashes()
        for batch in batches:
            fps, ats = [], []
            for text in batch.column("text"):
                words, counts = line_words(text.as_py(), memo)
                hashes, starts = units(words, counts)
                picked = fingerprints(hashes, np.diff(np.append(starts, len(words))), STRETCH_WORDS)
                fps.append(hashes[picked])
                ats.append(starts[picked])
            if fps:
                row = pa.array(np.repeat(np.arange(len(fps)), [len(f) for f in fps]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(fps), pa.int64()), batch.column("id").take(row), batch.column("tie").take(row),
                     pa.array(np.concatenate(ats), pa.int64())], names=["fp", "id", "tie", "at"])

    return docs.mapInArrow(run, "fp long, id long, tie long, at long")


def _surroundings(docs: DataFrame, run_words: int) -> DataFrame:
    """``fp``, ``leads``, ``id``, ``tie``, ``at``, and 32 bits of each of the ``run_words`` words before ``at`` (backwards) and from it on."""
    def run(batches: Batches) -> Batches:
        memo = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for k, (text, places) in enumerate(zip(batch.column("text"), batch.column("places"))):
                words, _ = line_words(text.as_py(), memo)
                short = words.astype(np.uint32)
                for place in places.as_py():
                    at = place["at"]
                    out.append((place["fp"], place["leads"], k, at, short[max(at - run_words, 0):at][::-1].tobytes(),
                                short[at:at + run_words].tobytes()))
            if out:
                fp, leads, row, at, back, ahead = zip(*out)
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp, pa.int64()), pa.array(leads, pa.bool_()), batch.column("id").take(row), batch.column("tie").take(row),
                     pa.array(at, pa.int64()), pa.array(back, pa.binary()), pa.array(ahead, pa.binary())],
                    names=["fp", "leads", "id", "tie", "at", "back", "ahead"])

    return docs.mapInArrow(run, "fp long, leads boolean, id long, tie long, at long, back binary, ahead binary")


def _common(one: bytes, two: bytes) -> int:
    """Number of equal words in front of both."""
    n = min(len(one), len(two)) // 4
    if one[:4 * n] == two[:4 * n]:
        return n
    return int(np.argmin(np.frombuffer(one, np.uint32, n) == np.frombuffer(two, np.uint32, n)))


def extend(back: bytes, ahead: bytes, first_back: bytes, first_ahead: bytes, apart: int | None = None) -> tuple[int, int]:
    """Equal words before two places and from them on; within one document, ``apart`` words apart, the run ends where the later begins."""
    left, right = _common(back, first_back), _common(ahead, first_ahead)
    if apart is not None:
        left = min(left, apart)
        right = min(right, apart - left)
    return left, right


def _extended(pairs: DataFrame, run_words: int) -> DataFrame:
    """``fp``, ``id``, ``tie``, ``start``, ``stop`` (words) of the run around each later place; start is null if it is too short."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            start, stop = [], []
            for at, first_at, same, *around in zip(*(batch.column(c).to_pylist() for c in (
                    "at", "first_at", "same", "back", "ahead", "first_back", "first_ahead"))):
                left, right = extend(*around, apart=at - first_at if same else None)
                long = left + right >= run_words
                start.append(at - left if long else None)
                stop.append(at + right - 1 if long else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fp", "id", "tie")), pa.array(start, pa.int64()),
                                              pa.array(stop, pa.int64())], names=["fp", "id", "tie", "start", "stop"])

    return pairs.mapInArrow(run, "fp long, id long, tie long, start long, stop long")


def _stretches(places: DataFrame, run_words: int) -> DataFrame:
    """``key``, ``id``, ``tie`` and ``start`` of all stretches of ``run_words`` words that have the place in them."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys, rows, starts = [], [], []
            for k, (at, back, ahead) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "back", "ahead")))):
                left = len(back) // 4
                held = np.frombuffer(back, np.uint32)[::-1].tobytes() + ahead
                for i in range(max(left - run_words + 1, 0), min(left, len(held) // 4 - run_words) + 1):
                    keys.append(xxhash.xxh64_intdigest(held[4 * i:4 * (i + run_words)]))
                    rows.append(k)
                    starts.append(at - left + i)
            row = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64()), batch.column("id").take(row),
                 batch.column("tie").take(row), pa.array(starts, pa.int64())], names=["key", "id", "tie", "start"])

    return places.select("id", "tie", "at", "back", "ahead").mapInArrow(run, "key long, id long, tie long, start long")


def _copies(docs: DataFrame) -> DataFrame:
    """``id``, ``tie`` and ``n`` (words) of texts that an earlier document has as a whole. No text is moved."""
    keyed = docs.select("id", "tie", text_key(F.col("text")).alias("key"), F.size(white_words(F.col("text"))).cast("long").alias("n"))
    first = materialize(keyed.groupBy("key").agg(F.min(F.struct("id")).alias("first"), F.count(F.lit(1)).alias("m"))
                        .where("m > 1").drop("m"), "line-texts")
    return keyed.join(small_side(first), "key").where(~F.col("id").eqNullSafe(F.col("first.id"))).select("id", "tie", "n").distinct()


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``id``, ``tie``, ``start`` and ``stop`` (numbers of words) of later places of repeated runs."""
    copies = materialize(_copies(docs), "line-copies")
    listed = small_side(copies).alias("c")
    docs = docs.alias("o").join(listed, F.col("o.id").eqNullSafe(F.col("c.id")) & (F.col("o.tie") == F.col("c.tie")), "left_anti")
    places = materialize(_places(docs), "line-places")
    found = materialize(places.groupBy("fp").agg(F.min(F.struct("id", "tie", "at")).alias("first"), F.count(F.lit(1)).alias("m"))
                        .where("m > 1").drop("m"), "line-firsts")
    leads = F.struct("id", "tie", "at").eqNullSafe(F.col("first"))
    held = (places.join(small_side(found), "fp").select("id", "tie", F.struct("fp", "at", leads.alias("leads")).alias("place"))
            .groupBy("id", "tie").agg(F.collect_list("place").alias("places")))  # at most the fingerprints of one text
    held = materialize(held, "line-held")
    size = held.agg(F.coalesce(F.sum(F.size("places") + 1), F.lit(0))).first()[0]  # one number
    key = F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.tie") == F.col("h.tie"))
    joined = docs.alias("d").join((F.broadcast(held) if size <= BROADCAST_ROWS else held).alias("h"), key)
    around = materialize(_surroundings(joined.select("d.id", "d.tie", "d.text", "h.places"), run_words), "line-surroundings")
    first = around.where("leads").select("fp", F.col("id").alias("first_id"), F.col("tie").alias("first_tie"),
                                         F.col("at").alias("first_at"), F.col("back").alias("first_back"),
                                         F.col("ahead").alias("first_ahead")).dropDuplicates(["fp"])
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    later = around.where(~F.col("leads")).join(first, "fp").withColumn("same", same)
    runs = materialize(_extended(later, run_words), "line-runs")
    short = materialize(runs.where("start IS NULL").select("fp").distinct(), "line-short")
    stretches = materialize(_stretches(around.join(small_side(short), "fp", "left_semi"), run_words), "line-stretches")
    again = materialize(stretches.groupBy("key").agg(F.min(F.struct("id", "tie", "start")).alias("first"), F.count(F.lit(1)).alias("m"))
                        .where("m > 1").drop("m"), "line-again")
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tie") == F.col("first.tie"))
    more = (stretches.join(small_side(again), "key").where(~own | (F.col("start") >= F.col("first.start") + run_words))
            .select("id", "tie", "start", (F.col("start") + run_words - 1).alias("stop")))
    whole = copies.where(F.col("n") >= run_words).select("id", "tie", F.lit(0).cast("long").alias("start"), (F.col("n") - 1).alias("stop"))
    return runs.where("start IS NOT NULL").select("id", "tie", "start", "stop").union(more).union(whole).distinct()


def united(spans: Sequence[dict]) -> list[dict]:
    """Spans that overlap or follow each other as one, in order."""
    out: list[dict] = []
    for r in sorted(spans, key=lambda r: r["start"]):
        if out and r["start"] <= out[-1]["stop"] + 1:
            out[-1]["stop"] = max(out[-1]["stop"], r["stop"])
        else:
            out.append(dict(r))
    return out


def without(text: str | None, gone: Sequence[dict]) -> tuple[str | None, list[int], int, list[dict]]:
    """The text without spans of words (in order, apart), the positions of lines gone as a whole, the number of lines, and the spans.

    Where a span begins or ends with fewer than :data:`UNIT_WORDS` words of a line beside whole lines, these words stay.
    """
    lines = text.split("\n") if text is not None else []
    if not gone:
        return text, [], len(lines), []
    found = [[m.span() for m in WORD.finditer(line)] for line in lines]
    ends = np.cumsum([len(f) for f in found])
    deleted, spans = np.zeros(ends[-1] + 1, bool), []
    for r in gone:
        start, stop = r["start"], r["stop"] + 1
        at, last = np.searchsorted(ends, [start, stop - 1], side="right")
        if at < last:
            opens = ends[at] - len(found[at])
            if start > opens and ends[at] - start < UNIT_WORDS:
                start = int(ends[at])
            opens = int(ends[last] - len(found[last]))
            if stop < ends[last] and stop - opens < UNIT_WORDS:
                stop = opens
        if start < stop:
            deleted[start:stop] = True
            spans.append({"start": start, "stop": stop - 1})
    left, removed = [], []
    for k, (line, words) in enumerate(zip(lines, found)):
        n = ends[k] - len(words)
        off = deleted[n:ends[k]]
        if words and off.all() or not words and 0 < n and deleted[n - 1] and deleted[n]:
            removed.append(k)
        elif off.any():
            kept = np.flatnonzero(~off)
            pieces = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1)  # the white space within them stays
            left.append(" ".join(line[words[i[0]][0]:words[i[-1]][1]] for i in pieces))
        else:
            left.append(line)
    return "\n".join(left), removed, len(lines), spans


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run_words: int = RUN_WORDS,
                carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``_carry``, ``text`` without the later repeated runs, ``n_lines``, ``n_removed`` (lines gone as a whole), ``removed_words``,
    ``runs`` (first and last position of each stretch of lines gone as a whole) and ``word_runs`` (first and last number of the
    deleted words of each run) per document. Of a line that a run has in part, the rest stays; blank lines within a run go with it.

    Documents come in the order of their ids, null first, then of a hash of their texts. Null texts stay null; empty texts and texts
    of fewer than ``run_words`` words keep all lines. Very long texts are worked on as a whole within a task. Extra columns may have any
    names; ``carry`` says which are kept. Rows equal in id and text are one document, so none is a repetition
    of the other; copies under another id are. An empty table gives no rows.
    """
    numbered = _numbered(docs, doc_id, text)
    found = repeated_runs(numbered, run_words).groupBy("id", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("_runs"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def merge(batches: Batches) -> Batches:
        for batch in batches:
            merged = [united(found) for found in batch.column("_runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), pa.array(merged, spans)],
                                             names=["id", "tie", "_runs"])

    runs = materialize(found.mapInArrow(merge, "id long, tie long, _runs array<struct<start:long,stop:long>>"), "runs")
    packed = docs.select(F.struct(*[F.col(c) for c in carry]).alias("_carry"), F.col(doc_id).cast("long").alias("_id"),
                         F.xxhash64(F.col(text)).alias("_tie"), F.col(text).alias("_text"))
    size = runs.agg(F.coalesce(F.sum(F.size("_runs") + 1), F.lit(0))).first()[0]  # one number
    joined = packed.join(F.broadcast(runs) if size <= BROADCAST_ROWS else runs, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tie") == F.col("tie")), "left")
    schema = (f"_carry {packed.schema['_carry'].dataType.simpleString()}, text string, n_lines long, n_removed long, "
              "removed_words long, runs array<struct<start:long,stop:long>>, word_runs array<struct<start:long,stop:long>>")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts, counts, merged, words = [], [], [], []
            for value, found in zip(batch.column("_text"), batch.column("_runs")):
                value, gone = value.as_py(), found.as_py() or []
                text, removed, n_lines, gone = without(value, gone)
                texts.append(text)
                counts.append((n_lines, len(removed), sum(r["stop"] + 1 - r["start"] for r in gone)))
                merged.append(united([{"start": k, "stop": k} for k in removed]))
                words.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_carry"), pa.array(texts, pa.string()),
                 *[pa.array([c[k] for c in counts], pa.int64()) for k in range(3)], pa.array(merged, spans), pa.array(words, spans)],
                names=["_carry", "text", "n_lines", "n_removed", "removed_words", "runs", "word_runs"])

    return joined.select("_carry", "_text", "_runs").mapInArrow(run, schema)
