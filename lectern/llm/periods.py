"""Periodic runs in texts: stretches of words that repeat with a smallest period, found by minimizers on several scales.

A run of period q holds :data:`COPIES` periods or more. Its period lies on one scale, 2^k <= q < 2^(k+1). On that scale grams
of 2^(k+1) - 1 words are hashed, and the least hash of every 2^k neighbouring grams is selected. A gram is no shorter than the
period, so inside the run it occurs at multiples of q only; and windows a period apart hold the same grams, so both select
theirs. Of each run, therefore, two neighbours among the equal selected grams lie exactly q apart. Every such pair is extended
word by word both ways, which proves the run and gives its ends. Periods below :data:`SHORT`, for which grams tell
nothing, are found by comparing the words directly at that lag.

Texts are independent of each other, so nothing is shuffled. A task holds the words of :data:`CHUNK_WORDS` or of one text at a time, and
the work is n log^2 n in the words of a text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.shingles import mixed

#: Least words of a run, and least periods in it; grams and windows rely on four.
LEAST, COPIES = 6, 4
#: Periods below this are found by direct scans; a power of two.
SHORT = 8
#: Words that are searched together, of one text or of many.
CHUNK_WORDS = 100_000
#: Fixed value: an odd base of the gram hashes.
BASE = 0x9E3779B97F4A7C15

Batches = Iterator[pa.RecordBatch]
RUNS = "array<struct<start:long,length:long,period:long>>"
RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _stretches(x: np.ndarray, q: int) -> np.ndarray:
    """Start, length and ``q`` of every longest stretch of ``x`` with words ``q`` apart equal, if it is long enough."""
    edges = np.diff(np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]]))
    start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    length = stop - start + q
    keep = length >= max(LEAST, COPIES * q)
    return np.stack([start[keep], length[keep], np.full(int(keep.sum()), q)], axis=1)


def _selected(x: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are the first least one of some ``window`` grams."""
    value = mixed(x.astype(np.uint64) + np.uint64(BASE))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(x), BASE, np.uint64))
        back = np.cumprod(np.full(len(x), pow(BASE, -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power, dtype=np.uint64)])
        hashes = mixed((sums[gram:] - sums[:-gram]) * back[:len(x) - gram + 1])
    least, reach = np.arange(len(hashes)), 1
    while reach < window and len(least) > reach:
        ahead, here = least[reach:], least[:-reach]
        least = np.where(hashes[ahead] < hashes[here], ahead, here)
        reach *= 2
    picked = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return picked, hashes[picked]


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words of ``a`` and ``b``, equally long, are equal."""
    at, step = 0, 64
    while at < len(a):
        same = a[at:at + step] == b[at:at + step]
        if not same.all():
            return at + int(np.argmin(same))
        at, step = at + step, step * 2
    return len(a)


def _extended(x: np.ndarray, at: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    """The stretches of period ``q`` around the positions ``at``, in order, each found once."""
    found, k = [], 0
    while k < len(at):
        m = int(at[k])
        right = m + _equal_ahead(x[m:len(x) - q], x[m + q:])
        left = m - _equal_ahead(x[:m][::-1], x[q:m + q][::-1])
        if right - left + q >= max(LEAST, COPIES * q):
            found.append((left, right - left + q, q))
        k = max(k + 1, int(np.searchsorted(at, right)))
    return found


def _on_scale(x: np.ndarray, low: int) -> np.ndarray:
    """Stretches with a period from ``low`` to below ``2 * low``."""
    gram = 2 * low - 1
    if len(x) < gram + low:
        return np.empty((0, 3), np.int64)
    picked, hashes = _selected(x, gram, low)
    order = np.argsort(hashes, kind="stable")
    place, value = picked[order], hashes[order]
    lag = place[1:] - place[:-1]
    pair = (value[1:] == value[:-1]) & (lag >= low) & (lag < 2 * low)
    place, lag = place[:-1][pair], lag[pair]
    found = [r for q in np.unique(lag).tolist() for r in _extended(x, np.sort(place[lag == q]), q)]
    return np.array(found, np.int64).reshape(-1, 3)


def runs_of(texts: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Per text, given as numbers of words from 0: ``start``, ``length``, ``period`` of its runs by start, then period."""
    found, low = [], 0
    longest = max((len(t) for t in texts), default=0)
    while max(LEAST, COPIES * max(1, low)) <= longest:
        chosen = [i for i, t in enumerate(texts) if len(t) >= COPIES * max(1, low)]
        starts = np.cumsum([0] + [len(texts[i]) + 1 for i in chosen])
        x = np.concatenate([np.append(texts[i], -1 - i) for i in chosen])  # an end of its own after each text
        if low:
            runs = _on_scale(x, low)
        else:
            runs = np.concatenate([_stretches(x, q) for q in range(1, SHORT) if q < len(x)])
        text = np.searchsorted(starts, runs[:, 0], side="right") - 1
        found.append(np.column_stack([np.array(chosen, np.int64)[text], runs[:, 0] - starts[text], runs[:, 1:]]))
        low = 2 * low if low else SHORT
    rows = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # a stretch found under a multiple of its period has the same ends
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[cuts[i]:cuts[i + 1], 1:] for i in range(len(texts))]


def collapsed(words: Sequence[bytes], runs: np.ndarray) -> str:
    """The words joined by one space, without what follows the first period of any run."""
    if len(runs):
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Row of the first text, and the words of this and the next texts."""
    first, held, size = 0, [], 0
    for row, text in enumerate(texts):
        words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
        if held and size + len(words) > CHUNK_WORDS:
            yield first, held
            first, held, size = row, [], 0
        held.append(words)
        size += len(words)
    if held:
        yield first, held


def periodic_runs(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``_carry`` (the named columns), ``n_words``, ``runs`` (``start``, ``length``, ``period`` in words, by start, then
    period) and ``collapsed`` (the text with one period left of each run, words joined by one space) per row.

    Words stand between ASCII white space and are compared as they are. A run is a longest stretch of :data:`LEAST` words and
    :data:`COPIES` of its smallest period, or more. Null and empty texts have no words, no run and an empty ``collapsed``.
    Rows are independent: repeated rows are answered each, ids may be null, an empty table gives no rows. Columns that are not
    named in ``carry`` are left out, so their names cannot clash. A very long text is searched whole, in one task, by itself.
    """
    packed = docs.select(F.struct(*[F.col(c) for c in carry]).alias("_carry"), F.col(text).alias("_text"))
    schema = f"_carry {packed.schema['_carry'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for first, texts in _chunks(batch.column("_text")):
                numbers: dict[bytes, int] = {}
                ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in texts]
                runs = runs_of(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_carry").slice(first, len(texts)), pa.array([len(words) for words in texts], pa.int64()),
                     pa.array([[dict(zip(("start", "length", "period"), r)) for r in found.tolist()] for found in runs], RUNS_ARROW),
                     pa.array([collapsed(words, found) for words, found in zip(texts, runs)], pa.string())],
                    names=["_carry", "n_words", "runs", "collapsed"])

    return packed.mapInArrow(run, schema)
