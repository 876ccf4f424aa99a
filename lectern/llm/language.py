"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed character trigrams, counted over all training texts. A document is a mixture of
languages: expectation-maximisation estimates its proportions from the trigram likelihoods, and the set of languages
is the one of best penalised likelihood among the strongest one, two, ... languages. The prediction is the language of the largest
proportion, and that proportion is the score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Hashed trigrams per language; with one row of counts per language this bounds the model.
BUCKETS = 1 << 15
SMOOTHING = 0.5
ROUNDS = 20
UNKNOWN = "und"
# Odd factors that spread trigrams over the buckets.
SPREAD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))

Batches = Iterator[pa.RecordBatch]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(text: str | None) -> np.ndarray | None:
    """Buckets of all trigrams of the lower-cased text, with runs of other characters as one space; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays as the space after a word
    codes = codes[keep]
    codes = np.concatenate([[32], codes, [32] if codes[-1] != 32 else []]).astype(np.uint32)
    mixed = codes[:-2] * SPREAD[0] + codes[1:-1] * SPREAD[1] + codes[2:] * SPREAD[2]
    return (mixed ^ (mixed >> np.uint32(15))) * SPREAD[0] >> np.uint32(17)


def trigram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``bucket`` and ``n`` over all documents with a text and a language."""
    def run(batches: Batches) -> Batches:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, name in zip(batch.column("text"), batch.column("lang")):
                found = trigrams(value.as_py())
                if found is not None:
                    row = counts.setdefault(name.as_py(), np.zeros(BUCKETS, np.int64))
                    row += np.bincount(found, minlength=BUCKETS)
        for name, row in counts.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()),
                                              "bucket": pa.array(at.astype(np.int32)), "n": pa.array(row[at])})

    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages in order, and one row of trigram probabilities each: :data:`BUCKETS` numbers per language."""
    counts = trigram_counts(docs, text, lang).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.full((len(names), BUCKETS), SMOOTHING)
    rows = counts["lang"].map({name: i for i, name in enumerate(names)}).to_numpy(int)
    table[rows, counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(float)
    return names, table / table.sum(axis=1, keepdims=True)


def _fit(likelihood: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages (columns) that explain the trigrams (rows, ``weight`` times each), and the log likelihood."""
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(ROUNDS):
        part = likelihood * share
        new = weight @ (part / part.sum(axis=1, keepdims=True)) / weight.sum()
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(weight @ np.log(likelihood @ share))


def mixture(found: np.ndarray, model: np.ndarray) -> dict[int, float]:
    """Proportions of the selected languages of one document.

    Languages come in the order of their proportions when all take part; a further one is accepted while it raises the
    log likelihood by more than half the logarithm of the number of trigrams.
    """
    buckets, weight = np.unique(found, return_counts=True)
    likelihood = model[:, buckets].T
    share, _ = _fit(likelihood, weight)
    order = np.argsort(-share, kind="stable")
    chosen, best, value = order[:1], np.ones(1), float(weight @ np.log(likelihood[:, order[0]]))
    for k in range(2, len(order) + 1):
        proportions, now = _fit(likelihood[:, order[:k]], weight)
        if now - value <= 0.5 * np.log(len(found)):
            break
        chosen, best, value = order[:k], proportions, now
    return {int(i): float(p) for i, p in zip(chosen, best)}


def predict(docs: DataFrame, model: tuple[Sequence[str], np.ndarray], text: str = "text",
            carry: Sequence[str | Column] = ("doc_id",)) -> DataFrame:
    """``_carry``, ``lang_pred``, ``score`` and ``languages`` (the mixture, largest first) per document.

    Only the text is looked at, and all of it. Without a letter, or null, or if the model knows no language, the prediction is
    ``und`` with score 0. Ties go to the first language by name. Equal rows are predicted alike and all returned.
    """
    names, table = model
    known = docs.sparkSession.sparkContext.broadcast((list(names), table))
    packed = docs.select(F.struct(*[F.col(c) if isinstance(c, str) else c for c in carry]).alias("_carry"),
                         F.col(text).alias("_text"))
    parts = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Batches) -> Batches:
        langs, probabilities = known.value
        for batch in batches:
            rows = []
            for value in batch.column("_text"):
                found = trigrams(value.as_py()) if langs else None
                shares = mixture(found, probabilities) if found is not None else {}
                rows.append(sorted(((langs[i], p) for i, p in shares.items()), key=lambda r: (-r[1], r[0])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_carry"), pa.array([r[0][0] if r else UNKNOWN for r in rows], pa.string()),
                 pa.array([min(1.0, r[0][1]) if r else 0.0 for r in rows], pa.float64()),
                 pa.array([[{"lang": name, "share": p} for name, p in r] for r in rows], parts)],
                names=["_carry", "lang_pred", "score", "languages"])

    carried = packed.schema["_carry"].dataType.simpleString()
    return packed.mapInArrow(
        run, f"_carry {carried}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
