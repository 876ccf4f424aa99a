"""Cross-entropy difference against plain counting."""

import math
import random
from collections import Counter

import pytest
from awkward import frame, texts
from pyspark.sql import functions as F

from lectern.llm.scoring import WEIGHT, score, tokens
from lectern.llm.shingles import WordHashes


def brute(rows):
    """(doc_id, text, is_target) -> score, with each document's own occurrences left out."""
    memo = WordHashes()
    docs = [(d, tokens(t, memo).tolist(), bool(g)) for d, t, g in rows]
    pairs, words, before = ([Counter(), Counter()] for _ in range(3))
    for _, t, good in docs:
        for model in (0, 1) if good else (0,):
            pairs[model].update(zip(t, t[1:]))
            words[model].update(t[1:])
            before[model].update(t[:-1])
    total = [sum(w.values()) for w in words]
    out = []
    for d, t, good in docs:
        own, sums = Counter(zip(t, t[1:])), 0.0
        for (v, w), n in own.items():
            p = []
            for model in (0, 1):
                k = n if model == 0 or good else 0
                single = (words[model][w] + 1) / (total[model] + len(words[0]))
                p.append((pairs[model][v, w] - k + WEIGHT * single) / (before[model][v] - k + WEIGHT))
            sums += n * (math.log(p[0]) - math.log(p[1]))
        out.append((d, len(t) - 1, sums / (len(t) - 1) if len(t) > 1 else None))
    return out


def run(spark, rows):
    docs = frame(spark, [(d, t, None, None) for d, t, _ in rows]).drop("is_target")
    flags = spark.createDataFrame([(d, g) for d, _, g in rows if d is not None], "doc_id long, is_target boolean").distinct()
    return [tuple(r) for r in score(docs.join(flags, "doc_id", "left")).select("doc_id", "n_tokens", "score").collect()]


def same(got, want):
    assert len(got) == len(want)
    order = lambda r: (str(r[0]), r[1], -1e9 if r[2] is None else round(r[2], 6))
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None)
        assert a[2] is None or a[2] == pytest.approx(b[2], abs=1e-9)


def test_against_plain_counts(spark):
    rows = [(i, " ".join(f"w{(i * k * k + k) % (7 + i % 5)}" for k in range(5 + i)), i % 3 == 0) for i in range(60)]
    same(run(spark, rows), brute(rows))


def test_target_like_documents_score_lower(spark):
    good = [(i, "the cat sat on the mat and the dog lay by the door " * 3, True) for i in range(10)]
    bad = [(100 + i, "buy cheap pills online now best price click here " * 3, False) for i in range(10)]
    new = [(200, "the dog sat on the mat by the door", False), (201, "click here buy pills now", False)]
    got = {d: s for d, _, s in run(spark, good + bad + new)}
    assert got[200] < 0 < got[201] and max(got[i] for i in range(10)) < min(got[100 + i] for i in range(10))


def test_awkward_rows(spark):
    rows = [(d, t, None if d is None else d % 2 == 0) for d, t, *_ in texts() if d not in (10, 13)]
    same(run(spark, rows), brute(rows))
    repeated = [(1, "a b c a b", False)] * 3 + [(2, "a b", True)]
    same(run(spark, repeated), brute(repeated))
    assert run(spark, []) == []
    assert all(s is None or math.isfinite(s) for _, _, s in run(spark, [(1, "a b", False), (2, None, None)]))


def test_rare_words_are_counted_one_by_one(spark):
    """Rare words by shuffle instead of by table, in all places of a bigram, give the scores of plain counts."""
    rng = random.Random(5)
    word = lambda: f"w{int(rng.random() ** 3 * 300)}"
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 80))), i % 4 == 0) for i in range(80)]
    for known, frequent in ((0, 0), (20, 5), (60, 200)):
        docs = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean").repartition(3)
        got = score(docs, known=known, frequent=frequent).select("doc_id", "n_tokens", "score").collect()
        same([tuple(r) for r in got], brute(rows))


def test_words_are_not_folded():
    memo = WordHashes()
    words = [f"word{i}" for i in range(300_000)]
    assert len(set(tokens(" ".join(words), memo).tolist())) == len(words) + 1


def test_scores_over_many_words(spark):
    rows = [(i, " ".join(f"word{i * 10_000 + k}" for k in range(10_000)), i % 3 == 0) for i in range(30)]
    plain, seen, total = brute_words(rows), 300_000, [300_000, 100_000]
    got = {d: s for d, _, s in run(spark, rows)}
    for d, text, good in rows:
        want = 0.0
        for k, w in enumerate(text.split()):  # every bigram is here only, so without its own counts none is left
            v = [0, 0] if k else [29, 9 if good else 10]
            p = [WEIGHT * (plain[m].get(w, 0) + 1) / (total[m] + seen) / (v[m] + WEIGHT) for m in (0, 1)]
            want += math.log(p[0]) - math.log(p[1])
        assert got[d] == pytest.approx(want / 10_000, abs=1e-9)


def brute_words(rows):
    return [Counter(w for _, t, g in rows if g or not m for w in t.split()) for m in (0, 1)]


def test_rows_meet_without_windows_over_any_batches(spark):
    """A key's rows may be dealt over batches of any size; they are summed in order of the keys, not by windows."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.random() ** 2 * 40)}" for _ in range(rng.randint(0, 60))), i % 3 == 0) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean").repartition(3)
    for size in (1, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            for known in (0, 10):
                got = score(docs, known=known, frequent=0).select("doc_id", "n_tokens", "score")
                assert "Window" not in got._jdf.queryExecution().toString()
                same([tuple(r) for r in got.collect()], brute(rows))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
