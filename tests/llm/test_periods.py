"""Periodic runs against a search of every lag, and on awkward rows."""

import random

import numpy as np

from awkward import CLASHING, frame
from lectern.llm.periods import periodic_runs, runs_of


def brute(words):
    """All runs, by scanning every lag and asking for the smallest period of each stretch."""
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def numbered(words):
    ids = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)


def repeated(rng, letters, most):
    """A text of unique words around stretches that repeat, some of them inside each other."""
    words = []
    for _ in range(rng.randint(1, 4)):
        words += [rng.choice(letters) for _ in range(rng.randint(0, 12))]
        unit = [rng.choice(letters) for _ in range(rng.randint(1, most))]
        if rng.random() < 0.3:
            unit = unit[:3] * rng.randint(2, 6) + unit
        words += (unit * 8)[:rng.randint(len(unit), 7 * len(unit))]
    return words


def test_runs_equal_a_search_of_all_lags():
    rng = random.Random(5)
    texts = [[rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(300)]
    texts += [repeated(rng, letters, most) for letters in ("ab", "abc", "abcdefghijkl") for most in (4, 30, 70) for _ in range(60)]
    texts += [["x"] * n for n in range(0, 70)] + [(["x"] * 7 + ["y"]) * 40, ["a", "b"] * 500 + ["c"] + ["b", "a"] * 500]
    got = runs_of([numbered(t) for t in texts])
    for text, runs in zip(texts, got):
        assert [tuple(r) for r in runs.tolist()] == brute(text), text


def test_thue_morse_words_have_no_runs_and_long_periods_are_found():
    word = [bin(i).count("1") & 1 for i in range(4096)]
    assert len(runs_of([np.array(word)])[0]) == 0
    rng = random.Random(6)
    unit = [rng.randrange(10 ** 6) for _ in range(5000)]
    text = np.array([7, 8, 9] + unit * 4 + unit[:10] + [1, 2])
    assert runs_of([text])[0].tolist() == [[3, 20010, 5000]]


def test_collapse_keeps_one_period(spark):
    text = "start " + "la la la la la la " + "one two three " * 5 + "one end"
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(1, 6, 1), (7, 16, 3)]
    assert row.collapsed == "start la one two three end"


def test_awkward_rows(spark):
    docs = frame(spark)
    rows = periodic_runs(docs, carry=["doc_id", *CLASHING]).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        if r._carry.doc_id in (1, 2, 3):
            assert (r.n_words, r.runs, r.collapsed) == (0, [], "")
        if r._carry.doc_id in (8, 9):  # 9,000 words, three times and a third: no run, but read whole
            assert r.n_words == len(texts[r._carry.doc_id].split()) and r.runs == []
        if r._carry.doc_id == 12:
            assert [tuple(x) for x in r.runs] == [(0, 40, 1)] and r.collapsed == "É"
        assert r._carry.node == "node"
    assert periodic_runs(docs.limit(0)).count() == 0
