"""The Hamming join of signatures: its guarantee, against all pairs, on groups of near copies and awkward rows."""

import random

import numpy as np
import pytest

from awkward import frame
from lectern.llm import components, hamming, jaccard
from lectern.llm.hamming import SYMBOLS, allowances, choices, keys_of, near_duplicates, radius_of, signature
from test_jaccard import brute, near_copies


def result(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], "doc_id long, text string, node string, sig string, key int")
    return sorted((tuple(r) for r in near_duplicates(df.repartition(3), **options).collect()), key=repr)


def expected(rows, width, percent):
    return sorted(((d, n, c if n else d, d == (c if n else d)) for d, n, c in brute(rows, width, percent)), key=repr)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_every_pair_within_the_radius_shares_a_key(percent):
    radius, rng = radius_of(percent), np.random.default_rng(percent)
    assert sum(t + 1 for t in allowances(radius)) == radius + 1
    chosen = choices(radius)
    x = rng.integers(0, 1 << 16, (2000, SYMBOLS)).astype(np.uint16)
    y = x.copy()
    for row in y:  # as many errors as allowed: at random, or spread evenly over the chunks
        at = rng.permutation(SYMBOLS)[:radius] if rng.random() < 0.5 else (
            (np.arange(radius) * 4 + np.arange(radius) // 32) % SYMBOLS)
        row[at] += 1
    assert (keys_of(x, chosen) == keys_of(y, chosen)).any(axis=1).all()


def test_signatures_differ_as_sets_do():
    rng = np.random.default_rng(1)
    for both in (100, 400, 850):
        apart = []
        for _ in range(60):
            values = rng.integers(0, 1 << 63, 1000 + (1000 - both)).astype(np.uint64)
            apart.append((signature(values[:1000]) != signature(values[1000 - both:])).mean())
        assert abs(np.mean(apart) - (1 - both / (2000 - both))) < 0.02
    values = rng.integers(0, 1 << 63, 3 * hamming.BLOCK + 5).astype(np.uint64)
    assert (signature(values) == signature(values[::-1])).all()


def test_groups_of_near_copies_equal_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, doc = [], 1000
    for size, most in ((3, 2), (12, 6), (60, 3), (150, 9)):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 120))]
        for text in near_copies(rng, base, size, most):
            rows.append((doc := doc - 1, text))
    chain = [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(15):  # each links to the next one only
        chain = chain[3:] + [rng.choice(vocabulary) for _ in range(3)]
        rows.append((doc := doc - 1, " ".join(chain)))
    rows += [(doc - 1 - i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(150)]
    rng.shuffle(rows)
    for width, percent in ((3, 85), (5, 80)):
        assert result(spark, rows, width=width, percent=percent) == expected(rows, width, percent)


def test_awkward_rows(spark):
    docs = frame(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in near_duplicates(docs, width=3, percent=85).collect()), key=repr)
    assert [r[:3] for r in got] == [(d, n, c if n else d) for d, n, c in brute(rows, 3, 85)]
    assert all(kept == (d == c) for d, _, c, kept in got)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_shingles_are_counted_in_pivots_only(spark, monkeypatch):
    rng, counts = random.Random(4), {}
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []
    for copies in (150, 90):
        base = [rng.choice(vocabulary) for _ in range(100)]
        rows += [" ".join(base), *near_copies(rng, base, copies, 3)]
    rows = list(enumerate(rows))
    often, listed = jaccard._held_often, jaccard._listed

    def held_often(held, least):
        counts["counted"] = held.count()
        return often(held, least)

    def lists(members):
        counts["members"] = members.select("node").distinct().count()
        return listed(members)

    monkeypatch.setattr(jaccard, "_held_often", held_often)
    monkeypatch.setattr(jaccard, "_listed", lists)
    assert result(spark, rows, width=3, percent=85) == expected(rows, 3, 85)
    assert counts["members"] > 150 and counts["counted"] < counts["members"] / 10


def test_stars_take_no_round(spark, monkeypatch):
    made, store = [], components.materialize

    def materialize(df, name):
        made.append(name)
        return store(df, name)

    monkeypatch.setattr(components, "materialize", materialize)
    links = spark.createDataFrame([(9, 1), (5, 1), (1, 7), (8, 2)], "a long, b long")
    assert sorted(map(tuple, components.connected(links, "a", "b").collect())) == [(1, 1), (2, 2), (5, 1), (7, 1), (8, 2), (9, 1)]
    assert made == ["edges"]
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (31, 31), (32, 31)], "a long, b long")
    got = sorted(map(tuple, components.connected(chain, "a", "b").collect()))
    assert got == [(k, 0) for k in range(21)] + [(k, 30) for k in range(30, 33)] and len(made) > 2
    assert components.connected(links.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("many", [0, 1000])
def test_few_and_many_pairs_give_the_same(spark, monkeypatch, many):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(500)]
    rows = []
    for copies in (20, 8, 70):
        base = [rng.choice(vocabulary) for _ in range(90)]
        rows += [" ".join(base), *near_copies(rng, base, copies, 4)]
    rows = list(enumerate(rows))
    monkeypatch.setattr(hamming, "MANY", many)
    assert result(spark, rows, width=3, percent=85) == expected(rows, 3, 85)
