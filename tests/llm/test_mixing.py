"""The mix: targets against step-by-step resharing, budgets met, reruns equal."""

import random

import numpy as np
import pytest
from awkward import frame, texts

from lectern.llm.mixing import fit, mix, mixed


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while rest > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / whole
        over = {s for s in free if target[s] > 3 * sizes[s]}
        rest = sum(target[s] - 3 * sizes[s] for s in over)
        for s in over:
            target[s] = 3.0 * sizes[s]
        free -= over
    return target


def table(spark, rows, partitions=3):
    got = mix(frame(spark, rows, partitions), carry=["doc_id", "source", "text"]).select("_carry.*", "size", "source_size",
                                                                                         "target", "copies")
    return got.toPandas()


@pytest.mark.parametrize("seed", [1, 2])
def test_budgets(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s in range(7):
        for d in range(rng.choice([3, 40, 200])):
            n = rng.choice([0, 1, 5, 20, 20, 20, 300, rng.randint(1, 900)])
            rows.append((len(rows), " ".join(f"w{k}" for k in range(n)), "en", None if s == 6 else f"s{s}"))
    got = table(spark, rows)
    sizes = got.groupby("source", dropna=False)["size"].sum()
    sizes = {None if isinstance(k, float) else k: int(v) for k, v in sizes.items()}
    want = plain_targets(sizes)
    taken = got.assign(taken=got["size"] * got["copies"]).groupby("source", dropna=False)
    for key, part in taken:
        source = None if isinstance(key, float) else key
        assert part["target"].iloc[0] == pytest.approx(want[source], rel=1e-9, abs=1e-6)
        assert (part["source_size"] == sizes[source]).all() and part["copies"].between(0, 3).all()
        assert abs(part["taken"].sum() - want[source]) <= max(1, 0.01 * want[source])
    again = table(spark, rows, partitions=7)
    key = ["doc_id", "copies"]
    assert got[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()


def test_fit_is_exact_where_it_can_be():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 500, 40))
        counts = rng.integers(1, 9, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum()))
        take = fit(lengths, counts, budget, 7)
        assert (take >= 0).all() and (take <= counts).all()
        assert budget - 2 <= (take * lengths).sum() <= budget


def test_one_hot_length(spark):
    rows = [(i, "a b c d e", "en", "hot") for i in range(5000)] + [(9000 + i, "x " * (i + 1), "en", "other") for i in range(50)]
    got = table(spark, rows)
    hot = got[got["source"] == "hot"]
    assert abs((hot["size"] * hot["copies"]).sum() - hot["target"].iloc[0]) <= 5


def test_awkward_rows(spark):
    got = table(spark, texts())
    assert len(got) == len(texts()) and (got["copies"] >= 0).all() and (got["copies"] <= 3).all()
    assert got["target"].groupby(got["source"].fillna("?")).first().sum() == pytest.approx(got["size"].sum())
    docs = frame(spark)
    rows = mixed(docs)
    assert rows.schema == docs.schema
    assert rows.count() == int(got["copies"].sum())


def test_empty(spark):
    assert len(table(spark, [])) == 0
    assert len(table(spark, [(1, None, None, None), (2, "", None, "s")])) == 2


def test_many_lengths_of_one_document_each():
    lengths, counts = np.arange(1, 301), np.ones(300, dtype=np.int64)
    for seed in range(5):
        for budget in (19_999, 12_345, 30_000, 45_150):
            take = fit(lengths, counts, budget, seed)
            assert (take >= 0).all() and (take <= counts).all() and (take * lengths).sum() == budget
    few = np.arange(901, 1001)  # no sum but these, so the nearest below is checked against a plain subset sum
    sums = {0}
    for n in few.tolist():
        sums |= {s + n for s in sums if s + n <= 15_000}
    assert (fit(few, np.ones(100, dtype=np.int64), 15_000, 3) * few).sum() == max(sums)
