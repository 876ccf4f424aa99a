"""The Jaccard join against all pairs, on groups of near copies, boilerplate and awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from lectern.llm import jaccard
from lectern.llm.jaccard import _flipped, _signature, boundary, jaccard_components, prefix_length

SCHEMA = "doc_id long, text string, node string, n string, a int"


def brute(rows, width=4, percent=85):
    sets = []
    for doc_id, text in rows:
        words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else (
            [tuple(words)] if words else [])
        sets.append(frozenset(grams))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in lists[g])
        for g in s:
            lists[g].append(i)
        for j, both in common.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in jaccard_components(df).collect()), key=repr)


def near_copies(rng, base, n, most):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(words))
            action = rng.random()
            if action < 0.6:
                words[at] = f"e{rng.randrange(10 ** 6)}"
            elif action < 0.8:
                del words[at]
            else:
                words.insert(at, f"i{rng.randrange(8)}")
        yield " ".join(words)


def test_groups_of_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for size, copies, most in ((150, 260, 5), (60, 90, 3), (25, 60, 2), (300, 40, 9)):
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts += near_copies(rng, base, copies, most)
        variant = base[:size // 2] + [rng.choice(vocabulary) for _ in range(size // 8)] + base[size // 2 + size // 8:]
        texts += near_copies(rng, variant, copies // 2, most)
    for _ in range(120):  # a passage that makes up much of otherwise different texts
        texts.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]))
    for _ in range(80):
        texts.append(" ".join(rng.choice(vocabulary[:6]) for _ in range(rng.randint(1, 14))))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert result(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "ONE"), (7, "a b c"), (8, "A  B\tc"),
            (9, "a b c d"), (9, "a b c d"), (None, "a b c d"), (None, "only here with no id"), (10, "É b c d"),
            (11, "é b c d"), (12, "a b c d"), (13, "x " * 30_000 + "end"), (14, "x " * 30_000 + "end")]
    rows += [(20, " ".join(f"l{i}" for i in range(20_000))), (21, " ".join(f"l{i}" for i in range(1, 20_000)))]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_boundary_follows_cost():
    assert prefix_length(100, 85) == 16
    assert boundary([], 85) == 0
    assert 20 <= boundary([(s, 10) for s in range(1, 400)], 85) < 100


def test_signatures_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2 ** 63, 900).astype(np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 800))) for _ in range(2))
        assert _flipped(_signature(x), _signature(y)) <= len(np.setxor1d(x, y))
        assert _flipped(_signature(x), _signature(x)) == 0


def test_sets_are_made_of_pairs_that_signatures_allow(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(400):  # half of the words in common: some meet in a list, none links
        base = [rng.choice(vocabulary) for _ in range(60)]
        texts += [" ".join(base), " ".join(base[:33] + [rng.choice(vocabulary) for _ in range(27)])]
    texts += near_copies(rng, [rng.choice(vocabulary) for _ in range(80)], 6, 1)
    rows, counts = list(enumerate(texts)), {}
    split, make = jaccard._split_lists, jaccard.sets_of

    def split_lists(*args):
        pairs, members = split(*args)
        counts.setdefault("paired", pairs.selectExpr("explode(array(a, b)) AS node").distinct().count())
        return pairs, members

    def sets_of(*args):
        sets = make(*args)
        counts["sets"] = sets.count()
        return sets

    monkeypatch.setattr(jaccard, "_split_lists", split_lists)
    monkeypatch.setattr(jaccard, "sets_of", sets_of)
    assert result(spark, rows) == brute(rows)
    assert counts["paired"] > 50 and counts["sets"] < counts["paired"] / 2
