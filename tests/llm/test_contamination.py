"""Decontamination against all windows at all places."""

import random
import re

from awkward import frame, texts

from lectern.llm.contamination import contamination, keep_clean

ITEMS = "item_id long, text string, len int, wid string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    windows = set()
    for item, text in items:
        w = words(text)
        if w:
            windows |= {("" if item is None else str(item), tuple(w[i:i + 10])) for i in range(max(1, len(w) - 9))}
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        out.append((doc, len(w), len(hit), len(found), sorted(found)))
    return sorted(out, key=repr)


def run(spark, rows, items):
    docs = frame(spark, [(d, t, None, None) for d, t in rows])
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    got = contamination(docs, bench).select("_carry.doc_id", "n_words", "n_hit", "n_items", "items").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_random_texts(spark):
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 9, 10, 11, 14, 30]))) for i in range(12)] + [(50, "t1"), (51, "t2 t3")]
    rows = []
    for d in range(60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1].split()
            cut = item[rng.randint(0, 3):len(item) - rng.randint(0, 2)]
            parts += [" ".join(cut).upper().replace(" ", rng.choice([" ", ", ", "\n"])), text(rng.randint(0, 9))]
        rows.append((d, " ".join(parts)))
    assert run(spark, rows, items) == brute(rows, items)


def test_awkward_rows(spark):
    rows = [(d, t) for d, t, *_ in texts()]
    items = [(1, None), (2, ""), (3, "..."), (None, "quick brown fox"), (None, "weird"), (4, rows[3][1]), (4, rows[3][1]),
             (5, "w8990 w8991 w8992 w8993 w8994 w8995 w8996 w8997 w8998 w8999 w0"), (6, "É É É")]
    assert run(spark, rows, items) == brute(rows, items)


def test_empty_tables(spark):
    rows = [(1, "a b c")]
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, rows, []) == [(1, 3, 0, 0, [])]


def test_keep_clean(spark):
    docs = frame(spark)
    bench = spark.createDataFrame([(1, "seven wizards quietly boil old potions in a very dark cave", 1, "x")], ITEMS)
    kept = keep_clean(docs, bench)
    assert kept.schema == docs.schema
    assert not any("wizards" in (r["text"] or "").lower() for r in kept.collect())
    assert kept.count() == sum("wizards" not in (t or "").lower() for _, t, *_ in texts())
