"""Line deduplication: every long repeated run goes, one copy of everything stays."""

import random
import zlib

import numpy as np

from awkward import frame, texts

from lectern.llm.lines import dedup_lines, extend, fingerprints, line_words, units
from lectern.llm.shingles import WordHashes


def table(spark, rows, partitions=3):
    return dedup_lines(frame(spark, rows, partitions), carry=["doc_id", "source"]).select(
        "_carry.*", "text", "n_lines", "n_removed", "removed_words", "runs").collect()


def keys(text):
    return [" ".join(line.lower().split()) for line in (text or "").split("\n")]


def repeats_left(rows, run_words=50):
    """Runs of at least ``run_words`` words that occur twice, by brute force over all pairs of lines."""
    lines = [(d, i, k) for d, text in enumerate(rows) for i, k in enumerate(keys(text))]
    at = {}
    for d, i, k in lines:
        at.setdefault(k, []).append((d, i))
    found = 0
    for d, i, k in lines:
        for e, j in at[k]:
            if (e, j) <= (d, i):
                continue
            run, words = 0, 0
            one, two = keys(rows[d])[i:], keys(rows[e])[j:]
            if e == d:
                one = one[:j - i]
            while run < min(len(one), len(two)) and one[run] == two[run]:
                words += len(one[run].split())
                run += 1
            found += words >= run_words
    return found


def test_planted_passages(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passages = [[line(rng.randint(3, 30)) for _ in range(rng.randint(3, 8))] for _ in range(12)] + [[line(70)]]
    passages = [p if sum(len(x.split()) for x in p) > 50 else [*p, line(60)] for p in passages]
    short = [line(12) for _ in range(5)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [line(rng.randint(1, 40)) for _ in range(rng.randint(0, 4))]
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(short)]
        rows.append((d, "\n".join(x.upper() if rng.random() < 0.1 else x for x in parts), "en", "s"))
    got = sorted(table(spark, rows), key=lambda r: r["doc_id"])
    assert len(got) == len(rows) and repeats_left([t for _, t, *_ in rows]) > 0
    assert repeats_left([r["text"] for r in got]) == 0
    before, after = ({k for t in ts for k in keys(t)} for ts in ([t for _, t, *_ in rows], [r["text"] for r in got]))
    assert before - {""} <= after
    for r, (_, text, *_) in zip(got, rows):
        gone = {k for run in r["runs"] for k in range(run["start"], run["stop"] + 1)}
        assert r["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        assert (r["n_lines"], r["n_removed"]) == (len(text.split("\n")), len(gone))
    again = sorted(table(spark, rows, 7), key=lambda r: r["doc_id"])
    assert [r["text"] for r in again] == [r["text"] for r in got]


def test_short_repeats_stay(spark):
    rows = [(i, f"only {i}\na shared line of few words\nend {i}", "en", "s") for i in range(20)]
    assert all(r["n_removed"] == 0 for r in table(spark, rows))


def test_one_passage_in_a_third_of_all(spark):
    passage = "\n".join(" ".join(f"p{i}x{k}" for k in range(12)) for i in range(6))
    rows = [(i, f"head {i}\n{passage}\nfoot {i}" if i % 3 == 0 else f"text {i}", "en", "s") for i in range(600)]
    got = {r["doc_id"]: r for r in table(spark, rows)}
    assert got[0]["n_removed"] == 0
    assert all(got[i]["text"] == (f"head {i}\nfoot {i}" if i % 3 == 0 else f"text {i}") for i in range(1, 600))


def test_repeats_within_one_document(spark):
    line = " ".join(f"q{i}" for i in range(55))
    got = table(spark, [(1, "\n".join([line] * 5), "en", "s")])[0]
    assert got["text"] == line and got["n_removed"] == 4


def test_awkward_rows(spark):
    got = table(spark, texts())
    assert len(got) == len(texts())
    assert sum(r["text"] is None for r in got) == sum(t is None for _, t, *_ in texts())
    assert table(spark, []) == []


def hashed_lines(text):
    """A number per line that stands for its words, and how many they are."""
    words = np.array([len(line.split()) for line in text.split("\n")])
    return np.array([zlib.crc32(" ".join(line.split()).encode()) for line in text.split("\n")], np.int64), words


def test_fingerprints_are_guaranteed():
    rng = random.Random(1)
    for _ in range(50):
        text = "\n".join(" ".join("x%d" % rng.randrange(50) for _ in range(rng.randint(0, 9))) for _ in range(60))
        hashes, words = hashed_lines(text)
        picked = set(fingerprints(hashes, words).tolist())
        full = [i for i in range(60) if words[i]]
        for a in range(len(full)):
            total = 0
            for b in range(a, len(full)):
                total += words[full[b]]
                if total >= 50:
                    assert picked & set(full[a:b + 1])
                    break
    words = line_words("a b " * 6, WordHashes())[0].astype("uint32")
    back, ahead = words[:4][::-1].tobytes(), words[4:].tobytes()
    assert extend(back, ahead, back, ahead) == (4, 8)
    assert extend(back, ahead, back[:8], words[2:].tobytes(), apart=2) == (2, 0)
    assert extend(back, ahead, b"", words[:3].tobytes() + b"other---") == (0, 3)


def test_each_stretch_meets_its_own_first_place(spark):
    """The line that two copies share with an earlier text is not what the copies are compared by."""
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    text = "\n".join([line("a", 20), "amen", line("b", 35), line("c", 30), line("d", 12)])
    rows = [(k, f"{part}\nother {k}", "en", "s") for k, part in enumerate(text.split("\n"))]  # every line alone, earlier
    rows += [(10, text, "en", "s"), (11, text, "en", "s"), (12, f"{line('e', 9)}\n{text}\n{line('f', 9)}", "en", "s")]
    got = {r["doc_id"]: r["text"] for r in table(spark, rows)}
    assert got[10] == text and got[11] == "" and got[12] == f"{line('e', 9)}\n{line('f', 9)}"
    assert all(got[k] == t for k, t, *_ in rows[:5])


def test_units_are_the_same_wherever_a_passage_stands():
    memo, rng, met = WordHashes(), random.Random(5), 0
    for _ in range(500):
        passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(50))
        seen = []
        for n in (rng.randrange(40), rng.randrange(40)):
            around = [" ".join(f"x{rng.randrange(10**6)}" for _ in range(n)) for _ in range(2)]
            words, counts = line_words(f"{around[0]} {passage} {around[1]}", memo)
            hashes, starts = units(words, counts)
            sizes = np.diff(np.append(starts, len(words)))
            assert sizes.sum() == len(words) and sizes.max() <= 16
            picked = fingerprints(hashes, sizes, 15)
            seen.append({(h, s - n) for h, s in zip(hashes[picked], starts[picked]) if n <= s < n + 50})
        met += bool(seen[0] & seen[1])
    assert met >= 490


def test_passages_inside_lines(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [line(rng.randint(51, 90)) for _ in range(40)]
    rows, plain = [], []
    for i in range(200):
        head, foot = line(rng.randint(1, 60)), line(rng.randint(1, 60))
        rows.append((i, f"{head} {passages[i % 40]} {foot}", "en", "s"))
        plain.append(f"{head} {foot}")
    got = {r["doc_id"]: r for r in table(spark, rows)}
    assert all(got[i]["text"] == rows[i][1] for i in range(40))
    assert all(got[i]["text"] == plain[i] for i in range(40, 200))
    assert all(got[i]["removed_words"] == len(passages[i % 40].split()) for i in range(40, 200))


def test_blank_lines_do_not_end_a_run(spark):
    parts = [" ".join(f"{name}{k}" for k in range(20)) for name in "abcd"]
    rows = [(1, "\n".join(parts), "en", "s"), (2, "head\n" + "\n\n".join(parts) + "\nfoot", "en", "s")]
    got = {r["doc_id"]: r for r in table(spark, rows)}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "head\nfoot"
    assert (got[2]["n_removed"], got[2]["removed_words"]) == (7, 80)
