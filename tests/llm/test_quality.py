"""Quality rules against a plain computation, and the verdicts on hosts."""

import random
import re

from awkward import frame, texts

from lectern.llm.quality import _prior, judge, keep_good

GAP = re.compile("[\x20\x09-\x0D]+")


def plain(text):
    words = [w for w in GAP.split(text or "") if w]
    lines = [x for x in (text or "").split("\n") if GAP.sub("", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(repeated), len(words) < 20 or 100 * len(repeated) > 30 * len(words))


def test_measures(spark):
    got = judge(frame(spark)).select("_carry.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                     "n_repeat_words", "base_failed").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, *plain(t))) for d, t, *_ in texts())


def test_overlapping_repeats(spark):
    cases = ["a b c d e f g h i j a b c d e f g h i j", "a " * 9, "a " * 8, "b " + "a " * 20 + "c", "x y " * 200 + "z"]
    got = judge(frame(spark, [(i, t, None, "s") for i, t in enumerate(cases)])).selectExpr("_carry.doc_id", "n_repeat_words")
    assert dict(map(tuple, got.collect())) == {i: plain(t)[4] for i, t in enumerate(cases)}


def test_host_verdicts_shrink(spark):
    good = " ".join(f"word{i}" for i in range(40))
    flagged = good + " ### ***"
    rows = [(i, flagged if i < 90 else good, "en", "bad") for i in range(100)]
    rows += [(1000 + i, flagged if i < 10 else good, "en", "fine") for i in range(100)]
    rows += [(2000 + i, flagged, "en", "tiny") for i in range(1)] + [(3000 + i, good, "en", f"h{i % 9}") for i in range(90)]
    got = {r["doc_id"]: r for r in judge(frame(spark, rows)).select("_carry.doc_id", "kept", "bad_rules").collect()}
    assert not any(got[i]["kept"] for i in range(90)) and all(got[i]["kept"] for i in range(90, 100))
    assert all(got[1000 + i]["kept"] for i in range(100))
    # one failure of a host's only document weighs less than most failures of a hundred
    assert all(got[3000 + i]["kept"] for i in range(90)) and got[0]["bad_rules"] == 1


def test_long_tail_of_hosts_is_not_condemned_by_chance(spark):
    good = " ".join(f"word{i}" for i in range(40))
    tail = [(i, good + (" ### ***" if i % 20 == 0 else ""), "en", f"one{i}") for i in range(1000)]
    got = judge(frame(spark, tail)).select("kept", "bad_rules").collect()
    assert len(got) == 1000 and all(r["kept"] and r["bad_rules"] == 0 for r in got)
    # beside larger hosts the tail shrinks to the mean, and a host that fails throughout does not
    rows = tail + [(2000 + 100 * h + i, good + (" ### ***" if h == 0 and i < 90 or i < 5 else ""), "en", f"many{h}")
                   for h in range(20) for i in range(100)]
    bad = {r["s"] for r in judge(frame(spark, rows), carry=("source",)).where("bad_rules > 0")
           .selectExpr("_carry.source AS s").distinct().collect()}
    assert bad == {"many0"}


def test_prior_against_known_strength():
    rng, k, m = random.Random(1), 8.0, 0.3
    hosts = []
    for _ in range(4000):
        n, p = rng.choice([1, 1, 1, 3, 10, 60]), rng.betavariate(m * k, (1 - m) * k)
        hosts.append((n, sum(rng.random() < p for _ in range(n))))
    mean, strength = _prior(len(hosts), sum(n for n, _ in hosts), sum(n * n for n, _ in hosts),
                            sum(f for _, f in hosts), sum(f * f / n for n, f in hosts))
    assert abs(mean - m) < 0.02 and 6.5 < strength < 9.5


def test_two_rules_suffice(spark):
    text = " ".join("word%d *##" % i for i in range(30))
    rows = [(1, text, "en", "s")] + [(10 + i, " ".join(f"w{i}x{k}" for k in range(40)), "en", "s") for i in range(30)]
    got = dict(map(tuple, judge(frame(spark, rows)).selectExpr("_carry.doc_id", "kept").collect()))
    assert got.pop(1) is False and all(got.values())


def test_keep_good_returns_rows_as_they_are(spark):
    docs = frame(spark)
    kept = keep_good(docs)
    assert kept.schema == docs.schema
    ids = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == [4, 5, 6, 100, 101, 102, 103, 104]


def test_empty(spark):
    assert judge(frame(spark, [])).count() == 0
    assert keep_good(frame(spark, [])).count() == 0
