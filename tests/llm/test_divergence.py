"""Source divergence against sums over all terms of all pairs, and on awkward rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from awkward import frame
from lectern.llm import divergence
from lectern.llm.divergence import SCALE, source_divergence


def brute(rows, least_docs=10, top=10):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    counts, all_counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        all_counts[lang].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in in_docs[lang].items() if n >= least_docs]

        def shares(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + SCALE * (count[t] + 2) // total for t in kept}

        p, q = shares(counts[lang, source]), shares(all_counts[lang])
        pairs = []
        for other in {s for l, s in groups if l == lang and s != source}:
            r = shares(counts[lang, other])
            pairs.append((-sum((p[t] - r[t]) ** 2 // (p[t] + r[t]) for t in kept), other.encode(), other))
        own = [(-((p[t] - q[t]) ** 2 // (p[t] + q[t])), t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "text string, lang string, source string, term string, p string")
    return sorted(tuple(r) for r in source_divergence(df.repartition(5), **options).collect())


@pytest.fixture
def texts():
    rng = random.Random(4)
    words = ["a", "é", "ß", "Zoo", "zoo", "word's", "naïve", "Ärger", "\U0001F600", "x1y"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for k in range(300):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "S2", "é", None, ""])
        rows.append((rng.choice([" ", "\n", "-", "\x00"]).join(rng.choices(words, k=rng.randint(0, 40))), lang, source))
    return rows + [(None, "en", "empty"), ("only once", "fr", "one"), ("only twice", "fr", "two"), (None, None, None)]


def test_equals_sums_over_all_terms(spark, texts):
    got = result(spark, texts)
    assert got == brute(texts)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[4] == 0 for r in got if r[0] == "fr")
    assert result(spark, texts, least_docs=1, top=3) == brute(texts, least_docs=1, top=3)


def test_partial_counts_that_are_sent_early(spark, texts, monkeypatch):
    monkeypatch.setattr(divergence, "PARTIAL_ROWS", 20)
    monkeypatch.setattr(divergence, "SPLIT_BYTES", 100)
    import pyarrow as pa
    batch = pa.record_batch([pa.array([t or "" for t, _, _ in texts]), pa.array([l or "" for _, l, _ in texts]),
                             pa.array([s or "" for _, _, s in texts])], names=["text", "lang", "source"])
    whole = divergence._merged([divergence._counted(batch)])
    early = pa.Table.from_batches(divergence._partial_counts(iter([batch])))
    assert early.num_rows > whole.num_rows
    order = [("lang", "ascending"), ("source", "ascending"), ("term", "ascending")]
    assert divergence._merged([early]).sort_by(order) == whole.sort_by(order)


def test_shards_that_end_within_a_term():
    import pyarrow as pa
    rows = [("en", t, s, 10 + i, 3 + i) for t in "abc" for i, s in enumerate("xyz")]
    table = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("lang", "term", "source", "p", "p0"))})
    whole = pa.Table.from_batches(divergence._shard(iter(table.to_batches())))
    small = pa.Table.from_batches(divergence._shard(iter(table.to_batches(max_chunksize=2))))
    assert whole.sort_by("item").to_pylist() and sorted(map(str, whole.to_pylist())) == sorted(map(str, small.to_pylist()))


def test_counts_beyond_64_bits(spark):
    row = spark.range(1).select(divergence.share(divergence.F.lit(10 ** 15), divergence.F.lit(10 ** 16), divergence.F.lit(50)).alias("p"))
    assert row.first().p == 1 + SCALE * (10 ** 15 + 2) // (10 ** 16 + 100)


def test_awkward_rows(spark):
    docs = frame(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(tuple(r) for r in source_divergence(docs, least_docs=1).collect()) == brute(rows, least_docs=1)
    assert source_divergence(docs.limit(0)).count() == 0
