"""Shards: exact row counts, gapless slots, groups together, fewer cut links than by chance."""

import random
import zlib

from awkward import frame, texts

from lectern.llm.sharding import shard, shared_lines, with_shards


def check(got, n, shards=8):
    sizes = got.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert len(got) == n and sizes.max() - sizes.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def table(spark, rows, **options):
    return shard(frame(spark, rows), carry=["doc_id", "text"], **options).select(
        "_carry.*", "size", "text_crc32", "node", "shard", "slot").toPandas()


def test_linked_documents(spark):
    rng = random.Random(2)
    line = lambda: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(8))
    families = [[line() for _ in range(3)] for _ in range(60)]
    rows = []
    for f, shared in enumerate(families):
        for _ in range(rng.randint(2, 9)):
            rows.append((len(rows), "\n".join([line(), *rng.sample(shared, 2), line()]), None, f"f{f}"))
    rows += [(len(rows) + i, line(), None, None) for i in range(400)]
    copies = line()
    rows += [(5000 + i, copies, None, None) for i in range(20)]
    got = table(spark, rows)
    check(got, len(rows))
    assert got[got["text"] == copies]["shard"].nunique() == 1
    links = shared_lines(frame(spark, rows)).toPandas()
    links["shard"] = links["node"].map(got.drop_duplicates("node").set_index("node")["shard"])
    kept = links.groupby("hub")["shard"].agg(lambda s: s.value_counts().iloc[0]).sum() / len(links)
    assert kept > 0.7  # by chance about 0.37 for such small families


def test_pairs_and_triples_come_together(spark):
    rng = random.Random(3)
    line = lambda: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(8))
    rows = []
    for family in range(400):
        shared = [line(), line()]
        rows += [(10 * family + i, "\n".join([*shared, line()]), None, None) for i in range(2 + family % 2)]
    rows += [(10_000 + i, line(), None, None) for i in range(1000)]
    got = table(spark, rows)
    check(got, len(rows))
    families = got[got["doc_id"] < 10_000].assign(family=lambda t: t["doc_id"] // 10).groupby("family")["shard"].nunique()
    pairs, triples = families[families.index % 2 == 0], families[families.index % 2 == 1]
    assert (pairs == 1).mean() >= 0.9 and (triples == 1).mean() >= 0.9


def test_one_group_larger_than_a_shard(spark):
    rows = [(i, "the same text\nin two lines", None, "s") for i in range(3000)] + [
        (10_000 + i, f"text {i}\nin two lines", None, "s") for i in range(3000)]
    got = table(spark, rows)
    check(got, 6000)
    assert got[got["doc_id"] < 3000]["shard"].nunique() == 4


def test_awkward_rows(spark):
    got = table(spark, texts())
    check(got, len(texts()))
    for row in got.itertuples():
        data = (row.text or "").encode()
        assert (row.size, row.text_crc32) == (len(data) + 1, zlib.crc32(data))
    docs = frame(spark)
    out = with_shards(docs)
    assert out.columns == [*docs.columns, "shard_1", "slot_1"] and out.count() == len(texts())


def test_empty(spark):
    assert len(table(spark, [])) == 0
    check(table(spark, [(1, None, None, None)]), 1)


def test_near_copies_of_a_giant_group(spark):
    """Near copies of a group of 1/10 of all rows go to its shard as far as that has room."""
    shared = [f"line {k} of the giant" for k in range(6)]
    rows = [(i, "\n".join(shared), None, "giant") for i in range(200)]
    rows += [(1000 + i, "\n".join([*shared, f"near {i}"]), None, "near") for i in range(40)]
    rows += [(3000 + i, f"text {i}", None, None) for i in range(1760)]
    got = table(spark, rows)
    check(got, 2000)
    home = set(got[got["doc_id"] < 200]["shard"])
    near = got[got["doc_id"].between(1000, 1039)]
    assert len(home) == 1 and near["shard"].isin(home).sum() >= 36
