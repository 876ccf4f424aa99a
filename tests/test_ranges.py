import bisect
import random

from lectern.operators.ranges import count_by_range, range_lookup

RANGES = "lo bigint, hi bigint, name string"


def make_ranges(seed):
    """Disjoint ranges from single values to ones that span many buckets, with gaps."""
    rng, at, out = random.Random(seed), 0, []
    for i in range(200):
        at += rng.choice([0, 1, 5, 70_000])
        size = rng.choice([1, 2, 300, 65_536, 500_000])
        out.append((at, at + size - 1, f"r{i % 17}"))
        at += size
    return out


def lookup(ranges, value):
    i = bisect.bisect_right([r[0] for r in ranges], value) - 1
    return ranges[i][2] if value is not None and i >= 0 and value <= ranges[i][1] else None


def test_lookup_equals_search(spark):
    ranges = make_ranges(1)
    rng = random.Random(2)
    edges = [x for lo, hi, _ in ranges for x in (lo, hi, hi + 1, max(lo - 1, 0))]
    values = sorted({*edges, *(rng.randrange(0, ranges[-1][1] + 100_000) for _ in range(2000))})
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    table = spark.createDataFrame(ranges, RANGES)
    for bits in (8, 16, 24):
        got = {r.v: r.name for r in range_lookup(df, "v", table, "lo", "hi", ["name"], bits).collect()}
        assert got == {v: lookup(ranges, v) for v in values}


def test_counts_with_a_hot_value_and_nulls(spark):
    ranges = make_ranges(3)
    rng = random.Random(4)
    hot = ranges[10][0]
    values = [hot if i % 3 == 0 else None if i % 50 == 1 else rng.randrange(0, ranges[-1][1] + 1000) for i in range(3000)]
    want = {}
    for v in values:
        name = None if v is None else lookup(ranges, v)
        want[name] = want.get(name, 0) + 1
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    out = count_by_range(df, "v", spark.createDataFrame(ranges, RANGES), "lo", "hi", ["name"])
    assert {r.name: r.num for r in out.collect()} == want
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_no_ranges_at_all(spark):
    df = spark.createDataFrame([(1,), (2,)], "v bigint")
    empty = spark.createDataFrame([], RANGES)
    assert [tuple(r) for r in count_by_range(df, "v", empty, "lo", "hi", ["name"]).collect()] == [(None, 2)]
