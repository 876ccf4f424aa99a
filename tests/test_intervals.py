import random

from pyspark.sql import functions as F

from lectern.operators.intervals import fold_plays, interval_coverage, interval_merge, known_length, video_time, video_time_after

KEYS = ["uid", "cwareid", "videoid"]
SCHEMA = "uid int, cwareid int, videoid int, ps int, pe int, ts bigint, te bigint, seconds bigint"


def plays(seed, n=1500):
    """Plays of several users; one user and video has a third of them, many equal."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        uid = 0 if i % 3 == 0 else rng.randrange(1, 40)
        ps = rng.choice([0, 0, 10, rng.randrange(0, 400)])
        pe = ps + rng.choice([0, 5, 10, rng.randrange(0, 90)])
        ts = rng.randrange(0, 50) * 1000
        te = ts + rng.randrange(0, 60_000)
        out.append((uid, 1, uid % 3, ps, pe, ts, te, (te - ts) // 1000))
    return out


def brute(data):
    """Totals by marking every position."""
    out = {}
    for key in {r[:3] for r in data}:
        seen, total, effective = set(), 0, 0
        for _, _, _, ps, pe, ts, te, sec in sorted(r for r in data if r[:3] == key):
            new = set(range(ps, pe)) - seen
            seen |= new
            total += sec
            effective += sec * len(new) // (pe - ps) if pe > ps else 0
        out[key] = (total, effective, len(seen))
    return out


def brute_merge(intervals):
    out = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def test_video_time_equals_brute_force(spark):
    data = plays(1)
    for width in (7, 64, 100_000):
        out = video_time(spark.createDataFrame(data, SCHEMA), slice_width=width).collect()
        assert {(r.uid, r.cwareid, r.videoid): (r.totaltime, r.effecttime, r.completetime) for r in out} == brute(data)


def test_merge_equals_brute_force(spark):
    data = plays(2)
    got = {}
    for r in interval_merge(spark.createDataFrame(data, SCHEMA), KEYS).collect():
        got.setdefault((r.uid, r.cwareid, r.videoid), []).append((r.ps, r.pe))
    want = {key: brute_merge([(r[3], r[4]) for r in data if r[:3] == key]) for key in {r[:3] for r in data}}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_coverage_cases(spark):
    """Against a first play of 10-20: inside, both overlaps, covering, disjoint, touching, same start or end."""
    cases = {(12, 15): 0, (5, 15): 5, (15, 25): 5, (5, 25): 10, (30, 40): 10, (20, 30): 10, (10, 25): 5, (5, 20): 5,
             (15, 15): 0}
    rows = [(i, s, e) for i, (s, e) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, ps int, pe int")
    stored = df.select("k", F.expr("array(struct(10L AS s, 20L AS e))").alias("known"))
    total = {r.k: r.new_len for r in interval_coverage(df, ["k"], known=stored).collect()}
    assert [total[i] for i in range(len(cases))] == list(cases.values())
    df = df.union(df.selectExpr("k", "10", "20"))
    total = {r.k: r.n for r in interval_coverage(df, ["k"]).groupBy("k").sum("new_len").toDF("k", "n").collect()}
    assert [total[i] - 10 for i in range(len(cases))] == list(cases.values())


def test_slices_are_never_broadcast(spark, rows):
    """Few bytes by the planner's estimate, which is no measure of rows that are parsed from lines."""
    covered = interval_coverage(spark.sql("SELECT * FROM VALUES (1, 0, 5), (1, 3, 200), (2, 7, 9) AS t(k, ps, pe)"), ["k"])
    assert "Broadcast" not in covered._jdf.queryExecution().executedPlan().toString()
    assert rows(covered, "k", "ps", "pe", "new_len") == [(1, 0, 5, 5), (1, 3, 200, 195), (2, 7, 9, 2)]


def test_times_carried_on_over_batches(spark):
    """Three batches, each after what the ones before it have stored, against marking every position."""
    seen, times, before = {}, {}, None
    for seed in (11, 12, 13):
        batch = plays(seed, 400)
        before = video_time_after(fold_plays(spark.createDataFrame(batch, SCHEMA), KEYS), before, KEYS)
        carried = {tuple(r[k] for k in KEYS): r for r in before.collect()}
        for key in {r[:3] for r in batch}:
            total, effective, _ = times.get(key, (0, 0, 0))
            positions, spans = seen.get(key, (set(), []))
            for _, _, _, ps, pe, _, _, sec in sorted(r for r in batch if r[:3] == key):
                new = set(range(ps, pe)) - positions
                positions |= new
                spans.append((ps, pe))
                total, effective = total + sec, effective + (sec * len(new) // (pe - ps) if pe > ps else 0)
            seen[key], times[key] = (positions, spans), (total, effective, len(positions))
            r = carried[key]
            assert (r.totaltime, r.effecttime, r.completetime) == times[key]
            assert r.play_interval == ",".join(f"{s}-{e}" for s, e in brute_merge(spans))
        assert set(carried) == {r[:3] for r in batch}
        stored = [r.asDict() for r in before.collect()]
        stored += [dict(zip(KEYS, k), totaltime=t[0], effecttime=t[1], completetime=t[2], play_interval=",".join(
            f"{s}-{e}" for s, e in brute_merge(seen[k][1]))) for k, t in times.items() if k not in carried]
        before = spark.createDataFrame(stored, before.schema)


def test_known_length_of_null_and_empty(spark):
    df = spark.sql("SELECT CAST(NULL AS array<struct<s:bigint,e:bigint>>) AS k UNION ALL SELECT array()")
    assert [r[0] for r in df.select(known_length(F.col("k"), F.lit(0), F.lit(9))).collect()] == [0, 0]


def test_merge_of_long_negative_and_empty_intervals(spark):
    rng = random.Random(9)
    data = [(rng.randrange(6), s, s + rng.choice([0, 0, 1, 3, 64, 65, rng.randrange(1, 1000)]))
            for s in (rng.randrange(-700, 5000) for _ in range(250))]
    data += [(9, 0, 64), (9, 64, 128), (10, 0, 128), (10, 128, 128), (11, -64, -64), (11, -65, -64), (12, 5, 5), (12, 7, 7), (12, 6, 6)]
    got = {}
    for r in interval_merge(spark.createDataFrame(data, "k int, ps int, pe int"), ["k"]).collect():
        got.setdefault(r.k, []).append((r.ps, r.pe))
    assert {k: sorted(v) for k, v in got.items()} == {
        k: brute_merge([(s, e) for key, s, e in data if key == k]) for k in {r[0] for r in data}}


def test_merge_is_lazy_and_takes_two_shuffles(spark, capsys):
    df = spark.createDataFrame([(1, 0, 5)], "k int, ps int, pe int").repartition(3)
    plan = interval_merge(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
