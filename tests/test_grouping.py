import random

import pytest
from pyspark.sql import Window, functions as F

from lectern.operators.grouping import (
    among_best, count_by, count_by_each, first_per_key, ids_in_parts, rate_by, sum_by_each, top_n, top_n_ties)
from lectern.operators.upsert import upsert


def test_count_by_keeps_null_keys_and_tenants(spark, rows):
    df = spark.createDataFrame([(1, "a_b", "x"), (2, "a_b", "y"), (3, None, "x"), (None, "a_b", "x")],
                               "uid int, url string, dn string").withColumn("dt", F.lit("d"))
    assert rows(count_by(df, "url"), "url", "dn", "num") == sorted([("a_b", "x", 1), ("a_b", "y", 1), (None, "x", 1)], key=repr)
    each = count_by_each(df, ["url", "dn"])
    assert rows(each.where("dim = 'url'"), "key", "dn", "num") == rows(count_by(df, "url"), "url", "dn", "num")


def test_sum_by_each(spark, rows):
    df = spark.createDataFrame([(1, "p", 5), (1, "q", 6), (2, "p", 7)], "c int, s string, v bigint")
    assert rows(sum_by_each(df, ["c", "s"], "v"), "dim", "key", "total") == [
        ("c", "1", 11), ("c", "2", 7), ("s", "p", 12), ("s", "q", 6)]


def skewed_scores(spark, n=3000):
    """One paper with a third of all rows, ties, nulls."""
    rng = random.Random(7)
    data = [(i, 0 if i % 3 == 0 else rng.randrange(1, 40), rng.choice([None, *range(0, 12)])) for i in range(n)]
    return spark.createDataFrame(data, "id int, paper int, score int")


@pytest.mark.parametrize("ascending", [True, False])
def test_top_n_ties_equals_dense_rank(spark, rows, ascending):
    df = skewed_scores(spark).repartition(6)
    order = F.col("score").asc_nulls_first() if ascending else F.col("score").desc_nulls_last()
    want = df.withColumn("rk", F.dense_rank().over(Window.partitionBy("paper").orderBy(order))).where("rk < 4")
    assert rows(top_n_ties(df, ["paper"], "score", 3, ascending), "id", "rk") == rows(want, "id", "rk")


@pytest.mark.parametrize("ascending", [True, False])
def test_among_best_cuts_below_the_joins(spark, rows, ascending):
    """Null values and null groups too, and rows that a join drops have no say."""
    scores = skewed_scores(spark).union(spark.createDataFrame([(-1, None, 5), (-2, None, None)], "id int, paper int, score int"))
    kept = spark.range(-2, 3000).where("id % 5 > 0").select(F.col("id").cast("int"), F.col("id").alias("more"))
    df = scores.join(kept, "id")
    order = F.col("score").asc_nulls_first() if ascending else F.col("score").desc_nulls_last()
    want = df.withColumn("rk", F.dense_rank().over(Window.partitionBy("paper").orderBy(order))).where("rk < 4")
    best = among_best(df, ["paper"], "score", 3, ascending)
    assert rows(best, "id", "more") == rows(want, "id", "more")
    assert rows(top_n_ties(best, ["paper"], "score", 3, ascending), "id", "rk") == rows(want, "id", "rk")


def test_top_n_ties_prunes_before_the_shuffle(spark):
    plan = top_n_ties(skewed_scores(spark).repartition(6), ["paper"], "score")._jdf.queryExecution() \
        .executedPlan().toString()
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line and "Partial" in line]
    assert sorted("dense_rank" in line for line in limits) == [False, True]


def test_top_n_limits_before_the_shuffle(spark):
    plan = top_n(skewed_scores(spark), ["paper"], [F.col("score").desc(), F.col("id")])._jdf.queryExecution() \
        .executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_first_per_key_is_stable(spark):
    df = spark.createDataFrame([(1, "b", "2"), (1, "a", "2"), (1, "c", "1"), (2, None, None)], "k int, v string, t string")
    assert sorted((r.k, r.v) for r in first_per_key(df, ["k"], ["t"]).collect()) == [(1, "c"), (2, None)]


def test_distinct_id_lists_take_one_shuffle(spark, rows):
    df = spark.sql("SELECT * FROM VALUES ('a', 3), ('a', 1), ('a', 3), ('a', 12), ('b', NULL), (NULL, 2) AS t(g, id)")
    lists = ids_in_parts(df, ["g"], "id", "ids", part_width=10)
    assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(lists, "g", "part", "ids") == sorted([("a", 0, "1,3"), ("a", 1, "12"), ("b", None, ""), (None, 0, "2")], key=repr)


@pytest.mark.parametrize("distinct", [True, False])
def test_id_lists_are_whole_and_bounded(spark, distinct):
    rng = random.Random(3)
    data = [(0 if i % 3 else i % 5, rng.randrange(0, 200) if i % 4 else 42) for i in range(4000)]
    df = spark.createDataFrame(data, "g int, uid int")
    got = {}
    for r in ids_in_parts(df, ["g"], "uid", "ids", distinct, part_width=50, copy_width=4).collect():
        ids = [int(x) for x in r.ids.split(",")]
        assert ids == sorted(ids) and len(ids) <= (50 if distinct else 200)
        got.setdefault(r.g, []).extend(ids)
    want = {}
    for g, uid in data:
        want.setdefault(g, []).append(uid)
    assert {g: sorted(v) for g, v in got.items()} == {
        g: sorted(set(v)) if distinct else sorted(v) for g, v in want.items()}


def test_rate_by_modes(spark, rows):
    df = spark.createDataFrame([("p", 61), ("p", 60), ("p", 0), ("q", 70), ("r", 10), ("s", None), ("s", -1)],
                               "paper string, score int")
    args = (df, ["paper"], F.col("score") > 60, F.col("score").between(0, 60), ("passed", "failed", "rate"))
    assert [tuple(map(str, r)) for r in rows(rate_by(*args))] == [
        ("p", "1", "2", "0.33"), ("q", "1", "0", "1.00"), ("r", "0", "1", "0.00")]
    assert [r[0] for r in rows(rate_by(*args, inner_only=True))] == ["p"]


def test_upsert(spark, rows):
    old = spark.createDataFrame([(1, 10, "a", "x"), (2, 20, "b", "y"), (None, 1, "n", "z")], "k int, n int, s string, first string")
    new = spark.createDataFrame([(2, 5, None, "w"), (3, 7, "c", "v"), (None, 2, "m", "u")], "k int, n int, s string, first string")
    merged = upsert(old, new, ["k"], add=["n"], replace=["s"], keep=["first"])
    assert [f.dataType for f in merged.schema] == [f.dataType for f in old.schema]
    assert rows(merged) == sorted([(1, 10, "a", "x"), (2, 25, None, "y"), (3, 7, "c", "v"), (None, 3, "m", "z")], key=repr)
