from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalars as S


def values(spark, inputs, expression, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_masks(spark):
    assert values(spark, ["Smith", "", None], S.mask_name) == ["SXX", "XX", None]
    assert values(spark, ["13812345678", "138", None], S.mask_phone) == ["138****678", "138****", None]
    assert values(spark, ["secret", None], S.mask_password) == ["******", "******"]


def test_codes(spark):
    assert values(spark, ["1", "2", "3", "4", "9", None], S.source_name) == [
        "PC", "Mobile", "APP", "WeChat", "other", "other"]
    assert values(spark, ["1", "2", "3", None], S.platform_name) == ["PC", "APP", "Other", "Other"]


def test_score_bands(spark):
    scores = [Decimal(s) for s in ("0", "20", "20.5", "40", "60", "60.5", "100", "100.5", "-0.5")] + [None]
    assert values(spark, scores, S.score_band, "decimal(5,1)") == [
        "0-20", "0-20", "20-40", "20-40", "40-60", "60-80", "80-100", None, None, None]


def test_half_up(spark):
    got = values(spark, ["0.25", "0.35", "-0.25", "7", "abc", None], S.half_up)
    assert got == [Decimal("0.3"), Decimal("0.4"), Decimal("-0.3"), Decimal("7.0"), None, None]


def test_int_or_zero(spark):
    assert values(spark, ["7", "7.9", " 7 ", "", "x", None, "99999999999"], S.int_or_zero) == [7, 7, 7, 0, 0, 0, 0]


def test_days_and_seconds(spark):
    assert values(spark, ["20190722", None], S.day_to_iso) == ["2019-07-22", None]
    df = spark.createDataFrame([(0, 1999), (0, 2000), (1500, 1000)], "a bigint, b bigint")
    assert [r[0] for r in df.select(S.elapsed_seconds(F.col("a"), F.col("b"))).collect()] == [1, 2, 0]


@pytest.mark.parametrize("part,whole,text", [(1, 8, "12%"), (3, 8, "38%"), (4, 7, "57%"), (5, 0, "0%"), (25, 2, "1,250%")])
def test_percent_text(spark, part, whole, text):
    assert spark.range(1).select(S.percent_text(F.lit(part), F.lit(whole))).first()[0] == text


def test_effective_seconds(spark):
    df = spark.createDataFrame([(30, 10, 20, 10), (30, 10, 20, 3), (30, 5, 5, 0), (7, 0, 3, 2)],
                               "w bigint, s int, e int, n bigint")
    out = df.select(S.effective_seconds(F.col("w"), F.col("s"), F.col("e"), F.col("n"))).collect()
    assert [r[0] for r in out] == [30, 9, 0, 4]


def test_ip_and_region(spark):
    ips = ["0.0.0.0", "1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "", None, "a.b.c.d"]
    assert values(spark, ips, S.ip_number) == [0, 16909060, 4294967295, None, None, None, None, None]
    assert values(spark, ["C|0|P|City|isp", "C|0", None], S.region_part) == ["P", None, None]


def test_interval_text(spark):
    df = spark.createDataFrame([("1-5,9-12",), ("",), (None,)], "t string")
    parsed = df.select(S.parse_intervals(F.col("t")).alias("i"))
    assert [[tuple(x) for x in r[0]] for r in parsed.collect()] == [[(1, 5), (9, 12)], [], []]
    assert [r[0] for r in parsed.select(S.format_intervals(F.col("i"))).collect()] == ["1-5,9-12", "", ""]


def test_rates(spark):
    row = spark.range(1).select(S.correct_rate(F.lit(1), F.lit(4)), S.mastery_rate(F.lit(15), F.lit(1), F.lit(4)),
                                S.rate(F.lit(1), F.lit(2))).first()
    assert row[0] == 0.25 and row[1] == 0.125 and row[2] == Decimal("0.33")


def test_half_up_rounds_once(spark):
    texts = ["0.04999999", "1.2499996", "1.25", "-0.05", "x", "0.049999999999999999"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "v string").select(S.half_up(F.col("v"))).collect()]
    assert [None if g is None else str(g) for g in got] == ["0.0", "1.2", "1.3", "-0.1", None, "0.0"]


def test_days_that_are_none(spark):
    got = [r[0] for r in spark.createDataFrame([("20190722",), ("2019x",), (None,)], "d string").select(
        S.day_to_iso(F.col("d"))).collect()]
    assert got == ["2019-07-22", None, None]
