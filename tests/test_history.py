import random
from decimal import Decimal

from pyspark.sql import functions as F

from lectern.operators.history import OPEN_END, scd2_apply, scd2_history

KEYS = ["uid", "dn"]
SCHEMA = "uid int, dn string, start_time string, paymoney decimal(20,4), vip_level string"
COLUMNS = ["uid", "dn", "start_time", "paymoney", "vip_level", "end_time"]


def fold(payments):
    """Day-by-day history of one key, written out."""
    out, total = [], Decimal(0)
    days = sorted(payments)
    for i, day in enumerate(days):
        total += payments[day]
        out.append((day, total, days[i + 1] if i + 1 < len(days) else OPEN_END))
    return out


def sample(seed):
    """Daily rows; one member pays on every day."""
    rng = random.Random(seed)
    days = [f"2019-07-{d:02d}" for d in range(1, 21)]
    data = {(0, "a"): {d: Decimal(rng.randrange(1, 500)) / 4 for d in days}}
    for uid in range(1, 12):
        for dn in "ab":
            picked = rng.sample(days, rng.randrange(0, 6))
            if picked:
                data[(uid, dn)] = {d: Decimal(rng.randrange(1, 500)) / 4 for d in picked}
    return days, data


def frame(spark, data, keep=lambda day: True):
    rows = [(u, dn, day, money, "V" + day[-1]) for (u, dn), p in data.items() for day, money in p.items() if keep(day)]
    return spark.createDataFrame(rows, SCHEMA)


def expect(data):
    return sorted((u, dn, start, money, "V" + start[-1], end)
                  for (u, dn), p in data.items() for start, money, end in fold(p))


def got(df):
    return sorted((r.uid, r.dn, r.start_time, r.paymoney.quantize(Decimal("0.0001")), r.vip_level, r.end_time)
                  for r in df.select(*COLUMNS).collect())


def test_closed_form_equals_fold(spark):
    _, data = sample(1)
    assert got(scd2_history(frame(spark, data), KEYS, "start_time", "paymoney")) == expect(data)


def test_day_by_day_late_days_and_reruns(spark):
    days, data = sample(2)
    order = days[:]
    random.Random(5).shuffle(order)          # late days
    chunks = [order[0:8], order[8:14], order[14:], order[3:5]]   # the last chunk is a re-run
    history = None
    for chunk in chunks:
        rows = frame(spark, data, lambda d: d in chunk)
        if history is None:
            history = scd2_history(rows, KEYS, "start_time", "paymoney").withColumn(
                "paymoney", F.col("paymoney").cast("decimal(20,4)")).select(*COLUMNS)
        else:
            history = scd2_apply(history, rows, KEYS, "start_time", "paymoney")
        history = spark.createDataFrame(history.collect(), history.schema)
    assert got(history) == expect(data)


def test_corrected_day_replaces_the_amount(spark):
    day = {(1, "a"): {"2019-07-01": Decimal(10), "2019-07-02": Decimal(5)}}
    history = scd2_history(frame(spark, day), KEYS, "start_time", "paymoney").withColumn(
        "paymoney", F.col("paymoney").cast("decimal(20,4)")).select(*COLUMNS)
    fixed = {(1, "a"): {"2019-07-01": Decimal(7)}}
    out = scd2_apply(history, frame(spark, fixed), KEYS, "start_time", "paymoney")
    assert got(out) == expect({(1, "a"): {"2019-07-01": Decimal(7), "2019-07-02": Decimal(5)}})


def test_withdrawn_payments_leave_the_history(spark):
    days = {(1, "a"): {"2019-07-01": Decimal(10), "2019-07-02": Decimal(5)}, (2, "a"): {"2019-07-02": Decimal(3)},
            (3, None): {"2019-07-02": Decimal(1), "2019-07-04": Decimal(2)}, (4, "b"): {"2019-07-01": Decimal(8)}}
    history = scd2_history(frame(spark, days), KEYS, "start_time", "paymoney").withColumn(
        "paymoney", F.col("paymoney").cast("decimal(20,4)")).select(*COLUMNS)
    again = {(1, "a"): {"2019-07-02": Decimal(6)}}
    out = scd2_apply(history, frame(spark, again), KEYS, "start_time", "paymoney", days=["2019-07-02"])
    want = {(1, "a"): {"2019-07-01": Decimal(10), "2019-07-02": Decimal(6)}, (3, None): {"2019-07-04": Decimal(2)},
            (4, "b"): {"2019-07-01": Decimal(8)}}
    assert sorted(map(repr, got_rows(out))) == sorted(map(repr, got_rows_of(want)))


def got_rows(df):
    return [(r.uid, r.dn, r.start_time, r.paymoney.quantize(Decimal("0.0001")), r.end_time) for r in df.collect()]


def got_rows_of(data):
    return [(u, dn, start, money.quantize(Decimal("0.0001")), end) for (u, dn), p in data.items() for start, money, end in fold(p)]
