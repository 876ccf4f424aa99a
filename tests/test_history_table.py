"""The stored history against one fold over everything, commit by commit."""

import random
from decimal import Decimal

import pytest

from test_history import COLUMNS, KEYS, SCHEMA, expect, frame, got, sample

from lectern.sinks.history import HistoryTable


def table_at(spark, path, **options):
    return HistoryTable(spark, str(path / "h"), KEYS, "start_time", "paymoney", buckets=4, **options)


def closed_files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.glob("h/v=*/_state=closed/*/*.parquet")}


def test_days_in_order_leave_closed_versions_alone(spark, tmp_path):
    days, data = sample(3)
    table = table_at(spark, tmp_path, fold_every=5)
    assert table.read() is None
    for i in range(0, 15, 5):
        before = closed_files(tmp_path)
        assert table.commit(frame(spark, data, lambda d: d in days[i:i + 5]))
        assert before.items() <= closed_files(tmp_path).items()     # nothing rewritten, nothing dropped
        part = {k: {d: m for d, m in p.items() if d <= days[i + 4]} for k, p in data.items()}
        assert got(table.read()) == expect(part)
    assert got(table_at(spark, tmp_path).read(1)) == expect(
        {k: {d: m for d, m in p.items() if d <= days[9]} for k, p in data.items()})


def test_late_days_reruns_withdrawals_and_folding(spark, tmp_path):
    days, data = sample(4)
    order = days[:]
    random.Random(6).shuffle(order)
    table = table_at(spark, tmp_path, fold_every=2, retain=2)
    for chunk in (order[:6], order[6:10], order[10:15], order[15:], order[3:5]):
        table.commit(frame(spark, data, lambda d: d in chunk), chunk)
    assert got(table.read()) == expect(data)
    gone = {k: {d: m for d, m in p.items() if d != days[7]} for k, p in data.items()}
    assert table.commit(frame(spark, {}), [days[7]])                # all payments of a day withdrawn
    assert got(table.read()) == expect(gone) and table.versions() == [4, 5]
    for _ in range(2):                                               # runs that bring nothing new
        table.commit(frame(spark, gone, lambda d: d == days[-1]), [days[-1]])
    assert got(table.read()) == expect(gone)
    whole = len(table.read().collect())
    stored = spark.read.option("basePath", str(tmp_path / "h")).parquet(*[str(p) for p in tmp_path.glob("h/v=*")]).count()
    assert stored <= 3 * whole                                       # dead folders went


def test_folding_keeps_rows(spark, tmp_path):
    table = table_at(spark, tmp_path, fold_every=2, retain=1)
    data = {(u, None): {f"2019-07-{d:02d}": Decimal(u + d) for d in range(1, 8)} for u in range(6)}
    for d in range(1, 8):
        table.commit(frame(spark, data, lambda day: day == f"2019-07-{d:02d}"))
    assert sorted(map(repr, got_null(table.read()))) == sorted(map(repr, expect_null(data)))
    assert max(int(p.parent.name[-1]) for p in tmp_path.glob("h/v=*/_state=closed")) == 6
    assert not list(tmp_path.glob("h/v=1/_state=closed/_bucket=*"))


def got_null(df):
    return [(r.uid, r.dn, r.start_time, r.paymoney.quantize(Decimal("0.0001")), r.end_time) for r in df.collect()]


def expect_null(data):
    from test_history import fold
    return [(u, dn, start, money.quantize(Decimal("0.0001")), end)
            for (u, dn), p in data.items() for start, money, end in fold(p)]


def test_half_a_commit_is_not_read_and_runs_again(spark, tmp_path, monkeypatch):
    days, data = sample(5)
    table = table_at(spark, tmp_path)
    table.commit(frame(spark, data, lambda d: d < days[10]), version=7)
    with monkeypatch.context() as patch:
        patch.setattr(HistoryTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.commit(frame(spark, data, lambda d: d >= days[10]), version=8)
    part = {k: {d: m for d, m in p.items() if d < days[10]} for k, p in data.items()}
    assert got(table.read()) == expect(part)
    assert table.commit(frame(spark, data, lambda d: d >= days[10]), version=8)
    assert not table.commit(frame(spark, data), version=8)
    assert got(table.read()) == expect(data)


def test_no_rows(spark, tmp_path):
    table = table_at(spark, tmp_path)
    table.commit(spark.createDataFrame([], SCHEMA))
    assert table.read().count() == 0
    table.commit(frame(spark, {(1, "a"): {"2019-07-01": Decimal(3)}}))
    assert got(table.read()) == expect({(1, "a"): {"2019-07-01": Decimal(3)}})
    assert sorted(table.read().columns) == sorted(COLUMNS)
