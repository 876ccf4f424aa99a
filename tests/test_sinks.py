import pytest

from lectern.sinks import tables
from lectern.sinks.tables import ChangeLog, VersionedTable
from lectern.sources.streams import run_id


def frame(spark, data):
    return spark.createDataFrame(data, "k string, num bigint")


def table(df):
    return {r.k: r.num for r in df.collect()}


def test_versions_and_replayed_batches(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), retain=2)
    assert t.read() is None
    assert t.merge(frame(spark, [("a", 1)]), 0, ["k"], add=["num"])
    assert t.merge(frame(spark, [("a", 2), ("b", 5)]), 1, ["k"], add=["num"])
    assert not t.merge(frame(spark, [("a", 2), ("b", 5)]), 1, ["k"], add=["num"])     # the batch runs again
    assert table(t.read()) == {"a": 3, "b": 5}
    assert t.merge(frame(spark, [("a", 9)]), 4, ["k"], replace=["num"])
    assert table(t.read()) == {"a": 9, "b": 5} and t.versions() == [1, 4]


def test_unfinished_version_is_not_read(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(frame(spark, [("a", 1)]))
    broken = tmp_path / "t" / "v=1"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("half")
    assert table(t.read()) == {"a": 1}
    assert t.commit(frame(spark, [("a", 2)])) and table(t.read()) == {"a": 2}


def test_a_plan_may_read_what_it_replaces(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(frame(spark, [("a", 1)]))
    t.commit(t.read().selectExpr("k", "num + 1 AS num"))
    assert table(t.read()) == {"a": 2}


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), ["k"])
    assert log.read() is None
    log.write(frame(spark, [("a", 1), ("b", 1)]), 0)
    log.write(frame(spark, [("a", 2), (None, 4)]), 1)
    log.write(frame(spark, [("a", 2), (None, 4)]), 1)        # the batch runs again
    log.write(frame(spark, [("c", 7)]), 2)
    want = {"a": 2, "b": 1, "c": 7, None: 4}
    assert table(log.read()) == want
    log.compact(1)
    assert table(log.read()) == want
    assert not log.write(frame(spark, [("a", 99)]), 1)       # too late for a folded batch
    log.write(frame(spark, [("b", 3)]), 3)
    log.compact(3)
    assert table(log.read()) == {**want, "b": 3}


def test_a_new_checkpoint_needs_a_new_output(spark, tmp_path):
    first, second = (run_id(spark, str(tmp_path / name)) for name in ("cp1", "cp2"))
    assert first == run_id(spark, str(tmp_path / "cp1")) != second
    one = frame(spark, [("a", 1)])
    for make in (lambda run: ChangeLog(spark, str(tmp_path / "log"), ["k"], run).write,
                 lambda run: VersionedTable(spark, str(tmp_path / "t"), run=run).commit):
        assert make(first)(one, 5)
        with pytest.raises(ValueError, match="another checkpoint"):
            make(second)(one, 0)
        assert make(first)(one, 6)
    assert table(ChangeLog(spark, str(tmp_path / "log"), ["k"]).read()) == {"a": 1}


def test_partitions_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """Also with more partitions than files are kept open; the session's own setting holds again afterwards."""
    key, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    before = spark.conf.get(key, None)
    writer = type(spark.range(1).write)
    monkeypatch.setattr(writer, "parquet", lambda w, path, f=writer.parquet: seen.append(int(spark.conf.get(key))) or f(w, path))
    data = [(f"k{k}", k) for k in range(3 * tables.OPEN_FILES)]
    for rebalance in (True, False):
        tables.write_partitions(frame(spark, data).repartition(2), str(tmp_path / "t"), ["k"], rebalance=rebalance)
        assert table(spark.read.parquet(str(tmp_path / "t"))) == dict(data)
    assert seen and min(seen) > 0 and spark.conf.get(key, None) == before
