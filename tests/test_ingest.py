import json
from decimal import Decimal

import pytest

from lectern.plans import etl
from lectern.sources.logs import clean_json, learn_records, page_records, question_records, register_records
from lectern.sources.specs import EXAM_LOGS, LOGS, MEMBER_LOGS
from lectern.sources.warehouse import SCANS, SCHEMAS, Warehouse


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_every_spec_reads_its_own_keys(spark):
    assert len(LOGS) == 23 and len(MEMBER_LOGS) == 6 and len(EXAM_LOGS) == 17
    for spec in LOGS.values():
        record = {key: "7" for f in spec.fields for key in f.keys[:1]}
        good, bad = clean_json(lines(spark, json.dumps(record)), spec)
        row = good.first()
        assert bad.count() == 0
        for f in spec.fields:
            want = {"int": 7, "text": "7"}.get(f.kind, Decimal("7.0"))
            assert row[f.name] == want, (spec.table, f.name)


def test_bad_lines_are_set_aside(spark):
    spec = LOGS["dwd_base_ad"]
    texts = ['{"adid": 1, "adname": "a", "dn": "x"}', '{"adid": "2", "more": 1}', "{}", '{"adid":', "[1]", "null", "", "  "]
    good, bad = clean_json(lines(spark, *texts), spec)
    assert sorted((r.adid, r.adname) for r in good.collect()) == [(0, None), (1, "a"), (2, None)]
    assert sorted(r.line for r in bad.collect()) == sorted(texts[3:])


def test_fail_mode_raises(spark):
    good, _ = clean_json(lines(spark, '{"adid": 1}', "oops"), LOGS["dwd_base_ad"], on_bad="fail")
    with pytest.raises(Exception, match="not a JSON object"):
        good.collect()


def test_both_spellings_of_sequence(spark):
    good, _ = clean_json(lines(spark, '{"sequnece": "3"}', '{"sequence": "4"}'), LOGS["dwd_qz_course"])
    assert sorted(r.sequence for r in good.collect()) == ["3", "4"]


def test_scores_round_half_up_and_defaults(spark):
    good, _ = clean_json(lines(spark, '{"score": 1.25}', '{"score": "1.25"}', "{}"), LOGS["dwd_qz_question"])
    assert sorted(r.score for r in good.collect()) == [Decimal("0.0"), Decimal("1.3"), Decimal("1.3")]
    good, _ = clean_json(lines(spark, "{}"), LOGS["dwd_qz_point"])
    assert good.first().score is None


def test_tsv_arity(spark):
    ok = "1002\t504\t20\t0\t1\t2019-07-12 11:17:45"
    good, bad = question_records(lines(spark, ok, ok + "\t\t", ok + "\tx", "1\t2\t3\t4\t5", "x" + ok))
    assert [tuple(r) for r in good.collect()] == [(1002, 504, 20, 0, "1", "2019-07-12 11:17:45")] * 2
    assert bad.count() == 3
    good, bad = register_records(lines(spark, "a\t1\tb", "a\t2\tb", "a\t7\tb", "a\t1"))
    assert sorted(r.platform for r in good.collect()) == ["APP", "Other", "PC"] and bad.count() == 1


def test_page_defaults(spark):
    good, bad = page_records(lines(spark, '{"uid": 5, "page_id": "1"}', "broken"))
    row = good.first()
    assert (row.uid, row.page_id, row.ip, row.next_page_id) == ("5", "1", "", "") and bad.count() == 1


def test_plays_that_cannot_be_counted(spark):
    play = {"uid": 1, "cwareid": 2, "videoid": 3, "ts": 1000, "te": 4999, "ps": 10, "pe": 20, "sourceType": "PC"}
    texts = [json.dumps(play), json.dumps({**play, "pe": 10}), json.dumps({**play, "pe": 9}),
             json.dumps({k: v for k, v in play.items() if k != "ts"}), "x"]
    good, bad = learn_records(lines(spark, *texts))
    assert sorted((r.ps, r.pe, r.seconds) for r in good.collect()) == [(10, 10, 3), (10, 20, 3)]
    assert bad.count() == 3


def test_load_log_twice_changes_nothing(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    member = {"uid": 1, "fullname": "Wang", "phone": "13812345678", "password": "p", "dt": "20190722", "dn": "a"}
    rows = [member, {**member, "uid": 2, "phone": "138", "fullname": None}, {**member, "dn": "b"}]
    (raw / "member.log").write_text("\n".join([*map(json.dumps, rows), "{bad"]) + "\n")
    wh = Warehouse(spark, str(tmp_path / "wh"))
    for _ in range(2):
        assert etl.load_log(wh, "dwd_member", str(raw), quarantine_dir=str(tmp_path / "bad")) == 1
    got = sorted((r.uid, r.fullname, r.phone, r.password, r.dn) for r in wh.read("dwd_member", "20190722").collect()
                 if r.uid == 1)
    assert got == [(1, "WXX", "138****678", "******", "a"), (1, "WXX", "138****678", "******", "b")]
    assert wh.read("dwd_member").count() == 3
    assert [r.value for r in spark.read.text(str(tmp_path / "bad" / "dwd_member")).collect()] == ["{bad"]
    with pytest.raises(Exception):
        etl.load_log(wh, "dwd_member", str(raw), on_bad="spec")


def test_late_rows_cost_nothing(spark, tmp_path):
    def load(name, *rows):
        raw = tmp_path / name
        raw.mkdir(exist_ok=True)
        (raw / "pcentermempaymoney.log").write_text("\n".join(
            json.dumps({"uid": u, "paymoney": "1", "siteid": 1, "vip_id": 1, "dt": dt, "dn": dn}) for u, dt, dn in rows) + "\n")
        return etl.load_log(wh, "dwd_pcentermempaymoney", str(raw))

    wh = Warehouse(spark, str(tmp_path / "wh"))
    load("one", (1, "20190722", "a"), (2, "20190722", "a"))
    load("two", (3, "20190723", "a"), (4, "20190722", "a"), (5, "20190722", "b"))
    load("one", (1, "20190722", "a"), (2, "20190722", "a"))
    got = sorted((r.uid, r.dt, r.dn) for r in wh.read("dwd_pcentermempaymoney").collect())
    assert got == [(1, "20190722", "a"), (2, "20190722", "a"), (3, "20190723", "a"), (4, "20190722", "a"), (5, "20190722", "b")]
    assert sorted(r.uid for r in wh.scan("payment", "20190722").collect()) == [1, 2, 4, 5]


def test_a_day_is_replaced_with_all_its_tenants(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    schema = "questionid int, errcount long, rightcount long, rate decimal(4,2), dt string, dn string"
    table = "ads_user_question_detail"
    for rows in ([(1, "20190722", "a"), (2, "20190722", "b")], [(1, "20190722", "a")]):
        df = spark.createDataFrame([(q, 1, 1, None, dt, dn) for q, dt, dn in rows], schema)
        wh.write_day(table, df, "20190722")
    wh.write_day(table, spark.createDataFrame([(7, 1, 1, None, "20190723", "b")], schema), "20190723")
    assert sorted((r.questionid, r.dt, r.dn) for r in wh.read(table).collect()) == [
        (1, "20190722", "a"), (7, "20190723", "b")]


def test_overwrite_keeps_other_partitions(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "adid int, adname string, dn string")
    wh.write("dwd_base_ad", one)
    wh.write("dwd_base_ad", spark.createDataFrame([(3, "c", "x")], "adid int, adname string, dn string"))
    assert sorted(r.adid for r in wh.read("dwd_base_ad").collect()) == [2, 3]


def test_scans_name_known_columns():
    assert len(SCANS) == 32
    for table, columns in SCANS.values():
        assert {c.split(">")[0] for c in columns} <= set(SCHEMAS[table].names), table


def test_day_filter_prunes_partitions(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "5", 1, 1, "20190101", "x"), (2, "5", 1, 1, "20190102", "x")],
                               "uid int, paymoney string, siteid int, vip_id int, dt string, dn string")
    wh.write("dwd_pcentermempaymoney", df)
    scan = wh.scan("payment", "20190102")
    assert [r.uid for r in scan.collect()] == [2]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "20190102" in plan.split("PartitionFilters")[1].split("]")[0]
