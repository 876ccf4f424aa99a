import json
from decimal import Decimal

import pytest

from lectern.plans import etl, member
from lectern.sources.warehouse import Warehouse

DAY, NEXT = "20190722", "20190723"


def raw_logs(folder, day):
    """Two tenants share id 1; member 2 has two payments and two registrations; member 3 nothing."""
    logs = {
        "baswewebsite.log": [{"siteid": 1, "sitename": "s_1", "dn": "a"}, {"siteid": 1, "sitename": "t-1", "dn": "b"}],
        "baseadlog.log": [{"adid": 5, "adname": "ad5", "dn": "a"}],
        "member.log": [
            {"uid": u, "ad_id": 5, "fullname": "Li", "phone": "13812345678", "memberlevel": "L1", "register": "2019",
             "dt": day, "dn": dn} for u, dn in ((1, "a"), (1, "b"), (2, "a"), (3, "a"))],
        "memberRegtype.log": [
            {"uid": u, "appregurl": url, "createtime": t, "regsourcename": code, "websiteid": 1, "dt": day, "dn": dn}
            for u, url, t, code, dn in ((1, "u_1", "1", "1", "a"), (1, "u-2", "1", "9", "b"), (2, "late", "2", "3", "a"),
                                        (2, "early", "1", "2", "a"))],
        "pcentermempaymoney.log": [
            {"uid": u, "paymoney": m, "siteid": 1, "vip_id": v, "dt": day, "dn": dn}
            for u, m, v, dn in ((1, "10.5", 1, "a"), (1, "99", 1, "b"), (2, "1.25", 1, "a"), (2, "2.25", 2, "a"),
                                (2, "4", 9, "a"))],
        "pcenterMemViplevel.log": [
            {"vip_id": i, "vip_level": f"v{i}", "start_time": f"200{i}", "end_time": f"203{i}", "next_level": f"v{i + 1}",
             "dn": dn} for i in (1, 2) for dn in "ab"],
    }
    folder.mkdir(exist_ok=True)
    for name, records in logs.items():
        (folder / name).write_text("\n".join(map(json.dumps, records)) + "\n")
    return str(folder)


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("member")
    wh = Warehouse(spark, str(root / "wh"))
    for day in (DAY, NEXT, NEXT):          # the second day runs twice
        etl.load_member_logs(wh, raw_logs(root / day, day))
        member.build_member(wh, day)
        member.report_members(wh, day)
    return wh


def test_wide_rows(warehouse):
    rows = {(r.uid, r.dn): r for r in warehouse.read("dws_member", DAY).collect()}
    assert len(rows) == 4
    two = rows[(2, "a")]
    assert (two.appregurl, two.regsourcename, two.adname, two.sitename) == ("early", "Mobile", "ad5", "s_1")
    assert two.paymoney == Decimal("7.5") and two.vip_level == "v2" and two.vip_id == 1
    assert (two.vip_start_time, two.vip_end_time, two.vip_next_level) == ("2001", "2032", "v3")
    assert rows[(1, "a")].paymoney == Decimal("10.5") and rows[(1, "b")].paymoney == Decimal("99")
    assert rows[(1, "b")].adname is None and rows[(1, "b")].sitename == "t-1"
    three = rows[(3, "a")]
    assert (three.paymoney, three.appregurl, three.siteid) == (0, None, None)


def test_second_day_totals_do_not_multiply(warehouse):
    rows = {(r.uid, r.dn): r.paymoney for r in warehouse.read("dws_member", NEXT).collect()}
    assert rows[(2, "a")] == Decimal("15") and rows[(1, "a")] == Decimal("21")


def test_history(warehouse):
    rows = sorted((r.uid, r.dn, r.paymoney, r.start_time, r.end_time)
                  for r in member.history_table(warehouse).read().collect())
    one, two, b = Decimal("10.5"), Decimal("3.5"), Decimal(99)
    assert rows == [
        (1, "a", one, "2019-07-22", "2019-07-23"), (1, "a", one * 2, "2019-07-23", "9999-12-31"),
        (1, "b", b, "2019-07-22", "2019-07-23"), (1, "b", b * 2, "2019-07-23", "9999-12-31"),
        (2, "a", two, "2019-07-22", "2019-07-23"), (2, "a", two * 2, "2019-07-23", "9999-12-31")]


def test_reports(warehouse):
    for day in (DAY, NEXT):
        urls = {(r.appregurl, r.dn): r.num for r in warehouse.read("ads_register_appregurlnum", day).collect()}
        assert urls == {("u_1", "a"): 1, ("u-2", "b"): 1, ("early", "a"): 1, (None, "a"): 1}
        sources = {(r.regsourcename, r.dn): r.num for r in warehouse.read("ads_register_regsourcenamenum", day).collect()}
        assert sources == {("PC", "a"): 1, ("other", "b"): 1, ("Mobile", "a"): 1, (None, "a"): 1}
        top = sorted((r.dn, r.rownum, r.uid) for r in warehouse.read("ads_register_top3memberpay", day).collect())
        assert top == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1)]
