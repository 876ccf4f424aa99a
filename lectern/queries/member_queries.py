"""Member-area queries over the supplied tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.operators.grouping import count_by_each
from lectern.operators.history import scd2_history
from lectern.operators.upsert import upsert
from lectern.plans import etl, member
from lectern.queries.roles import DAY, Roles, TENANT, land_logs
from lectern.session import materialize, work_dir
from lectern.sinks.history import HistoryTable
from lectern.sources.warehouse import Warehouse

WIDE_COLUMNS = (
    "uid dn dt ad_id fullname memberlevel password phone register zipcode appkey appregurl reg_createtime regsource "
    "regsourcename adname siteid sitename site_creator vip_id vip_level vip_start_time vip_end_time vip_max_free "
    "vip_next_level").split()


def money(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def member_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Roles(spark, sf_dir).members().select(*WIDE_COLUMNS, money("paymoney"))


def register_count(key: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return member.registration_count(Roles(spark, sf_dir).members(), key)
    return run


def register_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_each(Roles(spark, sf_dir).members(), list(member.COUNT_REPORTS.values()))


def top3_payers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member.top_payers(Roles(spark, sf_dir).members()).withColumn("paymoney", F.col("paymoney").cast("double"))


def payment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Roles(spark, sf_dir)
    return member.payment_totals(r.payment(), r.vip()).select(
        "uid", "dn", money("paymoney"), "vip_id", "vip_level", "vip_start_time", "vip_end_time", "vip_next_level")


def daily_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Roles(spark, sf_dir)
    return member.daily_payments(r.payment(), r.vip()).withColumn("paymoney", F.col("paymoney").cast("double"))


def member_zipper(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Roles(spark, sf_dir)
    return member.payment_history(r.payment(), r.vip()).withColumn("paymoney", F.col("paymoney").cast("double"))


def member_zipper_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of all days before 1998, then the later days folded in, then 1996 run again (a late re-run)."""
    r = Roles(spark, sf_dir)
    daily = materialize(member.daily_payments(r.payment(), r.vip()), "daily-payments")
    day = F.col("start_time")
    old = scd2_history(daily.where(day < "1998-01-01"), member.HISTORY_KEYS, "start_time", "paymoney").select(
        *member.HISTORY_COLUMNS)
    later = member.apply_payments(old, daily.where(day >= "1998-01-01"))
    again = member.apply_payments(later, daily.where((day >= "1996-01-01") & (day < "1997-01-01")))
    return again.withColumn("paymoney", F.col("paymoney").cast("double"))


def member_zipper_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of all days, then 1996 run again without the payments that were withdrawn from it (every third order)."""
    r = Roles(spark, sf_dir)
    all_days = materialize(member.payment_history(r.payment(), r.vip()), "history")
    year = F.year("o_orderdate") == 1996
    left = r.raw_payment_of(r.t("orders").where(year & (F.col("o_orderkey") % 3 != 0)))
    daily = materialize(member.daily_payments(left, r.vip()), "daily-payments")
    days = [row[0] for row in r.t("orders").where(year).select(
        F.date_format("o_orderdate", "yyyy-MM-dd")).distinct().collect()]  # the days of a year
    return member.apply_payments(all_days, daily, days).withColumn("paymoney", F.col("paymoney").cast("double"))


def member_history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored history after four commits: days before 1997, those of 1997, all later ones, and 1996 run again without
    the payments that were withdrawn from it (every third order)."""
    r = Roles(spark, sf_dir)
    table = HistoryTable(spark, work_dir(spark, "history"), member.HISTORY_KEYS, "start_time", "paymoney", buckets=8)
    daily = materialize(member.daily_payments(r.payment(), r.vip()), "daily-payments")
    day = F.col("start_time")
    for days in (day < "1997-01-01", day.startswith("1997"), day >= "1998-01-01"):
        table.commit(daily.where(days))
    left = r.t("orders").where((F.year("o_orderdate") == 1996) & (F.col("o_orderkey") % 3 != 0))
    again = [row[0] for row in daily.where(day.startswith("1996")).select("start_time").distinct().collect()]  # days of a year
    table.commit(member.daily_payments(r.raw_payment_of(left), r.vip()), again)
    return table.read().withColumn("paymoney", F.col("paymoney").cast("double"))


def job_member_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of the daily member job over three days of raw payments (a third of a year each), the second run twice."""
    r = Roles(spark, sf_dir)
    folder = work_dir(spark, "history-job")
    wh = Warehouse(spark, folder)
    land_logs({
        "dwd_member": r.raw_member(), "dwd_member_regtype": r.raw_regtype(), "dwd_base_ad": r.raw_ad(),
        "dwd_base_website": r.raw_website(), "dwd_vip_level": r.raw_vip(),
        "dwd_pcentermempaymoney": r.raw_payment().withColumn(
            "dt", F.concat(F.lit("2024010"), F.expr("(CAST(substring(dt, 5, 2) AS int) - 1) div 4 + 1").cast("string")))},
        f"{folder}/logs")
    etl.load_member_logs(wh, f"{folder}/logs")
    for dt in ("20240101", "20240102", "20240103", "20240102"):
        member.fold_payments(wh, dt)
    return member.history_table(wh).read().withColumn("paymoney", F.col("paymoney").cast("double"))


def _totals(r: Roles, later: bool) -> DataFrame:
    """Order totals per customer before / from 1998 on."""
    side = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return (r.t("orders").where(side if later else ~side).groupBy("o_custkey")
            .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.count("o_orderkey").alias("num"),
                 F.max("o_orderpriority").alias("priority")))


def upsert_query(add: tuple[str, ...], replace: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = Roles(spark, sf_dir)
        merged = upsert(_totals(r, False), _totals(r, True), ["o_custkey"], add=add, replace=replace)
        return merged.withColumn("total", F.col("total").cast("double"))
    return run


def job_member_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily member job from its six raw logs on: loads, wide table, history, seven reports."""
    r = Roles(spark, sf_dir)
    folder = work_dir(spark, "member-job")
    wh = Warehouse(spark, folder)
    raw = {
        "dwd_member": r.raw_member(), "dwd_member_regtype": r.raw_regtype(), "dwd_base_ad": r.raw_ad(),
        "dwd_base_website": r.raw_website(), "dwd_vip_level": r.raw_vip(), "dwd_pcentermempaymoney": r.raw_payment().withColumn("dt", F.lit(DAY))}
    land_logs(raw, f"{folder}/logs")
    etl.load_member_logs(wh, f"{folder}/logs")
    member.build_member(wh, DAY)
    member.report_members(wh, DAY)
    reports = [wh.read(table, DAY).selectExpr(f"'{key}' AS dim", f"{key} AS key", "num", "dt", "dn")
               for table, key in member.COUNT_REPORTS.items()]
    top = wh.read("ads_register_top3memberpay", DAY).selectExpr(
        "'top3' AS dim", "concat_ws('/', memberlevel, rownum, uid) AS key", "CAST(rownum AS bigint) AS num", "dt", "dn")
    out = top
    for report in reports:
        out = out.unionByName(report)
    return out


# --- SQL twins -------------------------------------------------------------------------------------

_SOURCE = ("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'PC' WHEN '2' THEN 'Mobile' WHEN '3' THEN 'APP' "
           "WHEN '4' THEN 'WeChat' ELSE 'other' END")
_CUST, _ORD = TENANT.format(key="c_custkey"), TENANT.format(key="o_custkey")

PAYMENTS = f"""
payment AS (
  SELECT o_custkey AS uid, {_ORD} AS dn, CAST(o_totalprice AS decimal(10,4)) AS paymoney,
         CAST(substr(o_orderpriority, 1, 1) AS int) AS vip_id, strftime(o_orderdate, '%Y-%m-%d') AS start_time
  FROM orders),
vip AS (
  SELECT r_regionkey AS vip_id, 'V' || r_regionkey AS vip_level, '2020-01-0' || (r_regionkey + 1) AS vip_start_time,
         '2030-01-0' || (r_regionkey + 1) AS vip_end_time, CAST(r_regionkey * 10 AS varchar) AS vip_max_free,
         'V' || (r_regionkey + 1) AS vip_next_level
  FROM region),
totals AS (
  SELECT p.uid, p.dn, sum(p.paymoney) AS paymoney, max(v.vip_level) AS vip_level,
         min(v.vip_start_time) AS vip_start_time, max(v.vip_end_time) AS vip_end_time,
         max(v.vip_next_level) AS vip_next_level, min(v.vip_id) AS vip_id
  FROM payment p LEFT JOIN vip v ON p.vip_id = v.vip_id GROUP BY p.uid, p.dn),
daily AS (
  SELECT p.uid, sum(p.paymoney) AS paymoney, max(v.vip_level) AS vip_level, p.start_time, p.dn
  FROM payment p JOIN vip v ON p.vip_id = v.vip_id GROUP BY p.uid, p.dn, p.start_time)"""

MEMBERS = f"""{PAYMENTS},
reg_all AS (
  SELECT o_custkey AS uid, {_ORD} AS dn, o_orderstatus AS appkey,
         'http://app/' || substr(o_orderpriority, 1, 1) AS appregurl,
         strftime(o_orderdate, '%Y-%m-%d') AS reg_createtime, substr(o_orderpriority, 1, 1) AS regsource,
         {_SOURCE} AS regsourcename, o_orderkey % 30 AS websiteid
  FROM orders),
reg AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, dn ORDER BY reg_createtime, appkey, appregurl,
         regsource, regsourcename, websiteid) AS rn FROM reg_all) WHERE rn = 1),
members AS (
  SELECT c_custkey AS uid, {_CUST} AS dn, '20240101' AS dt, c_nationkey % 5 AS ad_id,
         substr(c_name, 1, 1) || 'XX' AS fullname, c_mktsegment AS memberlevel, '******' AS password,
         '138' || '****' || substr('138' || lpad(CAST(c_custkey AS varchar), 8, '0'), 9, 3) AS phone,
         '2024-01-01' AS register, CAST(c_nationkey AS varchar) AS zipcode, reg.appkey, reg.appregurl,
         reg.reg_createtime, reg.regsource, reg.regsourcename, r_name || '@' || {_CUST} AS adname,
         n.n_nationkey AS siteid, n.n_name || '.' || {_CUST} AS sitename, CAST(n.n_regionkey AS varchar) AS site_creator,
         t.vip_id, t.vip_level, t.vip_start_time, t.vip_end_time, CAST(t.vip_id * 10 AS varchar) AS vip_max_free,
         t.vip_next_level, coalesce(t.paymoney, 0) AS paymoney
  FROM customer
  LEFT JOIN reg ON reg.uid = c_custkey
  LEFT JOIN region ON r_regionkey = c_nationkey % 5
  LEFT JOIN nation n ON n.n_nationkey = reg.websiteid
  LEFT JOIN totals t ON t.uid = c_custkey)"""

_HISTORY = f"""WITH {PAYMENTS}
SELECT uid, CAST(sum(paymoney) OVER w AS double) AS paymoney, vip_level, start_time,
       coalesce(lead(start_time) OVER (PARTITION BY uid, dn ORDER BY start_time), '9999-12-31') AS end_time, dn
FROM daily
WINDOW w AS (PARTITION BY uid, dn ORDER BY start_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

_WITHDRAWN = _HISTORY.replace("  FROM orders)", "  FROM orders WHERE NOT (year(o_orderdate) = 1996 AND o_orderkey % 3 = 0))", 1)


def _count_sql(key: str) -> str:
    return f"WITH {MEMBERS} SELECT {key}, count(uid) AS num, dt, dn FROM members GROUP BY {key}, dn, dt"


_DIMS = " UNION ALL ".join(
    f"SELECT '{key}' AS dim, {key} AS key, count(uid) AS num, dt, dn FROM members GROUP BY {key}, dn, dt"
    for key in member.COUNT_REPORTS.values())
_TOP3 = """SELECT * FROM (SELECT uid, memberlevel, register, appregurl, regsourcename, adname, sitename, vip_level,
       CAST(paymoney AS double) AS paymoney,
       row_number() OVER (PARTITION BY dn, memberlevel ORDER BY paymoney DESC, uid) AS rownum, dt, dn
FROM members) WHERE rownum < 4"""

_SIDES = """WITH old AS (
  SELECT o_custkey, sum(CAST(o_totalprice AS decimal(18,2))) AS total, count(*) AS num, max(o_orderpriority) AS priority
  FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_custkey),
new AS (
  SELECT o_custkey, sum(CAST(o_totalprice AS decimal(18,2))) AS total, count(*) AS num, max(o_orderpriority) AS priority
  FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey) """

COUNT_QUERIES = {"url": "appregurl", "site": "sitename", "source": "regsourcename", "ad": "adname",
                 "level": "memberlevel", "vip": "vip_level"}

QUERIES = {
    "member_wide": member_wide,
    **{f"register_count_{name}": register_count(key) for name, key in COUNT_QUERIES.items()},
    "register_counts": register_counts,
    "top3_payers": top3_payers,
    "payment_totals": payment_totals,
    "daily_payment": daily_payment,
    "member_zipper": member_zipper,
    "member_zipper_incremental": member_zipper_incremental,
    "member_zipper_rerun": member_zipper_rerun,
    "member_history_table": member_history_table,
    "job_member_history": job_member_history,
    "upsert_replace": upsert_query((), ("total", "num", "priority")),
    "upsert_add": upsert_query(("total", "num"), ("priority",)),
    "job_member_reports": job_member_reports,
}

SQL = {
    "member_wide": f"WITH {MEMBERS} SELECT {', '.join(WIDE_COLUMNS)}, CAST(paymoney AS double) AS paymoney FROM members",
    **{f"register_count_{name}": _count_sql(key) for name, key in COUNT_QUERIES.items()},
    "register_counts": f"WITH {MEMBERS} {_DIMS}",
    "top3_payers": f"WITH {MEMBERS} {_TOP3}",
    "payment_totals": f"WITH {PAYMENTS} SELECT uid, dn, CAST(paymoney AS double) AS paymoney, vip_id, vip_level, "
                      "vip_start_time, vip_end_time, vip_next_level FROM totals",
    "daily_payment": f"WITH {PAYMENTS} SELECT uid, CAST(paymoney AS double) AS paymoney, vip_level, start_time, dn "
                     "FROM daily",
    "member_zipper": _HISTORY,
    "member_zipper_incremental": _HISTORY,
    "member_zipper_rerun": _WITHDRAWN,
    "member_history_table": _WITHDRAWN,
    "job_member_history": _HISTORY.replace(
        "strftime(o_orderdate, '%Y-%m-%d') AS start_time",
        "'2024-01-0' || ((month(o_orderdate) - 1) // 4 + 1) AS start_time", 1),
    "upsert_replace": _SIDES + """SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey,
        CAST(CASE WHEN n.o_custkey IS NOT NULL THEN n.total ELSE o.total END AS double) AS total,
        CASE WHEN n.o_custkey IS NOT NULL THEN n.num ELSE o.num END AS num,
        CASE WHEN n.o_custkey IS NOT NULL THEN n.priority ELSE o.priority END AS priority
        FROM old o FULL JOIN new n ON o.o_custkey = n.o_custkey""",
    "upsert_add": _SIDES + """SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey,
        CAST(coalesce(o.total, 0) + coalesce(n.total, 0) AS double) AS total,
        coalesce(o.num, 0) + coalesce(n.num, 0) AS num,
        CASE WHEN n.o_custkey IS NOT NULL THEN n.priority ELSE o.priority END AS priority
        FROM old o FULL JOIN new n ON o.o_custkey = n.o_custkey""",
    "job_member_reports": f"WITH {MEMBERS} {_DIMS} UNION ALL SELECT 'top3', memberlevel || '/' || rownum || '/' || uid, "
                          f"rownum, dt, dn FROM ({_TOP3})",
}
