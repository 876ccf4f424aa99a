"""Member subject area: wide member table, payment history and registration reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lectern.functions import scalars as S
from lectern.operators.grouping import count_by, count_by_each, first_per_key, top_n
from lectern.operators.history import scd2_apply, scd2_history
from lectern.operators.joins import left_join_all
from lectern.sinks.history import HistoryTable
from lectern.sources.warehouse import DERIVED, MONEY_SUM, Warehouse, shape

HISTORY_KEYS = ("uid", "dn")
HISTORY_COLUMNS = DERIVED["dws_member_zipper"].names

#: Report table -> column it counts registrations by.
COUNT_REPORTS = {
    "ads_register_appregurlnum": "appregurl",
    "ads_register_sitenamenum": "sitename",
    "ads_register_regsourcenamenum": "regsourcename",
    "ads_register_adnamenum": "adname",
    "ads_register_memberlevelnum": "memberlevel",
    "ads_register_viplevelnum": "vip_level",
}


def payment_totals(payment: DataFrame, vip: DataFrame) -> DataFrame:
    """Money and VIP span per member: one row per ``(uid, dn)``.

    Payments shrink to one row per VIP id before the VIP columns are joined. Among several VIP rows the
    lowest id supplies the descriptive columns.
    """
    per_vip = payment.groupBy("uid", "dn", "vip_id").agg(F.sum("paymoney").alias("_money"))
    known = vip.withColumn("_known", F.lit(True))
    lowest = F.min(F.when(F.col("_known"), F.struct("vip_id", "vip_max_free", "vip_min_free", "vip_operator")))
    return (per_vip.join(known, ["vip_id", "dn"], "left").groupBy("uid", "dn")
            .agg(F.sum("_money").alias("paymoney"), F.max("vip_level").alias("vip_level"),
                 F.min("vip_start_time").alias("vip_start_time"), F.max("vip_end_time").alias("vip_end_time"),
                 F.max("vip_last_modify_time").alias("vip_last_modify_time"),
                 F.max("vip_next_level").alias("vip_next_level"), lowest.alias("_v"))
            .select("uid", "dn", "paymoney", "vip_level", "vip_start_time", "vip_end_time", "vip_last_modify_time",
                    "vip_next_level", "_v.vip_id", "_v.vip_max_free", "_v.vip_min_free", "_v.vip_operator"))


def member_wide(member: DataFrame, regtype: DataFrame, ad: DataFrame, website: DataFrame, payment: DataFrame,
                vip: DataFrame) -> DataFrame:
    """One wide row per ``(uid, dn, dt)``.

    Registration rows are reduced to the earliest per member and payments to one total before the joins,
    so the joins never multiply money. Members without payments have 0.
    """
    base = first_per_key(member, ("uid", "dn", "dt"), ("register",))
    # both joins on the member id come first: they share one partitioning of the members
    joined = left_join_all(
        base,
        (first_per_key(regtype, ("uid", "dn"), ("reg_createtime",)), ("uid", "dn")),
        (payment_totals(payment, vip), ("uid", "dn")),
        (ad, ("ad_id", "dn")),
        (website.withColumn("_site", F.lit(True)), ("siteid", "dn")))
    # the site id of a member is the id of a known site
    return shape(joined.withColumns({
        "siteid": F.when(F.col("_site"), F.col("siteid")),
        "paymoney": F.coalesce(F.col("paymoney"), F.lit(0)).cast(MONEY_SUM)}), "dws_member")


def daily_payments(payment: DataFrame, vip: DataFrame) -> DataFrame:
    """Money and highest VIP level per member and payment day; payments with an unknown VIP id drop out."""
    return (payment.join(vip.select("vip_id", "dn", "vip_level"), ["vip_id", "dn"], "inner")
            .groupBy("uid", "dn", "dt")
            .agg(F.sum("paymoney").cast(MONEY_SUM).alias("paymoney"), F.max("vip_level").alias("vip_level"))
            .select("uid", "paymoney", "vip_level", S.day_to_iso(F.col("dt")).alias("start_time"), "dn"))


def payment_history(payment: DataFrame, vip: DataFrame) -> DataFrame:
    """The whole history from all payment days at once."""
    daily = daily_payments(payment, vip)
    return (scd2_history(daily, HISTORY_KEYS, "start_time", "paymoney")
            .withColumn("paymoney", F.col("paymoney").cast(MONEY_SUM)).select(*HISTORY_COLUMNS))


def apply_payments(history: DataFrame, daily: DataFrame, days: Sequence[str] = ()) -> DataFrame:
    """History plus new daily rows; re-runs (of ``days``, withdrawn payments included) and late days are handled by the fold."""
    return scd2_apply(history, daily, HISTORY_KEYS, "start_time", "paymoney", days=days)


def top_payers(members: DataFrame, n: int = 3) -> DataFrame:
    """Best payers per tenant and member level; equal sums are ordered by member id."""
    ranked = top_n(members, ("dn", "memberlevel"), [F.col("paymoney").desc(), F.col("uid").asc()], n)
    return shape(ranked, "ads_register_top3memberpay")


def history_table(wh: Warehouse) -> HistoryTable:
    """The stored payment history; its daily commit leaves closed versions alone."""
    return wh.history("dws_member_zipper", HISTORY_KEYS, "start_time", "paymoney")


def fold_payments(wh: Warehouse, dt: str) -> None:
    """Fold the payments of a day into the stored history; a day that runs again replaces itself."""
    day = f"{dt[:4]}-{dt[4:6]}-{dt[6:8]}"
    history_table(wh).commit(daily_payments(wh.scan("payment", dt), wh.scan("vip")), [day])


def build_member(wh: Warehouse, dt: str) -> None:
    """Daily job: refresh the wide table of the day and fold its payments into the history.

    Registrations and payments count up to the day, so that a re-run of an old day gives what its first run gave.
    """
    vip = wh.scan("vip")
    wh.write_day("dws_member", member_wide(
        wh.scan("member", dt), wh.scan_until("regtype", dt), wh.scan("ad"), wh.scan("website"),
        wh.scan_until("payment", dt), vip), dt)
    fold_payments(wh, dt)


def report_members(wh: Warehouse, dt: str) -> None:
    """Daily job: six registration counts from one scan, and the top payers."""
    members = wh.scan("member_report", dt)
    counts = count_by_each(members, list(COUNT_REPORTS.values())).persist()
    try:
        for table, key in COUNT_REPORTS.items():
            wh.write_day(table, counts.where(F.col("dim") == key).withColumnRenamed("key", key), dt)
    finally:
        counts.unpersist()
    wh.write_day("ads_register_top3memberpay", top_payers(members), dt)


def registration_count(members: DataFrame, key: str) -> DataFrame:
    return count_by(members, key)
