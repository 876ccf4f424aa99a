"""Raw-log queries (JSON and tab-separated ingest, masking, decoding) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions import scalars as S
from lectern.plans import etl
from lectern.queries.roles import Roles, SCORE, TENANT
from lectern.session import work_dir
from lectern.sources.logs import clean_json, question_records, split_json
from lectern.sources.specs import LOGS
from lectern.sources.streams import replay_to_dir
from lectern.sources.warehouse import Warehouse


def payment_lines(r: Roles) -> DataFrame:
    """Payment log: bare, quoted and missing site ids."""
    return r.t("orders").selectExpr(f"""to_json(struct(
        o_custkey AS uid, CAST(o_totalprice AS string) AS paymoney,
        CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 30 AS string) END AS siteid,
        substring(o_orderpriority, 1, 1) AS vip_id, date_format(o_orderdate, 'yyyyMMdd') AS dt,
        {TENANT.format(key='o_custkey')} AS dn, 'x' AS unused)) AS value""")


def etl_json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = clean_json(payment_lines(Roles(spark, sf_dir)), LOGS["dwd_pcentermempaymoney"])
    return rows.withColumn("paymoney", F.col("paymoney").cast("double"))


def etl_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer log with scores of two decimals, rounded half up to one."""
    lines = Roles(spark, sf_dir).t("lineitem").selectExpr(f"""to_json(struct(
        l_orderkey AS userid, l_suppkey AS paperviewid, l_partkey AS questionid, l_linenumber AS spendtime,
        CAST(CAST(l_extendedprice AS decimal(18,2)) AS string) AS score, l_linestatus AS useranswer,
        '20240101' AS dt, {TENANT.format(key='l_orderkey')} AS dn)) AS value""")
    rows, _ = clean_json(lines, LOGS["dwd_qz_member_paper_question"])
    return rows.select("userid", "paperviewid", "questionid", "spendtime", "chapterid", "useranswer", "istrue",
                       F.col("score").cast("double").alias("score"), "dt", "dn")


def etl_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad lines of an event log with broken, empty, array and null lines."""
    lines = Roles(spark, sf_dir).t("events").selectExpr("""CASE event_id % 10
        WHEN 0 THEN '{"uid": 1' WHEN 1 THEN '[1]' WHEN 2 THEN '' WHEN 3 THEN 'null' WHEN 4 THEN '{}'
        ELSE props END AS value""")
    good, bad = split_json(lines, LOGS["dwd_member"].json_schema)
    return good.select(F.lit("good").alias("kind")).unionByName(bad.select(F.lit("bad").alias("kind"))).groupBy(
        "kind").agg(F.count(F.lit(1)).alias("num"))


def tsv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer log with lines of five and seven fields, trailing tabs and non-numeric ids."""
    lines = Roles(spark, sf_dir).question_lines("event_id").selectExpr("""CASE event_id % 7
        WHEN 0 THEN substring_index(value, '\\t', 5) WHEN 1 THEN concat(value, '\\tmore')
        WHEN 2 THEN concat(value, '\\t\\t') WHEN 3 THEN concat('x', value) ELSE value END AS value""")
    good, bad = question_records(lines)
    rows = good.withColumn("kind", F.lit("good"))
    return rows.unionByName(bad.groupBy(F.length("line").alias("courseid")).agg(
        F.count(F.lit(1)).cast("int").alias("uid")).withColumn("kind", F.lit("bad")), allowMissingColumns=True)


def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.mask_member(Roles(spark, sf_dir).raw_member()).select("uid", "fullname", "phone", "password")


def decode_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.substring("o_orderpriority", 1, 1)
    return Roles(spark, sf_dir).t("orders").select(
        "o_orderkey", S.source_name(code).alias("source"), S.platform_name(code).alias("platform"))


def half_up_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    return Roles(spark, sf_dir).t("lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", S.half_up(price).cast("double").alias("score"))


def score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = Roles(spark, sf_dir).t("lineitem").selectExpr("l_orderkey", f"{SCORE} AS score")
    return scored.groupBy(S.score_band(F.col("score")).alias("band")).agg(
        F.count(F.lit(1)).alias("num"), F.min("l_orderkey").alias("first_key"))


def date_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = Roles(spark, sf_dir).t("orders").select("o_orderkey", S.day_of(F.col("o_orderdate")).alias("day"))
    return days.withColumn("iso", S.day_to_iso(F.col("day")))


def etl_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads whose days (one a month here) overlap: payments of even orders, of odd ones, and the first load again."""
    wh = Warehouse(spark, work_dir(spark, "late-rows"))
    table = "dwd_pcentermempaymoney"
    lines = Roles(spark, sf_dir).t("orders").selectExpr("o_orderkey % 2 AS half", f"""to_json(struct(
        o_custkey AS uid, CAST(o_totalprice AS string) AS paymoney, o_orderkey % 30 AS siteid,
        substring(o_orderpriority, 1, 1) AS vip_id, date_format(trunc(o_orderdate, 'MM'), 'yyyyMMdd') AS dt,
        {TENANT.format(key='o_custkey')} AS dn)) AS value""")
    for half in (0, 1, 0):
        raw = work_dir(spark, "late-raw")
        lines.where(F.col("half") == half).select("value").write.text(f"{raw}/{LOGS[table].file}")
        etl.load_log(wh, table, raw)
    return wh.read(table).groupBy("dt", "dn").agg(
        F.count(F.lit(1)).alias("num"), F.sum("uid").alias("uids"), F.sum("siteid").alias("sites"),
        F.min("vip_id").alias("vip_id"))


def replay_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines published to a watched directory, counted back by event type."""
    path = work_dir(spark, "replay")
    replay_to_dir(Roles(spark, sf_dir).page_lines(), path)
    return spark.read.text(path).groupBy(F.get_json_object("value", "$.page_id").alias("page_id")).agg(
        F.count(F.lit(1)).alias("num"))


_DN = TENANT.format(key="o_custkey")
_TYPE = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END"
EVENTS = f"""e AS (SELECT event_id, ts, user_id, event_type, value, {_TYPE} AS code,
    CAST(json_extract_string(props, '$.k') AS int) AS k FROM events)"""

QUERIES = {
    "etl_json_ingest": etl_json_ingest,
    "etl_answers": etl_answers,
    "etl_quarantine": etl_quarantine,
    "etl_late_rows": etl_late_rows,
    "tsv_ingest": tsv_ingest,
    "mask_pii": mask_pii,
    "decode_codes": decode_codes,
    "half_up_score": half_up_score,
    "score_band": score_band,
    "date_key": date_key,
    "replay_publish": replay_publish,
}

SQL = {
    "etl_json_ingest": f"""SELECT o_custkey AS uid, o_totalprice AS paymoney,
        CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 30 ELSE 0 END AS siteid,
        CAST(substr(o_orderpriority, 1, 1) AS int) AS vip_id, strftime(o_orderdate, '%Y%m%d') AS dt, {_DN} AS dn
        FROM orders""",
    "etl_answers": f"""SELECT l_orderkey AS userid, l_suppkey AS paperviewid, l_partkey AS questionid,
        l_linenumber AS spendtime, 0 AS chapterid, l_linestatus AS useranswer, NULL AS istrue,
        CAST(round(CAST(l_extendedprice AS decimal(18,2)), 1) AS double) AS score, '20240101' AS dt,
        {TENANT.format(key='l_orderkey')} AS dn FROM lineitem""",
    "etl_quarantine": """SELECT CASE WHEN event_id % 10 < 4 THEN 'bad' ELSE 'good' END AS kind, count(*) AS num
        FROM events GROUP BY 1""",
    "etl_late_rows": f"""SELECT strftime(date_trunc('month', o_orderdate), '%Y%m%d') AS dt, {_DN} AS dn, count(*) AS num,
        CAST(sum(o_custkey) AS bigint) AS uids, CAST(sum(o_orderkey % 30) AS bigint) AS sites,
        min(CAST(substr(o_orderpriority, 1, 1) AS int)) AS vip_id FROM orders GROUP BY 1, 2""",
    "tsv_ingest": f"""WITH {EVENTS},
        lines AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS createtime,
          user_id || chr(9) || code || chr(9) || (k % 10) || chr(9) || k || chr(9)
          || CASE WHEN value > 100 THEN '1' ELSE '0' END AS head FROM e)
        SELECT user_id AS uid, code AS courseid, k % 10 AS pointid, k AS questionid,
          CASE WHEN value > 100 THEN '1' ELSE '0' END AS isright, createtime, 'good' AS kind
        FROM lines WHERE event_id % 7 IN (2, 4, 5, 6)
        UNION ALL
        SELECT count(*), n, NULL, NULL, NULL, NULL, 'bad' FROM (
          SELECT length(head) + CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 25 ELSE 21 END AS n
          FROM lines WHERE event_id % 7 IN (0, 1, 3)) GROUP BY n""",
    "mask_pii": """SELECT c_custkey AS uid, substr(c_name, 1, 1) || 'XX' AS fullname,
        '138****' || substr('138' || lpad(CAST(c_custkey AS varchar), 8, '0'), 9, 3) AS phone,
        '******' AS password FROM customer""",
    "decode_codes": """SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'PC' WHEN '2' THEN 'Mobile'
        WHEN '3' THEN 'APP' WHEN '4' THEN 'WeChat' ELSE 'other' END AS source,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'PC' WHEN '2' THEN 'APP' ELSE 'Other' END AS platform
        FROM orders""",
    "half_up_score": """SELECT l_orderkey, l_partkey, l_linenumber,
        CAST(round(CAST(l_extendedprice AS decimal(18,2)), 1) AS double) AS score FROM lineitem""",
    "score_band": """WITH s AS (SELECT l_orderkey, l_quantity * 2 + (l_linenumber - 4) * 0.5 AS score FROM lineitem)
        SELECT CASE WHEN score < 0 THEN NULL WHEN score <= 20 THEN '0-20' WHEN score <= 40 THEN '20-40'
        WHEN score <= 60 THEN '40-60' WHEN score <= 80 THEN '60-80' WHEN score <= 100 THEN '80-100' END AS band,
        count(*) AS num, min(l_orderkey) AS first_key FROM s GROUP BY 1""",
    "date_key": """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, strftime(o_orderdate, '%Y-%m-%d') AS iso
        FROM orders""",
    "replay_publish": f"WITH {EVENTS} SELECT CAST(code AS varchar) AS page_id, count(*) AS num FROM e GROUP BY code",
}
