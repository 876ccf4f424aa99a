"""Exam-area queries over the supplied tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.plans import etl, exam
from lectern.queries.roles import DAY, Roles, TENANT, land_logs
from lectern.session import work_dir
from lectern.sources.warehouse import Warehouse

CHAPTER = "chapterid chapterlistid chaptername chapter_courseid chapternum chapterallnum chapterlistname pointid " \
          "questionid questype pointname dt dn".split()
COURSE = "sitecourseid siteid courseid sitecoursename sequence majorid coursename courseeduid edusubjectid dt dn".split()
MAJOR = "majorid businessid siteid majorname shortname businessname sitename domain dt dn".split()
PAPER = "paperviewid paperid paperviewname centerid sequence centername papername dt dn".split()
QUESTION = "questionid questypeid content answer viewtypename description dt dn".split()
WIDE = "userid courseid questionid useranswer paperid spendtime chapterid chaptername chapterlistname pointid " \
       "pointname questype sitecourseid siteid sitecoursename coursename edusubjectid majorid businessid majorname " \
       "businessname sitename paperviewid paperviewname centerid centername papername questypeid question_content " \
       "question_description user_question_answer dt dn".split()
GRAIN = "userid questionid paperviewid paperviewname chaptername pointname sitecoursename coursename majorname " \
        "shortname sitename papername spendtime user_question_answer dt dn".split()
RANKED = "userid paperviewid paperviewname chaptername pointname sitecoursename coursename majorname shortname " \
         "sitename papername rk dt dn".split()


def double(*names: str) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]


def dim(name: str, columns: list[str], *doubles: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(Roles(spark, sf_dir), name)().select(*columns, *double(*doubles))
    return run


def report(build: Callable[[DataFrame], DataFrame], *doubles: str, wide: bool = False, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        roles = Roles(spark, sf_dir)
        out = build(roles.answers_wide() if wide else roles.answers(), **options)
        return out.select(*[c for c in out.columns if c not in doubles], *double(*doubles))
    return run


def job_exam_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily exam job from its 17 raw logs on: loads, dimensions, wide answers, answer grain, seven reports."""
    r = Roles(spark, sf_dir)
    folder = work_dir(spark, "exam-job")
    wh = Warehouse(spark, folder)
    land_logs(r.raw_exam(), f"{folder}/logs")
    etl.load_exam_logs(wh, f"{folder}/logs")
    exam.build_dims(wh, DAY)
    exam.build_answers(wh, DAY)
    exam.report_exams(wh, DAY)
    return _seven_reports(wh)


RANKED_TEXT = ["userid", "chaptername", "pointname", "sitecoursename", "coursename", "majorname", "shortname", "sitename", "papername"]


def _seven_reports(wh: Warehouse) -> DataFrame:
    """All report tables as written: ``report``, the paper or question, ``text`` and up to three numbers."""
    def rows(table: str, ident: str, text, *numbers: str) -> DataFrame:
        values = [F.col(c).cast("double") for c in numbers] + [F.lit(None).cast("double")] * (3 - len(numbers))
        return wh.read(table, DAY).select(
            F.lit(table).alias("report"), F.col(ident).alias("id"), text.alias("text"),
            *[v.alias(f"v{k}") for k, v in enumerate(values)], "dt", "dn")

    name, ranked = F.col("paperviewname"), F.concat_ws("/", "paperviewname", *RANKED_TEXT)
    parts = [rows("ads_paper_avgtimeandscore", "paperviewid", name, "avgscore", "avgspendtime"),
             rows("ads_paper_maxdetail", "paperviewid", name, "maxscore", "minscore"),
             rows("ads_user_paper_detail", "paperviewid", name, "unpasscount", "passcount", "rate"),
             rows("ads_user_question_detail", "questionid", F.lit(""), "errcount", "rightcount", "rate"),
             rows("ads_top3_userdetail", "paperviewid", ranked, "score", "rk"),
             rows("ads_low3_userdetail", "paperviewid", ranked, "score", "rk"),
             rows("ads_paper_scoresegment_user", "paperviewid", F.concat_ws(
                 "/", "paperviewname", "score_segment", "userids"), "part", "copy")]
    return reduce(DataFrame.unionByName, parts)


def report_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pass rates as an ordered report gives them, with the place of each row."""
    r = Roles(spark, sf_dir)
    wh = Warehouse(spark, work_dir(spark, "exam-order"))
    exam.write_ordered(wh, "ads_user_paper_detail", exam.pass_rates(r.answers()).withColumn("dt", F.lit(DAY)), DAY, "-rate", "paperviewid",
                       "paperviewname", "dn")
    ordered = exam.read_ordered(wh, "ads_user_paper_detail", DAY)
    return ordered.select("paperviewid", "paperviewname", "passcount", F.col("rate").cast("double").alias("rate"), "dn", "place")


# --- SQL twins -------------------------------------------------------------------------------------

_T = "(SELECT unnest(['east', 'west']) AS dn)"
_DN = TENANT.format(key="l_orderkey")

DIMS = f"""
tenants AS {_T},
chapter_dim AS (
  SELECT s_suppkey AS chapterid, s_nationkey AS chapterlistid, s_name || '/' || dn AS chaptername,
         s_suppkey % 25 AS chapter_courseid, 2 AS chapternum, n_regionkey AS chapterallnum,
         n_name AS chapterlistname, p_partkey AS pointid, p_partkey AS questionid, p_size % 7 AS questype,
         'P' || p_partkey AS pointname, '{DAY}' AS dt, dn
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
  JOIN part ON p_partkey = s_suppkey * 2 OR p_partkey = s_suppkey * 2 + 1 CROSS JOIN tenants),
course_dim AS (
  SELECT n_nationkey AS sitecourseid, n_nationkey AS siteid, n_regionkey AS courseid,
         n_name || '/' || dn AS sitecoursename, CAST(n_nationkey AS varchar) AS sequence, r_regionkey AS majorid,
         r_name AS coursename, r_regionkey + 100 AS courseeduid, r_regionkey + 200 AS edusubjectid, '{DAY}' AS dt, dn
  FROM nation JOIN region ON r_regionkey = n_regionkey CROSS JOIN tenants),
major_dim AS (
  SELECT n_nationkey AS majorid, n_regionkey AS businessid, n_nationkey AS siteid, 'M-' || n_name AS majorname,
         'M' || n_nationkey AS shortname, r_name AS businessname, n_name || '.' || dn AS sitename, dn AS domain,
         '{DAY}' AS dt, dn
  FROM nation JOIN region ON r_regionkey = n_regionkey CROSS JOIN tenants),
paper_dim AS (
  SELECT v.s_suppkey AS paperviewid, v.s_nationkey AS paperid, v.s_name || '#' || dn AS paperviewname,
         z.s_nationkey AS centerid, CAST(z.s_suppkey AS varchar) AS sequence, cn.n_name AS centername,
         'paper-' || pn.n_name AS papername, '{DAY}' AS dt, dn
  FROM supplier v LEFT JOIN supplier z ON z.s_suppkey * 2 = v.s_suppkey
  LEFT JOIN nation cn ON cn.n_nationkey = z.s_nationkey
  JOIN nation pn ON pn.n_nationkey + 1 = v.s_nationkey CROSS JOIN tenants),
question_dim AS (
  SELECT p_partkey AS questionid, p_size % 7 AS questypeid, p_name AS content, p_brand AS answer,
         r_name AS viewtypename, 'about ' || r_name AS description, CAST(p_size AS double) AS score, '{DAY}' AS dt, dn
  FROM part JOIN region ON r_regionkey = p_size % 7 CROSS JOIN tenants),
answer AS (
  SELECT l_orderkey AS userid, l_suppkey AS paperviewid, l_suppkey AS chapterid, l_partkey % 30 AS sitecourseid,
         l_partkey AS questionid, l_suppkey % 25 AS majorid, l_linestatus AS useranswer, l_linenumber * 10 AS spendtime,
         CAST(CAST(l_quantity AS decimal(10,1)) * 2 + (l_linenumber - 4) * CAST(0.5 AS decimal(2,1)) AS decimal(18,1)) AS score,
         CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 0 ELSE 2 END AS user_question_answer, '{DAY}' AS dt,
         {_DN} AS dn
  FROM lineitem)"""

DETAIL = DIMS + """,
wide AS (
  SELECT a.userid, c.courseid, a.questionid, a.useranswer, p.paperid, a.spendtime, a.chapterid, h.chaptername,
         h.chapterlistname, h.pointid, h.pointname, h.questype, a.sitecourseid, c.siteid, c.sitecoursename,
         c.coursename, c.edusubjectid, a.majorid, m.businessid, m.majorname, m.shortname, m.businessname, m.sitename,
         a.paperviewid, p.paperviewname, p.centerid, p.centername, p.papername, q.questypeid,
         q.content AS question_content, q.description AS question_description, a.user_question_answer, a.score,
         a.dt, a.dn
  FROM answer a
  JOIN course_dim c ON c.sitecourseid = a.sitecourseid AND c.dn = a.dn
  JOIN chapter_dim h ON h.chapterid = a.chapterid AND h.dn = a.dn
  JOIN major_dim m ON m.majorid = a.majorid AND m.dn = a.dn
  JOIN paper_dim p ON p.paperviewid = a.paperviewid AND p.dn = a.dn
  JOIN question_dim q ON q.questionid = a.questionid AND q.dn = a.dn),
detail AS (SELECT * FROM wide WHERE pointid % 2 = 0 OR NOT EXISTS (
  SELECT 1 FROM chapter_dim h WHERE h.chapterid = wide.chapterid AND h.dn = wide.dn AND h.pointid < wide.pointid))"""

_BAND = ("CASE WHEN score < 0 THEN NULL WHEN score <= 20 THEN '0-20' WHEN score <= 40 THEN '20-40' "
         "WHEN score <= 60 THEN '40-60' WHEN score <= 80 THEN '60-80' WHEN score <= 100 THEN '80-100' END")
_KEYS = "paperviewid, paperviewname, dt, dn"
_AVG = """CAST(floor((2 * sum(CAST(score * 10 AS bigint)) + count(*)) / (2.0 * count(*))) AS double) / 10 AS avgscore,
  CAST(floor((200 * sum(spendtime) + count(*)) / (2.0 * count(*))) AS double) / 100 AS avgspendtime"""
_EXTREMES = "CAST(max(score) AS double) AS maxscore, CAST(min(score) AS double) AS minscore"


def _rate(part: str, other: str) -> str:
    return (f"CAST(floor((200 * count(*) FILTER ({part}) + count(*) FILTER ({part} OR {other})) "
            f"/ (2.0 * count(*) FILTER ({part} OR {other}))) AS double) / 100 AS rate")


def _pass(source: str, having: str = "") -> str:
    return f"""SELECT paperviewid, paperviewname, count(*) FILTER (score BETWEEN 0 AND 60) AS unpasscount,
    count(*) FILTER (score > 60) AS passcount, {_rate('score > 60', 'score BETWEEN 0 AND 60')}, dt, dn
    FROM {source} WHERE score >= 0 GROUP BY {_KEYS} {having}"""


def _error(source: str, having: str = "") -> str:
    return f"""SELECT questionid, count(*) FILTER (user_question_answer = 0) AS errcount,
    count(*) FILTER (user_question_answer = 1) AS rightcount,
    {_rate('user_question_answer = 0', 'user_question_answer = 1')}, dt, dn
    FROM {source} WHERE user_question_answer IN (0, 1) GROUP BY questionid, dt, dn {having}"""


def _ranked(order: str) -> str:
    return f"""SELECT {', '.join(RANKED)}, CAST(score AS double) AS score FROM (SELECT *,
    dense_rank() OVER (PARTITION BY paperviewid ORDER BY score {order}) AS rk FROM detail) WHERE rk < 4"""


def _ranked_text(report: str, order: str) -> str:
    return f"""UNION ALL SELECT '{report}', paperviewid, concat_ws('/', paperviewname, {', '.join(RANKED_TEXT)}), score, rk, NULL, dt, dn
        FROM (SELECT *, dense_rank() OVER (PARTITION BY paperviewid ORDER BY score {order}) AS rk FROM detail) WHERE rk < 4"""


_BOTH_PAPER = "HAVING count(*) FILTER (score > 60) > 0 AND count(*) FILTER (score BETWEEN 0 AND 60) > 0"
_BOTH_QUESTION = ("HAVING count(*) FILTER (user_question_answer = 0) > 0 "
                  "AND count(*) FILTER (user_question_answer = 1) > 0")

QUERIES = {
    "dim_chapter": dim("chapter_dim", CHAPTER),
    "dim_course": dim("course_dim", COURSE),
    "dim_major": dim("major_dim", MAJOR),
    "dim_paper": dim("paper_dim", PAPER),
    "dim_question": dim("question_dim", QUESTION, "score"),
    "answer_wide": dim("answers_wide", WIDE, "score"),
    "answer_grain": dim("answers", GRAIN, "score"),
    "paper_avg": report(exam.paper_averages, "avgscore", "avgspendtime"),
    "paper_avg_repeated": report(exam.paper_averages, "avgscore", "avgspendtime", wide=True),
    "paper_maxmin": report(exam.paper_extremes, "maxscore", "minscore"),
    "top3_scores": report(exam.top_scores, "score"),
    "low3_scores": report(exam.low_scores, "score"),
    "score_bands": report(exam.band_users, part_width=2_000),
    "score_bands_repeated": report(exam.band_users, wide=True, distinct=False, part_width=2_000),
    "score_band_members": report(exam.band_members),
    "paper_pass_rate": report(exam.pass_rates, "rate"),
    "paper_pass_rate_both": report(exam.pass_rates, "rate", wide=True, inner_only=True),
    "question_error_rate": report(exam.error_rates, "rate"),
    "question_error_rate_both": report(exam.error_rates, "rate", wide=True, inner_only=True),
    "job_exam_reports": job_exam_reports,
    "report_in_order": report_in_order,
}


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


SQL = {
    "dim_chapter": _with(DIMS, f"SELECT {', '.join(CHAPTER)} FROM chapter_dim"),
    "dim_course": _with(DIMS, f"SELECT {', '.join(COURSE)} FROM course_dim"),
    "dim_major": _with(DIMS, f"SELECT {', '.join(MAJOR)} FROM major_dim"),
    "dim_paper": _with(DIMS, f"SELECT {', '.join(PAPER)} FROM paper_dim"),
    "dim_question": _with(DIMS, f"SELECT {', '.join(QUESTION)}, score FROM question_dim"),
    "answer_wide": _with(DETAIL, f"SELECT {', '.join(WIDE)}, CAST(score AS double) AS score FROM wide"),
    "answer_grain": _with(DETAIL, f"SELECT {', '.join(GRAIN)}, CAST(score AS double) AS score FROM detail"),
    "paper_avg": _with(DETAIL, f"SELECT {_KEYS}, {_AVG} FROM detail GROUP BY {_KEYS}"),
    "paper_avg_repeated": _with(DETAIL, f"SELECT {_KEYS}, {_AVG} FROM wide GROUP BY {_KEYS}"),
    "paper_maxmin": _with(DETAIL, f"SELECT {_KEYS}, {_EXTREMES} FROM detail GROUP BY {_KEYS}"),
    "top3_scores": _with(DETAIL, _ranked("DESC")),
    "low3_scores": _with(DETAIL, _ranked("ASC")),
    "score_bands": _with(DETAIL, f"""SELECT paperviewid, paperviewname, score_segment, dt, dn, part,
        string_agg(CAST(userid AS varchar), ',' ORDER BY userid) AS userids FROM (
        SELECT DISTINCT {_KEYS}, {_BAND} AS score_segment, userid, userid // 2000 AS part FROM detail)
        GROUP BY {_KEYS}, score_segment, part"""),
    "score_bands_repeated": _with(DETAIL, f"""SELECT paperviewid, paperviewname, score_segment, dt, dn, part, copy,
        string_agg(CAST(userid AS varchar), ',' ORDER BY userid) AS userids FROM (
        SELECT {_KEYS}, score_segment, userid, userid // 2000 AS part,
        (row_number() OVER (PARTITION BY {_KEYS}, score_segment, userid) - 1) // 8 AS copy
        FROM (SELECT *, {_BAND} AS score_segment FROM wide)) GROUP BY {_KEYS}, score_segment, part, copy"""),
    "score_band_members": _with(DETAIL, f"""SELECT paperviewid, paperviewname, score_segment, userid, dt, dn,
        count(*) AS answers FROM (SELECT *, {_BAND} AS score_segment FROM detail)
        GROUP BY {_KEYS}, score_segment, userid"""),
    "paper_pass_rate": _with(DETAIL, _pass("detail")),
    "paper_pass_rate_both": _with(DETAIL, _pass("wide", _BOTH_PAPER)),
    "question_error_rate": _with(DETAIL, _error("detail")),
    "question_error_rate_both": _with(DETAIL, _error("wide", _BOTH_QUESTION)),
    "job_exam_reports": _with(DETAIL, f"""
        SELECT 'ads_paper_avgtimeandscore' AS report, paperviewid AS id, paperviewname AS text, avgscore AS v0, avgspendtime AS v1,
            NULL::DOUBLE AS v2, dt, dn FROM (SELECT {_KEYS}, {_AVG} FROM detail GROUP BY {_KEYS})
        UNION ALL SELECT 'ads_paper_maxdetail', paperviewid, paperviewname, maxscore, minscore, NULL, dt, dn
            FROM (SELECT {_KEYS}, {_EXTREMES} FROM detail GROUP BY {_KEYS})
        UNION ALL SELECT 'ads_user_paper_detail', paperviewid, paperviewname, unpasscount, passcount, rate, dt, dn FROM ({_pass('detail')})
        UNION ALL SELECT 'ads_user_question_detail', questionid, '', errcount, rightcount, rate, dt, dn FROM ({_error('detail')})
        {_ranked_text('ads_top3_userdetail', 'DESC')} {_ranked_text('ads_low3_userdetail', 'ASC')}
        UNION ALL SELECT 'ads_paper_scoresegment_user', paperviewid, concat_ws('/', paperviewname, score_segment,
            string_agg(CAST(userid AS varchar), ',' ORDER BY userid)), part, 0, NULL, dt, dn FROM (
            SELECT DISTINCT {_KEYS}, {_BAND} AS score_segment, userid, userid // 10000 AS part FROM detail)
            GROUP BY {_KEYS}, score_segment, part"""),
    "report_in_order": _with(DETAIL, f"""SELECT paperviewid, paperviewname, passcount, rate, dn,
        row_number() OVER (ORDER BY rate DESC, paperviewid, paperviewname, dn) - 1 AS place FROM ({_pass('detail')})"""),
}
