"""Activity queries in batch form, and the same answers through real streams over replayed logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions import scalars as S
from lectern.operators import activity
from lectern.operators.grouping import ids_in_parts, sum_by_each, top_overall
from lectern.operators.intervals import interval_merge, video_time
from lectern.operators.ranges import count_by_range
from lectern.queries.log_queries import EVENTS
from lectern.queries.roles import Roles
from lectern.session import stream_session, work_dir
from lectern.sinks.tables import ChangeLog, VersionedTable
from lectern.sources.logs import learn_records, page_records, question_records, register_records
from lectern.sources.streams import file_lines, replay_to_dir
from lectern.streaming import jobs
from lectern.streaming.state import POINT_KEYS, VIDEO_KEYS, mastery_state

STAMP = "yyyy-MM-dd HH:mm:ss"


def _windows(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("window_start", STAMP).alias("window_start"),
                     F.date_format("window_end", STAMP).alias("window_end"), "platform", "num")


def _mastery(df: DataFrame) -> DataFrame:
    return df.select(*POINT_KEYS, "qz_sum", "qz_count", "qz_istrue", F.round("correct_rate", 6).alias("correct_rate"),
                     F.round("mastery_rate", 6).alias("mastery_rate"), "createtime")


def _registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register_records(Roles(spark, sf_dir).register_lines())[0]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(Roles(spark, sf_dir).page_lines())[0]


def _plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_records(Roles(spark, sf_dir).learn_lines())[0]


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_records(Roles(spark, sf_dir).question_lines())[0]


def register_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.running_count(_registers(spark, sf_dir), "platform")


def register_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _registers(spark, sf_dir).withColumn("ts", F.to_timestamp("register_time"))
    return _windows(activity.sliding_count(rows, "ts", "platform"))


def page_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.page_transitions(_pages(spark, sf_dir))


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.page_views(_pages(spark, sf_dir))


def funnel_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.funnel_rates(activity.page_views(_pages(spark, sf_dir)))


def province_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = Roles(spark, sf_dir).ip_ranges().withColumn("province", S.region_part(F.col("region")))
    numbered = _pages(spark, sf_dir).select(S.ip_number(F.col("ip")).alias("ip_num"))
    return count_by_range(numbered, "ip_num", ranges, "start_ip", "end_ip", ["province"])


def province_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_overall(province_clicks(spark, sf_dir), [F.col("num").desc(), F.col("province")], 3)


def learn_time(dim: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plays(spark, sf_dir).groupBy(dim).agg(F.sum("seconds").alias("totaltime"))
    return run


def learn_time_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_by_each(_plays(spark, sf_dir), jobs.LEARN_DIMS, "seconds", "totaltime")


def video_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video_time(_plays(spark, sf_dir))


def video_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_merge(_plays(spark, sf_dir), VIDEO_KEYS)


def question_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mastery(activity.question_mastery(_answers(spark, sf_dir)))


def question_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct questions a user has answered per course and point, as id lists."""
    return ids_in_parts(_answers(spark, sf_dir), POINT_KEYS, "questionid", "questionids")


# --- the same through streams ------------------------------------------------------------------------

def streamed(lines: str, job: Callable, result: Callable, files: int = 4, per_trigger: int | None = 2, **options):
    """Replay log lines to a directory, drain them with the streaming job, read its result tables.

    The stream runs in a session of its own with one state partition per core; the caller's settings stay
    as they are.
    """
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = work_dir(spark, "stream")
        session = stream_session(spark, spark.sparkContext.defaultParallelism)
        roles = Roles(session, sf_dir)
        replay_to_dir(getattr(roles, lines)(), f"{folder}/in", files)
        source = file_lines(session, f"{folder}/in", per_trigger)
        extra = [roles.ip_ranges()] if job is jobs.provinces else []
        job(source, *extra, f"{folder}/out", f"{folder}/checkpoint", available_now=True, **options).awaitTermination()
        return result(spark, f"{folder}/out")
    return run


def stream_register_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows with a watermark of a day: two thirds of the lines first, the rest after a restart, most of it late."""
    folder = work_dir(spark, "stream")
    session = stream_session(spark, spark.sparkContext.defaultParallelism)
    lines = Roles(session, sf_dir).register_lines()
    late = F.substring_index("value", "\t", 1).cast("bigint") % 3 == 0  # by event id
    for part in (lines.where(~late), lines.where(late)):
        replay_to_dir(part, f"{folder}/in", 2)
        jobs.register_sliding(file_lines(session, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint", watermark="1 day",
                              closed=True, available_now=True).awaitTermination()
    return _windows(ChangeLog(spark, f"{folder}/out/register_sliding", ["window_start", "platform"]).read())


def stream_page_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outputs of the one-read page job: transitions, top provinces and the number of page views."""
    folder = work_dir(spark, "stream")
    session = stream_session(spark, spark.sparkContext.defaultParallelism)
    roles = Roles(session, sf_dir)
    replay_to_dir(roles.page_lines(), f"{folder}/in", 4)
    for _ in range(2):  # the second start finds nothing new and goes on from the checkpoint
        for query in jobs.page_job(file_lines(session, f"{folder}/in", 2), roles.ip_ranges(), f"{folder}/out",
                                   f"{folder}/checkpoint", f"{folder}/bad", available_now=True):
            query.awaitTermination()
    moves = ChangeLog(spark, f"{folder}/out/page_transitions", jobs.TRANSITION_KEYS).read()
    tables = {name: VersionedTable(spark, f"{folder}/out/{name}").read() for name in ("top_province", "page_views")}
    return (moves.selectExpr("'move' AS kind", "concat_ws('>', last_page_id, page_id, next_page_id) AS key", "num")
            .union(tables["top_province"].selectExpr("'province' AS kind", "province AS key", "num"))
            .union(tables["page_views"].selectExpr("'views' AS kind", "page_id AS key", "num")))


def stream_question_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mastery as the stream's state holds it after the last batch, with the question ids that its result table has for the key."""
    folder = work_dir(spark, "stream")
    session = stream_session(spark, spark.sparkContext.defaultParallelism)
    replay_to_dir(Roles(session, sf_dir).question_lines(), f"{folder}/in", 4)
    jobs.point_detail(file_lines(session, f"{folder}/in", 2), f"{folder}/out", f"{folder}/checkpoint",
                      available_now=True).awaitTermination()
    ids = ChangeLog(session, f"{folder}/out/point_detail", POINT_KEYS).read().select(*POINT_KEYS, "questionids")
    return mastery_state(session, f"{folder}/checkpoint/point_detail").join(ids, POINT_KEYS, "full")


class Interrupted(Exception):
    """Stands for the loss of the driver between two writes of a batch."""


def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page job, lost between two tables of its second batch and started again when more files have come.

    Returns all tables as readers see them at the end, and ``seen``: whether readers saw whole first batch after the loss, that is, every
    table summing to the same number of views.
    """
    folder = work_dir(spark, "stream")
    session = stream_session(spark, spark.sparkContext.defaultParallelism)
    roles = Roles(session, sf_dir)
    late = F.crc32("value") % 3 == 0
    replay_to_dir(roles.page_lines().where(~late), f"{folder}/in", 4)

    def lose(table: str, batch_id: int) -> None:
        if (table, batch_id) == ("page_views", 1):
            raise Interrupted(table)

    def run(after_write: Callable) -> None:
        for query in jobs.page_job(file_lines(session, f"{folder}/in", 2), roles.ip_ranges(), f"{folder}/out", f"{folder}/checkpoint",
                                   f"{folder}/bad", after_write, available_now=True):
            query.awaitTermination()

    try:
        run(lose)
    except StreamingQueryException as error:
        if "Interrupted" not in str(error):
            raise
    early = jobs.page_tables(spark, f"{folder}/out")
    sums = {name: early[name].agg(F.sum("num")).first()[0] for name in ("page_transitions", "page_views", "province_clicks")}
    replay_to_dir(roles.page_lines().where(late), f"{folder}/in", 2)
    run(lambda table, batch_id: None)
    tables = jobs.page_tables(spark, f"{folder}/out")
    found = (tables["page_transitions"].selectExpr("'move' AS kind", "concat_ws('>', last_page_id, page_id, next_page_id) AS key", "num")
             .union(tables["page_views"].selectExpr("'views'", "page_id", "num"))
             .union(tables["page_jump_rate"].selectExpr("'rate'", "concat(page_id, ' ', jump_rate)", "num"))
             .union(tables["province_clicks"].selectExpr("'province'", "province", "num"))
             .union(tables["top_province"].selectExpr("'best'", "province", "num")))
    return found.withColumn("seen", F.lit(len(set(sums.values())) == 1))


#: Batches of the plays in :func:`stream_video_coverage`, by the position they began at.
PARTS = 3


def stream_video_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched time over several batches, each of plays all over the videos; the job is started anew for each."""
    folder = work_dir(spark, "stream")
    session = stream_session(spark, spark.sparkContext.defaultParallelism)
    texts = Roles(session, sf_dir).learn_lines()
    part = F.get_json_object("value", "$.ps").cast("int") % PARTS
    for number in range(PARTS):
        replay_to_dir(texts.where(part == number), f"{folder}/in", 2)
        jobs.video_detail(file_lines(session, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint",
                          available_now=True).awaitTermination()
    return jobs.video_log(spark, f"{folder}/out").read()


def stream_learn_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables of the one-read learning job as of its last batch; of watched time what no order of batches changes."""
    folder = work_dir(spark, "stream")
    session = stream_session(spark, spark.sparkContext.defaultParallelism)
    replay_to_dir(Roles(session, sf_dir).learn_lines(), f"{folder}/in", 4)
    for query in jobs.learn_job(file_lines(session, f"{folder}/in", 2), f"{folder}/out", f"{folder}/checkpoint", f"{folder}/bad",
                                available_now=True):
        query.awaitTermination()
    tables = jobs.learn_tables(spark, f"{folder}/out")
    return tables["learn_time"].selectExpr("dim", "key", "totaltime", "CAST(NULL AS bigint) AS completetime",
                                           "CAST(NULL AS string) AS play_interval").union(tables["video_detail"].selectExpr(
        "'video'", "concat_ws('/', uid, cwareid, videoid)", "totaltime", "completetime", "play_interval"))


def _landed(spark: SparkSession, out: str) -> DataFrame:
    """Landed lines by topic and page; the day folder is the day of the run."""
    return spark.read.text(out).groupBy("topic", F.get_json_object("value", "$.page_id").alias("page_id")).agg(
        F.count(F.lit(1)).alias("num"), F.count_distinct("dt").alias("days"))


def log_result(name: str, keys: list[str], shape: Callable = lambda df: df):
    return lambda spark, out: shape(ChangeLog(spark, f"{out}/{name}", keys).read())


def table_result(name: str):
    return lambda spark, out: VersionedTable(spark, f"{out}/{name}").read()


QUERIES = {
    "register_total": register_total,
    "register_sliding": register_sliding,
    "page_transitions": page_transitions,
    "page_views": page_views,
    "funnel_rate": funnel_rate,
    "province_clicks": province_clicks,
    "province_top3": province_top3,
    **{f"learn_time_{name}": learn_time(key) for name, key in {
        "chapter": "chapterid", "cware": "cwareid", "edutype": "edutypeid", "source": "sourcetype",
        "subject": "subjectid"}.items()},
    "learn_time_all": learn_time_all,
    "video_coverage": video_coverage,
    "video_intervals": video_intervals,
    "question_mastery": question_mastery,
    "question_history": question_history,
    "stream_register_total": streamed(
        "register_lines", jobs.register_total, log_result("register_total", ["platform"])),
    "stream_register_late": stream_register_late,
    "stream_register_sliding": streamed(
        "register_lines", jobs.register_sliding,
        log_result("register_sliding", ["window_start", "platform"], _windows), watermark=None),
    "stream_question_mastery": streamed(
        "question_lines", jobs.point_detail, log_result("point_detail", POINT_KEYS, _mastery)),
    "stream_page_transitions": streamed(
        "page_lines", jobs.transitions,
        log_result("page_transitions", ["last_page_id", "page_id", "next_page_id"])),
    "stream_page_job": stream_page_job,
    "stream_funnel_rate": streamed("page_lines", jobs.funnel, table_result("page_jump_rate")),
    "stream_province_clicks": streamed("page_lines", jobs.provinces, table_result("province_clicks")),
    "stream_province_top3": streamed("page_lines", jobs.provinces, table_result("top_province")),
    "stream_learn_time": streamed("learn_lines", jobs.learn_time, log_result("learn_time", ["dim", "key"])),
    "stream_video_coverage": stream_video_coverage,
    "stream_learn_job": stream_learn_job,
    "stream_restart": stream_restart,
    "stream_question_state": stream_question_state,
    "stream_raw_landing": streamed("page_lines", jobs.landing, _landed, topic="page_topic"),
}

# --- SQL twins -------------------------------------------------------------------------------------

_PLATFORM = "CASE code WHEN 1 THEN 'PC' WHEN 2 THEN 'APP' ELSE 'Other' END"
PLAYS = EVENTS + """,
p AS (SELECT user_id AS uid, code AS cwareid, k % 10 AS videoid, k % 7 AS chapterid, k % 3 AS edutypeid,
    k % 11 AS subjectid, event_type AS sourcetype, epoch_ms(ts) AS ts,
    epoch_ms(ts) + CAST(CAST(value AS decimal(12,2)) * 1000 AS bigint) AS te,
    CAST(CAST(value AS decimal(12,2)) * 1000 AS bigint) // 1000 AS seconds, k AS ps, k - 1 + event_id % 20 AS pe
    FROM e WHERE k - 1 + event_id % 20 >= k)"""
_REACH = "max(pe) OVER (PARTITION BY uid, cwareid, videoid ORDER BY ps, pe, ts, te ROWS BETWEEN UNBOUNDED PRECEDING " \
         "AND 1 PRECEDING)"
_COVERAGE = f"""WITH {PLAYS},
c AS (SELECT *, greatest(0, pe - greatest(ps, coalesce({_REACH}, ps))) AS new_len FROM p)
SELECT uid, cwareid, videoid, sum(seconds) AS totaltime,
  sum(CASE WHEN pe = ps THEN 0 ELSE seconds * new_len // (pe - ps) END) AS effecttime,
  sum(new_len) AS completetime FROM c GROUP BY uid, cwareid, videoid"""
_INTERVALS = f"""WITH {PLAYS},
f AS (SELECT uid, cwareid, videoid, ps, pe, ts, te, CASE WHEN coalesce({_REACH} >= ps, false) THEN 0 ELSE 1 END AS gap
  FROM p),
g AS (SELECT *, sum(gap) OVER (PARTITION BY uid, cwareid, videoid ORDER BY ps, pe, ts, te
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)
SELECT uid, cwareid, videoid, min(ps) AS ps, max(pe) AS pe FROM g GROUP BY uid, cwareid, videoid, island"""
# new positions by marking each: the first play of a position in the order of batches, then of plays
_CARRIED = f"""WITH {PLAYS},
n AS (SELECT *, ps % {PARTS} AS part, row_number() OVER () AS play FROM p),
x AS (SELECT uid, cwareid, videoid, play, part, ps, pe, ts, te, unnest(range(ps, pe)) AS pos FROM n),
f AS (SELECT play, count(*) AS new FROM (SELECT play, row_number() OVER (PARTITION BY uid, cwareid, videoid, pos
  ORDER BY part, ps, pe, ts, te, play) AS turn FROM x) WHERE turn = 1 GROUP BY play),
t AS (SELECT uid, cwareid, videoid, sum(seconds) AS totaltime,
  sum(CASE WHEN pe = ps THEN 0 ELSE seconds * coalesce(new, 0) // (pe - ps) END) AS effecttime,
  coalesce(sum(new), 0) AS completetime FROM n LEFT JOIN f USING (play) GROUP BY uid, cwareid, videoid),
i AS (SELECT uid, cwareid, videoid, string_agg(ps || '-' || pe, ',' ORDER BY ps, pe) AS play_interval
  FROM ({_INTERVALS}) GROUP BY uid, cwareid, videoid)
SELECT * FROM t JOIN i USING (uid, cwareid, videoid)"""
_PAGES = EVENTS + """,
pages AS (SELECT CAST(k % 4 AS varchar) AS last_page_id, CAST(code AS varchar) AS page_id,
    CASE WHEN k % 5 > 0 THEN CAST(k % 5 AS varchar) ELSE '' END AS next_page_id,
    ((user_id * 37 + k) % 28) * 16777216 + (event_id % 256) * 65536 + (k * 7 % 256) * 256 + event_id % 251 AS ip_num
    FROM e)"""
_PROVINCES = f"""WITH {_PAGES}
SELECT n_name AS province, count(*) AS num FROM pages
LEFT JOIN nation ON ip_num BETWEEN n_nationkey * 16777216 + 1000 AND (n_nationkey + 1) * 16777216 - 500000
GROUP BY n_name"""
_FUNNEL = f"""WITH {_PAGES},
n AS (SELECT count(*) FILTER (page_id = '1') AS a, count(*) FILTER (page_id = '2') AS b,
  count(*) FILTER (page_id = '3') AS c FROM pages)
SELECT '1' AS page_id, a AS num, '100%' AS jump_rate FROM n
UNION ALL SELECT '2', b, CASE WHEN a = 0 THEN '0%' ELSE CAST(round_even(b * 100.0 / a, 0) AS bigint) || '%' END FROM n
UNION ALL SELECT '3', c, CASE WHEN b = 0 THEN '0%' ELSE CAST(round_even(c * 100.0 / b, 0) AS bigint) || '%' END FROM n"""
_MASTERY = f"""WITH {EVENTS},
a AS (SELECT user_id AS uid, code AS courseid, k % 10 AS pointid, count(*) AS qz_sum, count(DISTINCT k) AS qz_count,
  count(*) FILTER (value > 100) AS qz_istrue, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS createtime
  FROM e GROUP BY user_id, code, k % 10)
SELECT uid, courseid, pointid, qz_sum, qz_count, qz_istrue,
  round(CAST(qz_istrue AS double) / qz_sum, 6) AS correct_rate,
  round(CAST(qz_count AS double) / 30 * (CAST(qz_istrue AS double) / qz_sum), 6) AS mastery_rate, createtime FROM a"""
_SLIDING = f"""WITH {EVENTS},
w AS (SELECT {_PLATFORM} AS platform, unnest(generate_series(CAST(floor(epoch_us(ts) / 6000000.0) AS bigint) * 6 - 54,
  CAST(floor(epoch_us(ts) / 6000000.0) AS bigint) * 6, 6)) AS start FROM e)
SELECT strftime(make_timestamp(start * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(make_timestamp((start + 60) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_end, platform, count(*) AS num
FROM w GROUP BY start, platform"""
# a row of the second part is late if its pane has ended a day before the last row of the first part
_LATE = f"""WITH {EVENTS},
p AS (SELECT *, CAST(floor(epoch_us(ts) / 6000000.0) AS bigint) * 6 AS pane FROM e),
mark AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 86400000000 AS last,
  max(epoch_us(ts)) FILTER (event_id % 3 <> 0) // 1000 * 1000 - 86400000000 AS first FROM e),
w AS (SELECT {_PLATFORM} AS platform, unnest(generate_series(pane - 54, pane, 6)) AS start FROM p, mark
  WHERE event_id % 3 <> 0 OR (pane + 6) * 1000000 > first)
SELECT strftime(make_timestamp(start * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(make_timestamp((start + 60) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_end, platform, count(*) AS num
FROM w, mark WHERE (start + 60) * 1000000 <= last GROUP BY start, platform"""
_TOTAL = f"WITH {EVENTS} SELECT {_PLATFORM} AS platform, count(*) AS num FROM e GROUP BY 1"
_TRANSITIONS = f"WITH {_PAGES} SELECT last_page_id, page_id, next_page_id, count(*) AS num FROM pages GROUP BY 1, 2, 3"
_TOP3 = f"SELECT * FROM ({_PROVINCES}) ORDER BY num DESC, province NULLS FIRST LIMIT 3"
_LEARN_ALL = f"WITH {PLAYS} " + " UNION ALL ".join(
    f"SELECT '{d}' AS dim, CAST({d} AS varchar) AS key, sum(seconds) AS totaltime FROM p GROUP BY {d}"
    for d in jobs.LEARN_DIMS)

SQL = {
    "register_total": _TOTAL,
    "register_sliding": _SLIDING,
    "page_transitions": _TRANSITIONS,
    "page_views": f"WITH {_PAGES} SELECT page_id, count(*) AS num FROM pages GROUP BY page_id",
    "funnel_rate": _FUNNEL,
    "province_clicks": _PROVINCES,
    "province_top3": _TOP3,
    **{f"learn_time_{name}": f"WITH {PLAYS} SELECT {key}, sum(seconds) AS totaltime FROM p GROUP BY {key}"
       for name, key in {"chapter": "chapterid", "cware": "cwareid", "edutype": "edutypeid", "source": "sourcetype",
                         "subject": "subjectid"}.items()},
    "learn_time_all": _LEARN_ALL,
    "video_coverage": _COVERAGE,
    "video_intervals": _INTERVALS,
    "question_mastery": _MASTERY,
    "question_history": f"""WITH {EVENTS} SELECT user_id AS uid, code AS courseid, k % 10 AS pointid, k // 10000 AS part,
        string_agg(CAST(k AS varchar), ',' ORDER BY k) AS questionids
        FROM (SELECT DISTINCT user_id, code, k FROM e) GROUP BY user_id, code, k % 10, k // 10000""",
    "stream_register_total": _TOTAL,
    "stream_register_late": _LATE,
    "stream_register_sliding": _SLIDING,
    "stream_question_mastery": _MASTERY,
    "stream_page_transitions": _TRANSITIONS,
    "stream_funnel_rate": _FUNNEL,
    "stream_province_clicks": _PROVINCES,
    "stream_province_top3": _TOP3,
    "stream_page_job": f"""SELECT 'move' AS kind, last_page_id || '>' || page_id || '>' || next_page_id AS key, num
        FROM ({_TRANSITIONS}) UNION ALL SELECT 'province', province, num FROM ({_TOP3})
        UNION ALL SELECT 'views', page_id, count(*) FROM (WITH {_PAGES} SELECT page_id FROM pages) GROUP BY page_id""",
    "stream_learn_time": _LEARN_ALL,
    "stream_video_coverage": _CARRIED,
    "stream_learn_job": f"""SELECT dim, key, totaltime, NULL::BIGINT AS completetime, NULL::VARCHAR AS play_interval FROM ({_LEARN_ALL})
        UNION ALL SELECT 'video', concat_ws('/', uid, cwareid, videoid), totaltime, completetime, play_interval FROM ({_CARRIED})""",
    "stream_question_state": f"""WITH {EVENTS}
        SELECT user_id AS uid, code AS courseid, k % 10 AS pointid, count(*) AS qz_sum, count(*) FILTER (value > 100) AS qz_istrue,
        min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS createtime, array_to_string(list_sort(list(DISTINCT k)), ',') AS questionids
        FROM e GROUP BY user_id, code, k % 10""",
    "stream_restart": f"""SELECT *, true AS seen FROM (
        SELECT 'move' AS kind, last_page_id || '>' || page_id || '>' || next_page_id AS key, num FROM ({_TRANSITIONS})
        UNION ALL SELECT 'province', province, num FROM ({_PROVINCES}) UNION ALL SELECT 'best', province, num FROM ({_TOP3})
        UNION ALL SELECT 'rate', page_id || ' ' || jump_rate, num FROM ({_FUNNEL})
        UNION ALL SELECT 'views', page_id, count(*) FROM (WITH {_PAGES} SELECT page_id FROM pages) GROUP BY page_id)""",
    "stream_raw_landing": f"""WITH {_PAGES} SELECT 'page_topic' AS topic, page_id, count(*) AS num, 1 AS days
        FROM pages GROUP BY page_id""",
}
