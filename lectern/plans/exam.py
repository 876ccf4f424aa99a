"""Exam subject area: five dimensions, the wide answer table and the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import scalars as S
from lectern.operators.grouping import among_best, first_per_key, ids_in_parts, rate_by, top_n_ties
from lectern.operators.joins import inner_join_all
from lectern.session import materialize
from lectern.sources.warehouse import SCHEMAS, Warehouse, shape

PASS_MARK = 60
PAPER_KEYS = ("paperviewid", "paperviewname", "dt", "dn")
#: A dimension and the columns it is joined on.
Side = tuple[DataFrame, tuple[str, str]]


def chapter_dim(chapter: DataFrame, chapter_list: DataFrame, point: DataFrame, point_question: DataFrame) -> DataFrame:
    """One row per chapter, point and question."""
    return shape(inner_join_all(
        chapter, (chapter_list, ("chapterlistid", "dn")), (point, ("chapterid", "dn")),
        (point_question, ("pointid", "dn"))), "dws_qz_chapter")


def course_dim(site_course: DataFrame, course: DataFrame, edusubject: DataFrame) -> DataFrame:
    return shape(inner_join_all(
        site_course, (course, ("courseid", "dn")), (edusubject, ("courseid", "dn"))), "dws_qz_course")


def major_dim(major: DataFrame, website: DataFrame, business: DataFrame) -> DataFrame:
    return shape(inner_join_all(
        major, (website, ("siteid", "dn")), (business, ("businessid", "dn"))), "dws_qz_major")


def paper_dim(paper_view: DataFrame, center_paper: DataFrame, center: DataFrame, paper: DataFrame) -> DataFrame:
    """Paper views with their exam center where there is one; views without a paper drop out."""
    return shape(
        paper_view.join(center_paper, ["paperviewid", "dn"], "left").join(center, ["centerid", "dn"], "left")
        .join(paper, ["paperid", "dn"], "inner"), "dws_qz_paper")


def question_dim(question: DataFrame, question_type: DataFrame) -> DataFrame:
    return shape(inner_join_all(question, (question_type, ("questypeid", "dn"))), "dws_qz_question")


def answer_wide(answer: DataFrame, chapter: DataFrame, course: DataFrame, major: DataFrame, paper: DataFrame,
                question: DataFrame) -> DataFrame:
    """Every answer with all five dimensions.

    A chapter comes once per point and question, so answers repeat, as the wide table defines. Through the joins the columns that a
    dimension gives go as one struct: rows of some 120 columns are too wide for compiled code, in sorts and shuffles too.
    """
    names, source = SCHEMAS["dws_user_paper_detail"].names, {}

    def packed(dim: DataFrame, key: str) -> Side:
        given = [c for c in dim.columns if c in names and c not in (key, "dn")]
        source.update({c: f"_{key}.{c}" for c in given})
        return dim.select(key, "dn", F.struct(*given).alias(f"_{key}")), (key, "dn")

    joined = _with_dims(answer, packed(question, "questionid"), packed(paper, "paperviewid"), packed(chapter, "chapterid"),
                        packed(course, "sitecourseid"), packed(major, "majorid"))
    return joined.select(*[F.col(source.get(c, c)).alias(c) for c in names])


def _with_dims(answer: DataFrame, question: Side, paper: Side, chapter: Side, course: Side, major: Side) -> DataFrame:
    """Joins in the order that moves the fewest bytes.

    Answers are shuffled for the three dimensions that grow with the platform: for questions while they are narrow, for chapters,
    which repeat them, last. The names of courses and majors, a row per site, come when no shuffle follows. The three are joined by
    sort-merge at any size: their sizes are estimates, and a dimension that just passes for small would be collected and broadcast.
    """
    grown = [(side.hint("merge"), keys) for side, keys in (question, paper, chapter)]
    return inner_join_all(answer, *grown, course, major)


def answer_grain(answer: DataFrame, chapter: DataFrame, course: DataFrame, major: DataFrame, paper: DataFrame,
                 question: DataFrame) -> DataFrame:
    """Every answer of :func:`answer_wide` exactly once, with the columns the reports read.

    Dimensions are cut to those columns and to their first row per key before the joins, so nothing
    fans out and no duplicates have to be removed from the answers themselves.
    """
    def one(dim: DataFrame, key: str, *columns: str) -> tuple[DataFrame, tuple[str, str]]:
        return first_per_key(dim.select(key, "dn", *columns), (key, "dn"), columns), (key, "dn")

    return shape(_with_dims(
        answer,
        (question.select("questionid", "dn").distinct(), ("questionid", "dn")),
        one(paper, "paperviewid", "paperviewname", "papername"),
        one(chapter, "chapterid", "pointid", "chaptername", "pointname"),
        one(course, "sitecourseid", "sitecoursename", "coursename"),
        one(major, "majorid", "majorname", "shortname", "sitename")), "dws_user_paper_answer")


def paper_averages(detail: DataFrame) -> DataFrame:
    return detail.groupBy(*PAPER_KEYS).agg(
        F.avg("score").try_cast("decimal(4,1)").alias("avgscore"),
        F.avg("spendtime").try_cast("decimal(10,2)").alias("avgspendtime"))


def paper_extremes(detail: DataFrame) -> DataFrame:
    return detail.groupBy(*PAPER_KEYS).agg(
        F.max("score").try_cast("decimal(4,1)").alias("maxscore"), F.min("score").try_cast("decimal(4,1)").alias("minscore"))


def top_scores(detail: DataFrame, n: int = 3) -> DataFrame:
    """All answers with one of the ``n`` best scores of their paper."""
    best = among_best(detail, ("paperviewid",), "score", n)
    return shape(top_n_ties(best, ("paperviewid",), "score", n), "ads_top3_userdetail")


def low_scores(detail: DataFrame, n: int = 3) -> DataFrame:
    least = among_best(detail, ("paperviewid",), "score", n, ascending=True)
    return shape(top_n_ties(least, ("paperviewid",), "score", n, ascending=True), "ads_low3_userdetail")


def band_users(detail: DataFrame, distinct: bool = True, part_width: int = 10_000) -> DataFrame:
    """Users per paper and score band as bounded id lists (see ``ids_in_parts``)."""
    banded = detail.withColumn("score_segment", S.score_band(F.col("score")))
    return ids_in_parts(banded, ("paperviewid", "paperviewname", "score_segment", "dt", "dn"), "userid", "userids",
                        distinct, part_width)


def band_members(detail: DataFrame) -> DataFrame:
    """Long form of :func:`band_users`: one row per paper, band and user with the number of answers."""
    banded = detail.withColumn("score_segment", S.score_band(F.col("score")))
    return banded.groupBy("paperviewid", "paperviewname", "score_segment", "userid", "dt", "dn").agg(
        F.count(F.lit(1)).alias("answers"))


def pass_rates(detail: DataFrame, inner_only: bool = False) -> DataFrame:
    """Passed and failed answers per paper; ``inner_only`` keeps papers that have both."""
    out = rate_by(detail, PAPER_KEYS, F.col("score") > PASS_MARK, F.col("score").between(0, PASS_MARK),
                  ("passcount", "unpasscount", "rate"), inner_only)
    return shape(out, "ads_user_paper_detail")


def error_rates(detail: DataFrame, inner_only: bool = False) -> DataFrame:
    """Wrong and right answers per question; ``inner_only`` keeps questions that have both."""
    out = rate_by(detail, ("questionid", "dt", "dn"), F.col("user_question_answer") == 0,
                  F.col("user_question_answer") == 1, ("errcount", "rightcount", "rate"), inner_only)
    return shape(out, "ads_user_question_detail")


def build_dims(wh: Warehouse, dt: str) -> None:
    def s(name: str) -> DataFrame:
        return wh.scan(name, dt)

    wh.write_day("dws_qz_chapter", chapter_dim(s("chapter"), s("chapter_list"), s("point"), s("point_question")), dt)
    wh.write_day("dws_qz_course", course_dim(s("site_course"), s("course"), s("edusubject")), dt)
    wh.write_day("dws_qz_major", major_dim(s("major"), s("exam_website"), s("business")), dt)
    wh.write_day("dws_qz_paper", paper_dim(s("paper_view"), s("center_paper"), s("center"), s("paper")), dt)
    wh.write_day("dws_qz_question", question_dim(s("question"), s("question_type")), dt)


def build_answers(wh: Warehouse, dt: str) -> None:
    """Daily job: the wide answers, and the same answers once each for the reports; written by tenant as the joins leave them."""
    parts = [wh.scan(name, dt) for name in
             ("answer", "chapter_dim", "course_dim", "major_dim", "paper_dim", "question_dim")]
    wh.write_day("dws_user_paper_detail", answer_wide(*parts), dt, rebalance=False)
    wh.write_day("dws_user_paper_answer", answer_grain(*parts), dt, rebalance=False)


def answer_summary(detail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two mergeable histograms in one pass: answers and spent time per paper and score, and answers per question and flag.

    A paper has few distinct scores, so all reports that only need its scores are read from these rows.
    """
    by_score, by_flag = [*PAPER_KEYS, "score"], ["questionid", "dt", "dn", "user_question_answer"]
    every = list(dict.fromkeys(by_score + by_flag))
    both = materialize(detail.groupingSets([[F.col(c) for c in by_score], [F.col(c) for c in by_flag]], *every).agg(
        F.grouping("questionid").alias("_paper"), F.count(F.lit(1)).alias("n"), F.sum("spendtime").alias("spent"),
        F.count("spendtime").alias("timed")), "answer-summary")
    return (both.where("_paper = 1").select(*by_score, "n", "spent", "timed"),
            both.where("_paper = 0").select(*by_flag, "n"))


def paper_summary(scores: DataFrame) -> DataFrame:
    """Averages, extremes, passes and fails per paper from :func:`answer_summary`; the columns of three reports."""
    score, n = F.col("score"), F.col("n")
    scored = F.sum(F.when(score.isNotNull(), n)).cast("decimal(20,0)")
    none = F.lit(0).cast("bigint")
    return scores.groupBy(*PAPER_KEYS).agg(
        F.round(F.sum(score * n) / scored, 1).try_cast("decimal(4,1)").alias("avgscore"),
        (F.sum("spent") / F.sum("timed")).try_cast("decimal(10,2)").alias("avgspendtime"),
        F.max(score).try_cast("decimal(4,1)").alias("maxscore"), F.min(score).try_cast("decimal(4,1)").alias("minscore"),
        F.sum(F.when(score > PASS_MARK, n).otherwise(none)).alias("passcount"),
        F.sum(F.when(score.between(0, PASS_MARK), n).otherwise(none)).alias("unpasscount"))


def extreme_answers(detail: DataFrame, scores: DataFrame, n: int = 3) -> DataFrame:
    """The answers with one of the ``n`` best or least scores of their paper, with the ranks ``top`` and ``low``.

    Ranks are given to the scores of the histogram; answers are read once and only those that qualify go on.
    """
    distinct = scores.select("paperviewid", "score").distinct()
    down, up = (Window.partitionBy("paperviewid").orderBy(o) for o in (F.desc_nulls_last("score"), F.asc_nulls_first("score")))
    limits = (distinct.withColumn("top", F.row_number().over(down)).withColumn("low", F.row_number().over(up))
              .where((F.col("top") <= n) | (F.col("low") <= n)).withColumnsRenamed({"paperviewid": "_paper", "score": "_score"}))
    limits = materialize(limits, "score-limits")
    same = F.col("paperviewid").eqNullSafe(F.col("_paper")) & F.col("score").eqNullSafe(F.col("_score"))
    return detail.join(limits, same).drop("_paper", "_score")


def report_exams(wh: Warehouse, dt: str, dedupe: bool = True, inner_only: bool = False) -> None:
    """Daily job: seven report tables from three passes over the answers. ``dedupe=False`` reports on the repeated rows of the wide
    table, repeated users in score bands included; ``copy`` numbers the rows of a band part then, and is 0 otherwise."""
    detail = wh.scan("answer_grain" if dedupe else "answer_detail", dt)
    scores, flags = answer_summary(detail)
    papers = materialize(paper_summary(scores), "paper-summary")
    wh.write_day("ads_paper_avgtimeandscore", papers, dt)
    wh.write_day("ads_paper_maxdetail", papers, dt)

    def rated(rows: DataFrame, part: str, other: str) -> DataFrame:
        met = [F.col(part) > 0, F.col(other) > 0]
        return rows.where(met[0] & met[1] if inner_only else met[0] | met[1]).withColumn("rate", S.rate(F.col(part), F.col(other)))

    def flagged(flag: int, name: str) -> Column:
        return F.sum(F.when(F.col("user_question_answer") == flag, F.col("n")).otherwise(F.lit(0).cast("bigint"))).alias(name)

    wh.write_day("ads_user_paper_detail", rated(papers, "passcount", "unpasscount"), dt)
    questions = flags.groupBy("questionid", "dt", "dn").agg(flagged(0, "errcount"), flagged(1, "rightcount"))
    wh.write_day("ads_user_question_detail", rated(questions, "errcount", "rightcount"), dt)
    extreme = materialize(extreme_answers(detail, scores), "extreme-answers")
    wh.write_day("ads_top3_userdetail", extreme.where("top <= 3").withColumnRenamed("top", "rk"), dt)
    wh.write_day("ads_low3_userdetail", extreme.where("low <= 3").withColumnRenamed("low", "rk"), dt)
    bands = band_users(detail, distinct=dedupe)
    wh.write_day("ads_paper_scoresegment_user", bands.withColumn("copy", F.lit(0)) if dedupe else bands, dt, rebalance=False)


def ordered_report(wh: Warehouse, table: str, dt: str, *order: str) -> DataFrame:
    """A report of one day in the order a reader asks for: columns, ``-column`` descending."""
    return wh.read(table, dt).orderBy(*[F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order])


def write_ordered(wh: Warehouse, table: str, report: DataFrame, dt: str, *order: str, partitions: int = 32) -> None:
    """One day of a report as files that follow each other in ``order`` (as in :func:`ordered_report`), with the ``place`` of each row.

    Rows are sorted once, by ranges; readers take places from ``0`` on and need no sort (:func:`read_ordered`).
    """
    by = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]
    ranged = report.repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    in_part = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the lower 33 bits count the rows of a partition
    numbered = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", in_part), "ordered")
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))  # a row per partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    placed = numbered.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + F.col("_row"))
    placed.drop("_part", "_row", "_before").write.mode("overwrite").parquet(f"{wh.path(table)}_ordered/{dt}")


def read_ordered(wh: Warehouse, table: str, dt: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows ``first`` to ``last`` of an ordered report; files without any of these places are skipped by their statistics."""
    rows = wh.spark.read.parquet(f"{wh.path(table)}_ordered/{dt}").where(F.col("place") >= first)
    return rows if last is None else rows.where(F.col("place") <= last)
