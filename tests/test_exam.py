import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from lectern.plans import etl, exam
from lectern.queries.roles import land_logs
from lectern.sources.warehouse import SCHEMAS, Warehouse

DAY = "20190722"


def raw_logs(folder):
    """One chapter with two points (three questions), two centers for paper 1, paper 2 without a center.

    Answers of paper 1: scores 0, 60, 60.5, 100, 100, 90, 80. Paper 2 has only passes. Question 2 is never wrong.
    """
    answers = [(1, 1, 1, "0", 0), (2, 1, 1, "60", 1), (3, 1, 1, "60.5", 1), (4, 1, 1, "100", 1), (5, 1, 2, "100", 1),
               (6, 1, 2, "90", 1), (7, 1, 2, "80", 1), (8, 2, 1, "70.25", 0)]
    logs = {
        "QzChapter": [{"chapterid": 1, "chapterlistid": 1, "chaptername": "C1", "courseid": 9}],
        "QzChapterList": [{"chapterlistid": 1, "chapterlistname": "L1"}],
        "QzPoint": [{"pointid": p, "chapterid": 1, "pointname": f"P{p}", "score": "1.25"} for p in (1, 2)],
        "QzPointQuestion": [{"pointid": p, "questionid": q, "questtype": 1} for p, q in ((1, 1), (1, 2), (2, 1))],
        "QzSiteCourse": [{"sitecourseid": 1, "siteid": 1, "courseid": 1, "sitecoursename": "SC"}],
        "QzCourse": [{"courseid": 1, "majorid": 1, "coursename": "CN", "sequnece": "1"}],
        "QzCourseEduSubject": [{"courseeduid": 1, "edusubjectid": 1, "courseid": 1}],
        "QzWebsite": [{"siteid": 1, "sitename": "W"}],
        "QzMajor": [{"majorid": 1, "businessid": 1, "siteid": 1, "majorname": "M", "shortname": "m"}],
        "QzBusiness": [{"businessid": 1, "businessname": "B"}],
        "QzPaperView": [{"paperviewid": v, "paperid": 1, "paperviewname": f"V{v}"} for v in (1, 2)],
        "QzCenterPaper": [{"paperviewid": 1, "centerid": c} for c in (1, 2)],
        "QzCenter": [{"centerid": c, "centername": f"Z{c}"} for c in (1, 2)],
        "QzPaper": [{"paperid": 1, "papername": "PP", "totalscore": "100.05"}],
        "QzQuestion": [{"questionid": q, "questypeid": 1, "content": f"Q{q}", "score": 2} for q in (1, 2)],
        "QzQuestionType": [{"questypeid": 1, "viewtypename": "T", "description": "D"}],
        "QzMemberPaperQuestion": [
            {"userid": u, "paperviewid": v, "chapterid": 1, "sitecourseid": 1, "questionid": q, "majorid": 1,
             "spendtime": 10, "score": s, "question_answer": a} for u, v, q, s, a in answers],
    }
    folder.mkdir(exist_ok=True)
    for name, records in logs.items():
        tenants = [{**r, "dt": DAY, "dn": dn} for r in records for dn in ("a", "b")]
        (folder / f"{name}.log").write_text("\n".join(map(json.dumps, tenants)) + "\n")
    return str(folder)


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("exam")
    wh = Warehouse(spark, str(root / "wh"))
    assert set(etl.load_exam_logs(wh, raw_logs(root / "raw")).values()) == {0}
    for _ in range(2):                     # the day runs twice
        exam.build_dims(wh, DAY)
        exam.build_answers(wh, DAY)
        exam.report_exams(wh, DAY)
    return wh


def tenant_a(df):
    return df.where("dn = 'a'").collect()


def test_dimensions(warehouse):
    assert len(tenant_a(warehouse.read("dws_qz_chapter", DAY))) == 3
    assert sorted((r.paperviewid, r.centername, r.totalscore) for r in tenant_a(warehouse.read("dws_qz_paper", DAY))) == [
        (1, "Z1", Decimal("100.1")), (1, "Z2", Decimal("100.1")), (2, None, Decimal("100.1"))]
    assert {r.description for r in tenant_a(warehouse.read("dws_qz_question", DAY))} == {"D"}


def test_wide_rows_repeat_and_grain_does_not(warehouse):
    wide = tenant_a(warehouse.read("dws_user_paper_detail", DAY))
    assert len(wide[0]) == 119 and len(wide) == 7 * 3 * 2 + 1 * 3
    assert {r.question_description for r in wide} == {"D"}
    grain = tenant_a(warehouse.read("dws_user_paper_answer", DAY))
    assert sorted((r.userid, r.pointname) for r in grain) == [(u, "P1") for u in range(1, 9)]


ANSWER_PARTS = "answer chapter_dim course_dim major_dim paper_dim question_dim".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("build", [exam.answer_wide, exam.answer_grain])
def test_answers_are_shuffled_for_grown_dimensions_only(warehouse, build):
    """Questions first, chapters, which repeat answers, last; courses and majors after the last shuffle."""
    joins = [line for line in plan(build(*[warehouse.scan(name, DAY) for name in ANSWER_PARTS])).splitlines() if "Join [" in line]
    keys = [(name, next(k for k in ("major", "sitecourse", "chapter", "paperview", "question") if f"[{k}id#" in line))
            for line in joins for name in ("SortMergeJoin", "BroadcastHashJoin") if name in line]
    assert keys == [("BroadcastHashJoin", "major"), ("BroadcastHashJoin", "sitecourse"), ("SortMergeJoin", "chapter"),
                    ("SortMergeJoin", "paperview"), ("SortMergeJoin", "question")]


def test_wide_answers_go_narrow_through_the_joins(warehouse):
    """No join of the wide answers carries the columns of the dimensions one by one; only what is asked for is read of them."""
    wide = exam.answer_wide(*[warehouse.scan(name, DAY) for name in ANSWER_PARTS])
    assert wide.columns == SCHEMAS["dws_user_paper_detail"].names

    def joins(node):
        below = [j for k in range(node.children().size()) for j in joins(node.children().apply(k))]
        return below + [node.output().size()] if node.nodeName() == "Join" else below

    widths = joins(wide._jdf.queryExecution().optimizedPlan())
    assert len(widths) == 5 and max(widths) < 30
    scans = [line for line in plan(wide.select("userid", "papername")).splitlines() if "dws_qz_" in line]
    assert scans and not any("content" in line or "chaptername" in line for line in scans)


def test_logs_land_packed_and_answers_are_written_without_another_shuffle(spark, tmp_path, monkeypatch):
    """Logs of the job are read back from packed files; the two answer tables and the id lists take no rebalancing shuffle."""
    line = spark.createDataFrame([(1, "L")], "chapterlistid int, chapterlistname string")
    land_logs({"dwd_qz_chapter_list": line}, str(tmp_path / "logs"))
    assert {f.suffix for f in (tmp_path / "logs" / "QzChapterList.log").glob("part-*")} == {".gz"}
    wh = Warehouse(spark, str(tmp_path / "wh"))
    assert etl.load_log(wh, "dwd_qz_chapter_list", str(tmp_path / "logs")) == 0
    assert [r.chapterlistname for r in wh.read("dwd_qz_chapter_list").collect()] == ["L"]
    assert set(etl.load_exam_logs(wh, raw_logs(tmp_path / "raw")).values()) == {0}
    exam.build_dims(wh, DAY)
    hinted = []
    monkeypatch.setattr(DataFrame, "hint", lambda df, name, *a, f=DataFrame.hint: hinted.append(name) or f(df, name, *a))
    exam.build_answers(wh, DAY)
    assert set(hinted) == {"merge"}


def test_best_scores_run_the_joins_of_the_answers_once(warehouse):
    """Ranks are given to the few stored rows that qualify, so no join of the answers is left in the plan."""
    grain = exam.answer_grain(*[warehouse.scan(name, DAY) for name in ANSWER_PARTS])
    for ranked, table in ((exam.top_scores(grain), "ads_top3_userdetail"), (exam.low_scores(grain), "ads_low3_userdetail")):
        assert plan(ranked).count("Join [") == 1
        assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, warehouse.read(table, DAY).collect()))


def test_reports(warehouse):
    def read(table):
        return tenant_a(warehouse.read(table, DAY))

    assert sorted((r.paperviewname, r.avgscore, r.avgspendtime) for r in read("ads_paper_avgtimeandscore")) == [
        ("V1", Decimal("70.1"), Decimal("10.00")), ("V2", Decimal("70.3"), Decimal("10.00"))]
    assert sorted((r.paperviewname, r.maxscore, r.minscore) for r in read("ads_paper_maxdetail")) == [
        ("V1", Decimal(100), Decimal(0)), ("V2", Decimal("70.3"), Decimal("70.3"))]
    top = sorted((r.paperviewname, r.rk, r.userid) for r in read("ads_top3_userdetail"))
    assert top == [("V1", 1, 4), ("V1", 1, 5), ("V1", 2, 6), ("V1", 3, 7), ("V2", 1, 8)]
    low = sorted((r.paperviewname, r.rk, r.userid) for r in read("ads_low3_userdetail"))
    assert low == [("V1", 1, 1), ("V1", 2, 2), ("V1", 3, 3), ("V2", 1, 8)]
    bands = {(r.paperviewname, r.score_segment): r.userids for r in read("ads_paper_scoresegment_user")}
    assert bands == {("V1", "0-20"): "1", ("V1", "40-60"): "2", ("V1", "60-80"): "3,7", ("V1", "80-100"): "4,5,6",
                     ("V2", "60-80"): "8"}
    assert sorted((r.paperviewname, r.unpasscount, r.passcount, r.rate) for r in read("ads_user_paper_detail")) == [
        ("V1", 2, 5, Decimal("0.71")), ("V2", 0, 1, Decimal("1.00"))]
    assert sorted((r.questionid, r.errcount, r.rightcount, r.rate) for r in read("ads_user_question_detail")) == [
        (1, 2, 3, Decimal("0.40")), (2, 0, 3, Decimal("0.00"))]


def test_parity_mode_counts_repeated_rows(warehouse):
    wide = warehouse.scan("answer_detail", DAY).where("dn = 'a'")
    rows = exam.pass_rates(wide, inner_only=True).collect()
    assert [(r.paperviewname, r.unpasscount, r.passcount) for r in rows] == [("V1", 12, 30)]
    assert [r.questionid for r in exam.error_rates(wide, inner_only=True).collect()] == [1]
    band = {r.score_segment: r.userids for r in exam.band_users(wide, distinct=False).collect() if r.paperviewid == 1}
    assert band["0-20"] == "1,1,1,1,1,1"


def test_summary_of_nulls_and_negative_scores(spark):
    rows = [(1, "V", s, t, q, f, DAY, "a") for s, t, q, f in [
        (Decimal("99.9"), 5, 1, "0"), (Decimal("60.0"), None, 1, "1"), (Decimal("-3.0"), 7, 2, "1"), (None, 1, None, None)]]
    detail = spark.createDataFrame(rows, "paperviewid int, paperviewname string, score decimal(4,1), spendtime int, questionid int, "
                                         "user_question_answer string, dt string, dn string")
    scores, flags = exam.answer_summary(detail)
    r = exam.paper_summary(scores).first()
    assert (r.avgscore, r.avgspendtime, r.maxscore, r.minscore, r.passcount, r.unpasscount) == (
        Decimal("52.3"), Decimal("4.33"), Decimal("99.9"), Decimal("-3.0"), 1, 1)
    assert sum(f.n for f in flags.collect()) == 4
    found = exam.extreme_answers(detail, scores, 1).collect()
    assert sorted((str(f.score), f.top, f.low) for f in found) == [("99.9", 1, 4), ("None", 4, 1)]


def test_ordered_report_is_read_without_a_sort(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "ordered"))
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    exam.write_ordered(wh, "ads_user_paper_detail", rows, DAY, "-g", "k", partitions=4)
    got = exam.read_ordered(wh, "ads_user_paper_detail", DAY)
    assert [(r.g, r.k) for r in sorted(got.collect(), key=lambda r: r.place)] == sorted(
        ((r.g, r.k) for r in rows.collect()), key=lambda p: (-p[0], p[1]))
    page = exam.read_ordered(wh, "ads_user_paper_detail", DAY, 10, 19)
    assert page.count() == 10 and "Sort" not in page._jdf.queryExecution().executedPlan().toString()
