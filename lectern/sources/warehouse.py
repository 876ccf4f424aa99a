"""Warehouse tables and the column scans the jobs read them through."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lectern.sinks.history import HistoryTable
from lectern.sinks.tables import write_partitions
from lectern.sources.specs import DEC1, INT, LOGS, TEXT

MONEY_SUM = T.DecimalType(20, 4)
LONG = T.LongType()

_KINDS = {"int": INT, "text": TEXT, "long": LONG, "dec1": DEC1, "money": MONEY_SUM,
          "avg1": T.DecimalType(4, 1), "avg2": T.DecimalType(10, 2), "rate": T.DecimalType(4, 2)}


def _schema(text: str) -> T.StructType:
    pairs = [(name, kind or "text") for name, _, kind in (f.partition(":") for f in text.split())]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


# Columns of the joined and the report tables.
DERIVED: dict[str, T.StructType] = {name: _schema(text) for name, text in {
    "dws_member":
        "uid:int ad_id:int fullname iconurl lastlogin mailaddr memberlevel password paymoney:money phone qq register "
        "regupdatetime unitname userip zipcode appkey appregurl bdp_uuid reg_createtime isranreg regsource "
        "regsourcename adname siteid:int sitename siteurl site_delete site_createtime site_creator vip_id:int "
        "vip_level vip_start_time vip_end_time vip_last_modify_time vip_max_free vip_min_free vip_next_level "
        "vip_operator dt dn",
    "dws_member_zipper": "uid:int paymoney:money vip_level start_time end_time dn",
    "dws_qz_chapter":
        "chapterid:int chapterlistid:int chaptername sequence showstatus status chapter_creator chapter_createtime "
        "chapter_courseid:int chapternum:int chapterallnum:int outchapterid:int chapterlistname pointid:int "
        "questionid:int questype:int pointname pointyear chapter excisenum:int pointlistid:int pointdescribe "
        "pointlevel typelist point_score:dec1 thought remid pointnamelist typelistids pointlist dt dn",
    "dws_qz_course":
        "sitecourseid:int siteid:int courseid:int sitecoursename coursechapter sequence status sitecourse_creator "
        "sitecourse_createtime helppaperstatus servertype boardid:int showstatus majorid:int coursename isadvc "
        "chapterlistid:int pointlistid:int courseeduid:int edusubjectid:int dt dn",
    "dws_qz_major":
        "majorid:int businessid:int siteid:int majorname shortname status sequence major_creator major_createtime "
        "businessname sitename domain multicastserver templateserver multicastgateway multicastport dt dn",
    "dws_qz_paper":
        "paperviewid:int paperid:int paperviewname paperparam openstatus explainurl iscontest contesttime "
        "conteststarttime contestendtime contesttimelimit dayiid:int status paper_view_creator paper_view_createtime "
        "paperviewcatid:int modifystatus description paperuse paperdifficult testreport paperuseshow centerid:int "
        "sequence centername centeryear centertype provideuser centerviewtype stage papercatid:int courseid:int "
        "paperyear suitnum papername totalscore:dec1 chapterid:int chapterlistid:int dt dn",
    "dws_qz_question":
        "questionid:int parentid:int questypeid:int quesviewtype:int content answer analysis limitminute score:dec1 "
        "splitscore:dec1 status optnum:int lecture creator createtime modifystatus attanswer questag vanalysisaddr "
        "difficulty quesskill vdeoaddr viewtypename papertypename remark description splitscoretype dt dn",
    "dws_user_paper_detail":
        "userid:int courseid:int questionid:int useranswer istrue lasttime opertype paperid:int spendtime:int "
        "chapterid:int chaptername chapternum:int chapterallnum:int outchapterid:int chapterlistname pointid:int "
        "questype:int pointyear chapter pointname excisenum:int pointdescribe pointlevel typelist point_score:dec1 "
        "thought remid pointnamelist typelistids pointlist sitecourseid:int siteid:int sitecoursename coursechapter "
        "course_sequence course_status course_creator course_createtime servertype helppaperstatus boardid:int "
        "showstatus majorid:int coursename isadvc chapterlistid:int pointlistid:int courseeduid:int edusubjectid:int "
        "businessid:int majorname shortname major_status major_sequence major_creator major_createtime businessname "
        "sitename domain multicastserver templateserver multicastgateway multicastport paperviewid:int paperviewname "
        "paperparam openstatus explainurl iscontest contesttime conteststarttime contestendtime contesttimelimit "
        "dayiid:int paper_status paper_view_creator paper_view_createtime paperviewcatid:int modifystatus description "
        "paperuse testreport centerid:int paper_sequence centername centeryear centertype provideuser centerviewtype "
        "paper_stage papercatid:int paperyear suitnum papername totalscore:dec1 question_parentid:int questypeid:int "
        "quesviewtype:int question_content question_answer question_analysis question_limitminute score:dec1 "
        "splitscore:dec1 lecture question_creator question_createtime question_modifystatus question_attanswer "
        "question_questag question_vanalysisaddr question_difficulty quesskill vdeoaddr question_description "
        "question_splitscoretype user_question_answer:int dt dn",
    "dws_user_paper_answer":
        "userid:int questionid:int paperviewid:int paperviewname chaptername pointname sitecoursename coursename "
        "majorname shortname sitename papername score:dec1 spendtime:int user_question_answer:int dt dn",
    "ads_register_appregurlnum": "appregurl num:long dt dn",
    "ads_register_sitenamenum": "sitename num:long dt dn",
    "ads_register_regsourcenamenum": "regsourcename num:long dt dn",
    "ads_register_adnamenum": "adname num:long dt dn",
    "ads_register_memberlevelnum": "memberlevel num:long dt dn",
    "ads_register_viplevelnum": "vip_level num:long dt dn",
    "ads_register_top3memberpay":
        "uid:int memberlevel register appregurl regsourcename adname sitename vip_level paymoney:money rownum:int dt dn",
    "ads_paper_avgtimeandscore": "paperviewid:int paperviewname avgscore:avg1 avgspendtime:avg2 dt dn",
    "ads_paper_maxdetail": "paperviewid:int paperviewname maxscore:avg1 minscore:avg1 dt dn",
    "ads_top3_userdetail":
        "userid:int paperviewid:int paperviewname chaptername pointname sitecoursename coursename majorname shortname "
        "sitename papername score:dec1 rk:int dt dn",
    "ads_low3_userdetail":
        "userid:int paperviewid:int paperviewname chaptername pointname sitecoursename coursename majorname shortname "
        "sitename papername score:dec1 rk:int dt dn",
    "ads_paper_scoresegment_user": "paperviewid:int paperviewname score_segment part:long copy:int userids dt dn",
    "ads_user_paper_detail":
        "paperviewid:int paperviewname unpasscount:long passcount:long rate:rate dt dn",
    "ads_user_question_detail": "questionid:int errcount:long rightcount:long rate:rate dt dn",
}.items()}

SCHEMAS: dict[str, T.StructType] = {**{t: spec.schema for t, spec in LOGS.items()}, **DERIVED}


class Warehouse:
    """Parquet tables below one root: ``<root>/<layer>/<table>/dt=.../dn=...``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table.split('_')[0]}/{table}"

    def partitions(self, table: str) -> list[str]:
        return [c for c in ("dt", "dn") if c in SCHEMAS[table].names]

    def read(self, table: str, dt: str | None = None) -> DataFrame:
        """The table with its declared schema; ``dt`` prunes to one day (compared as text)."""
        df = self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))
        df = shape(df, table)
        return df if dt is None else df.where(F.col("dt") == F.lit(str(dt)))

    def write(self, table: str, df: DataFrame, mode: str = "overwrite", compression: str = "snappy") -> None:
        write_partitions(typed(df, table), self.path(table), self.partitions(table), mode, compression)

    def write_day(self, table: str, df: DataFrame, dt: str, rebalance: bool = True) -> None:
        """Replace one day of a table, or all of a table without days; ``df`` holds rows of that day only.

        Everything of the day goes first, also the partition of a tenant that has no rows any more. Rows that come from a shuffle
        of their own, in partitions the planner has merged already, need not be shuffled again by ``rebalance``.
        """
        rows = typed(df, table)
        if "dt" not in SCHEMAS[table].names:
            write_partitions(rows, self.path(table), self.partitions(table), "replace", rebalance=rebalance)
            return
        write_partitions(rows.where(F.col("dt") == F.lit(str(dt))).drop("dt"), f"{self.path(table)}/dt={dt}",
                         [c for c in self.partitions(table) if c != "dt"], "replace", rebalance=rebalance)

    def write_load(self, table: str, df: DataFrame, load: str) -> None:
        """Add the rows of one load to a daily log, in ``load=<load>``; the same load again replaces itself.

        Rows of any day may come in any load: days of other loads stay as they are.
        """
        write_partitions(typed(df, table), f"{self.path(table)}/load={load}", self.partitions(table), "replace")

    def history(self, table: str, keys: Sequence[str], start: str, measure: str) -> HistoryTable:
        return HistoryTable(self.spark, self.path(table), keys, start, measure)

    def scan(self, name: str, dt: str | None = None) -> DataFrame:
        """One of the named :data:`SCANS`: projection, renames and day filter."""
        table, columns = SCANS[name]
        by_day = dt if "dt" in SCHEMAS[table].names else None
        return scan_columns(self.read(table, by_day), name)

    def scan_until(self, name: str, dt: str) -> DataFrame:
        """A named scan of all days up to ``dt``: what was known on that day, also in a later re-run of it."""
        return scan_columns(self.read(SCANS[name][0]).where(F.col("dt") <= F.lit(str(dt))), name)


def scan_columns(df: DataFrame, name: str) -> DataFrame:
    """The projection of a named scan applied to a frame with the table's columns."""
    out = []
    for item in SCANS[name][1]:
        source, _, alias = item.partition(">")
        if (name, source) == ("payment", "paymoney"):
            out.append("try_cast(paymoney AS decimal(10,4)) AS paymoney")
        else:
            out.append(f"`{source}` AS `{alias or source}`")
    return df.selectExpr(*out)


def shape(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table, in order."""
    return df.selectExpr(*[f"`{c}`" for c in SCHEMAS[table].names])


def typed(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table, in order and cast to its types; a value that doesn't fit its type is null."""
    return df.selectExpr(*[f"TRY_CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`"
                           for f in SCHEMAS[table].fields])


# Scan name -> (table, columns), where ``a>b`` reads a under the name b.
SCANS: dict[str, tuple[str, list[str]]] = {name: (table, columns.split()) for name, (table, columns) in {
    "member": ("dwd_member",
               "uid ad_id email fullname iconurl lastlogin mailaddr memberlevel password phone qq register "
               "regupdatetime unitname userip zipcode dt dn"),
    "regtype": ("dwd_member_regtype",
                "uid appkey appregurl bdp_uuid createtime>reg_createtime isranreg regsource regsourcename "
                "websiteid>siteid dn"),
    "ad": ("dwd_base_ad", "adid>ad_id adname dn"),
    "website": ("dwd_base_website",
                "siteid sitename siteurl delete>site_delete createtime>site_createtime creator>site_creator dn"),
    "vip": ("dwd_vip_level",
            "vip_id vip_level start_time>vip_start_time end_time>vip_end_time "
            "last_modify_time>vip_last_modify_time max_free>vip_max_free min_free>vip_min_free "
            "next_level>vip_next_level operator>vip_operator dn"),
    "payment": ("dwd_pcentermempaymoney", "uid paymoney vip_id dt dn"),
    "member_report": ("dws_member",
                      "uid ad_id memberlevel register appregurl regsource regsourcename adname siteid sitename "
                      "vip_level paymoney dt dn"),
    "chapter": ("dwd_qz_chapter",
                "chapterid chapterlistid chaptername sequence showstatus creator>chapter_creator "
                "createtime>chapter_createtime courseid>chapter_courseid chapternum outchapterid dt dn"),
    "chapter_list": ("dwd_qz_chapter_list", "chapterlistid chapterlistname chapterallnum status dn"),
    "point": ("dwd_qz_point",
              "pointid pointname pointyear chapter excisenum pointlistid chapterid pointdescribe pointlevel typelist "
              "score>point_score thought remid pointnamelist typelistids pointlist dn"),
    "point_question": ("dwd_qz_point_question", "pointid questionid questype dn"),
    "site_course": ("dwd_qz_site_course",
                    "sitecourseid siteid courseid sitecoursename coursechapter sequence status "
                    "creator>sitecourse_creator createtime>sitecourse_createtime helppaperstatus servertype boardid "
                    "showstatus dt dn"),
    "course": ("dwd_qz_course", "courseid majorid coursename isadvc chapterlistid pointlistid dn"),
    "edusubject": ("dwd_qz_course_edusubject", "courseeduid edusubjectid courseid dn"),
    "major": ("dwd_qz_major",
              "majorid businessid siteid majorname shortname status sequence creator>major_creator "
              "createtime>major_createtime dt dn"),
    "exam_website": ("dwd_qz_website",
                     "siteid sitename domain multicastserver templateserver multicastgateway multicastport dn"),
    "business": ("dwd_qz_business", "businessid businessname dn"),
    "paper_view": ("dwd_qz_paper_view",
                   "paperviewid paperid paperviewname paperparam openstatus explainurl iscontest contesttime "
                   "conteststarttime contestendtime contesttimelimit dayiid status creator>paper_view_creator "
                   "createtime>paper_view_createtime paperviewcatid modifystatus description papertype downurl "
                   "paperuse paperdifficult testreport paperuseshow dt dn"),
    "center_paper": ("dwd_qz_center_paper", "paperviewid sequence centerid dn"),
    "paper": ("dwd_qz_paper",
              "paperid papercatid courseid paperyear chapter suitnum papername totalscore chapterid chapterlistid dn"),
    "center": ("dwd_qz_center",
               "centerid centername centeryear centertype centerparam provideuser centerviewtype stage dn"),
    "question": ("dwd_qz_question",
                 "questionid parentid questypeid quesviewtype content answer analysis limitminute score splitscore "
                 "status optnum lecture creator createtime modifystatus attanswer questag vanalysisaddr difficulty "
                 "quesskill vdeoaddr dt dn"),
    "question_type": ("dwd_qz_question_type",
                      "questypeid viewtypename description papertypename remark splitscoretype dn"),
    "answer": ("dwd_qz_member_paper_question",
               "userid paperviewid chapterid sitecourseid questionid majorid useranswer istrue lasttime opertype "
               "spendtime score question_answer>user_question_answer dt dn"),
    "chapter_dim": ("dws_qz_chapter",
                    "chapterid chapterlistid chaptername chapternum chapterallnum outchapterid chapterlistname pointid "
                    "questype pointname pointyear chapter excisenum pointlistid pointdescribe pointlevel typelist "
                    "point_score thought remid pointnamelist typelistids pointlist dn"),
    "course_dim": ("dws_qz_course",
                   "sitecourseid siteid courseid sitecoursename coursechapter sequence>course_sequence "
                   "status>course_status sitecourse_creator>course_creator sitecourse_createtime>course_createtime "
                   "helppaperstatus servertype boardid showstatus coursename isadvc courseeduid edusubjectid dn"),
    "major_dim": ("dws_qz_major",
                  "majorid businessid majorname shortname status>major_status sequence>major_sequence major_creator "
                  "major_createtime businessname sitename domain multicastserver templateserver multicastgateway "
                  "multicastport dn"),
    "paper_dim": ("dws_qz_paper",
                  "paperviewid paperid paperviewname paperparam openstatus explainurl iscontest contesttime "
                  "conteststarttime contestendtime contesttimelimit dayiid status>paper_status paper_view_creator "
                  "paper_view_createtime paperviewcatid modifystatus description paperuse testreport centerid "
                  "sequence>paper_sequence centername centeryear centertype provideuser centerviewtype "
                  "stage>paper_stage papercatid paperyear suitnum papername totalscore dn"),
    "question_dim": ("dws_qz_question",
                     "questionid parentid>question_parentid questypeid quesviewtype content>question_content "
                     "answer>question_answer analysis>question_analysis limitminute>question_limitminute "
                     "score>question_score splitscore lecture creator>question_creator createtime>question_createtime "
                     "modifystatus>question_modifystatus attanswer>question_attanswer questag>question_questag "
                     "vanalysisaddr>question_vanalysisaddr difficulty>question_difficulty quesskill vdeoaddr "
                     "description>question_description splitscoretype>question_splitscoretype dn"),
    "payment_history": ("dws_member_zipper", "uid paymoney vip_level start_time end_time dn"),
    "answer_detail": ("dws_user_paper_detail",
                      "userid questionid paperviewid paperviewname chaptername pointname sitecoursename coursename "
                      "majorname shortname sitename papername score spendtime user_question_answer dt dn"),
    "answer_grain": ("dws_user_paper_answer",
                     "userid questionid paperviewid paperviewname chaptername pointname sitecoursename coursename "
                     "majorname shortname sitename papername score spendtime user_question_answer dt dn"),
}.items()}
