"""Declarative description of every raw log and warehouse table.

A field is written ``name`` (text) or ``name:type`` with the types

``int``    integer, 0 when missing          ``dec1``   decimal rounded HALF_UP to one place
``dec1z``  like ``dec1``, 0.0 when missing   ``name<a|b`` read the first present of keys a, b
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from lectern.functions import scalars as S

INT, TEXT, DEC1 = T.IntegerType(), T.StringType(), T.DecimalType(18, 1)
TYPES = {"int": INT, "text": TEXT, "dec1": DEC1, "dec1z": DEC1}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"
    keys: tuple[str, ...] = ()

    @property
    def type(self) -> T.DataType:
        return TYPES[self.kind]

    def read(self, parsed: str) -> Column:
        """Typed value out of the parsed JSON struct, whose members are all text."""
        raw = F.coalesce(*[F.col(f"{parsed}.{key}") for key in self.keys])
        if self.kind == "int":
            raw = S.int_or_zero(raw)
        elif self.kind == "dec1":
            raw = S.half_up(raw)
        elif self.kind == "dec1z":
            raw = F.coalesce(S.half_up(raw), F.lit(0).cast(DEC1))
        return raw.alias(self.name)


def _field(text: str) -> Field:
    head, _, keys = text.partition("<")
    name, _, kind = head.partition(":")
    return Field(name, kind or "text", tuple(keys.split("|")) if keys else (name,))


@dataclass(frozen=True)
class LogSpec:
    """One raw JSON log and the cleaned table it feeds."""

    file: str
    table: str
    fields: tuple[Field, ...]
    mode: str                 # "overwrite" dimension or "append" daily facts
    strict: bool              # a malformed line fails the job instead of being set aside

    @property
    def partitions(self) -> tuple[str, ...]:
        return tuple(n for n in ("dt", "dn") if any(f.name == n for f in self.fields))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type) for f in self.fields])

    @property
    def json_schema(self) -> T.StructType:
        keys = dict.fromkeys(key for f in self.fields for key in f.keys)
        return T.StructType([T.StructField(key, TEXT) for key in keys])


def _log(file: str, table: str, mode: str, strict: bool, fields: str) -> LogSpec:
    return LogSpec(file, table, tuple(_field(f) for f in fields.split()), mode, strict)


# File names, tables, field names and types of the raw logs (misspelt keys included).
LOGS: dict[str, LogSpec] = {spec.table: spec for spec in [
    _log("baswewebsite.log", "dwd_base_website", "overwrite", True,
         "siteid:int sitename siteurl delete createtime creator dn"),
    _log("member.log", "dwd_member", "append", True,
         "uid:int ad_id:int birthday email fullname iconurl lastlogin mailaddr memberlevel password paymoney "
         "phone qq register regupdatetime unitname userip zipcode dt dn"),
    _log("baseadlog.log", "dwd_base_ad", "overwrite", True, "adid:int adname dn"),
    _log("memberRegtype.log", "dwd_member_regtype", "append", True,
         "uid:int appkey appregurl bdp_uuid createtime isranreg regsource regsourcename websiteid:int dt dn"),
    _log("pcentermempaymoney.log", "dwd_pcentermempaymoney", "append", True,
         "uid:int paymoney siteid:int vip_id:int dt dn"),
    _log("pcenterMemViplevel.log", "dwd_vip_level", "overwrite", True,
         "vip_id:int vip_level start_time end_time last_modify_time max_free min_free next_level operator dn"),
    _log("QzChapter.log", "dwd_qz_chapter", "append", True,
         "chapterid:int chapterlistid:int chaptername sequence showstatus creator createtime courseid:int "
         "chapternum:int outchapterid:int dt dn"),
    _log("QzChapterList.log", "dwd_qz_chapter_list", "append", True,
         "chapterlistid:int chapterlistname courseid:int sequence chapterallnum:int status creator createtime dt dn"),
    _log("QzPoint.log", "dwd_qz_point", "append", False,
         "pointid:int courseid:int pointname pointyear chapter creator createtime status modifystatus excisenum:int "
         "pointlistid:int chapterid:int sequence pointdescribe pointlevel typelist score:dec1 thought remid "
         "pointnamelist typelistids pointlist dt dn"),
    _log("QzPointQuestion.log", "dwd_qz_point_question", "append", True,
         "pointid:int questionid:int questype:int<questtype creator createtime dt dn"),
    _log("QzSiteCourse.log", "dwd_qz_site_course", "append", False,
         "sitecourseid:int siteid:int courseid:int sitecoursename coursechapter sequence status creator createtime "
         "helppaperstatus servertype boardid:int showstatus dt dn"),
    _log("QzCourse.log", "dwd_qz_course", "append", False,
         "courseid:int majorid:int coursename coursechapter sequence<sequnece|sequence isadvc creator createtime "
         "status chapterlistid:int pointlistid:int dt dn"),
    _log("QzCourseEduSubject.log", "dwd_qz_course_edusubject", "append", False,
         "courseeduid:int edusubjectid:int courseid:int creator createtime majorid:int dt dn"),
    _log("QzWebsite.log", "dwd_qz_website", "append", False,
         "siteid:int sitename domain sequence multicastserver templateserver status creator createtime "
         "multicastgateway multicastport dt dn"),
    _log("QzMajor.log", "dwd_qz_major", "append", False,
         "majorid:int businessid:int siteid:int majorname shortname status sequence creator createtime "
         "columm_sitetype dt dn"),
    _log("QzBusiness.log", "dwd_qz_business", "append", False,
         "businessid:int businessname sequence status creator createtime siteid:int dt dn"),
    _log("QzPaperView.log", "dwd_qz_paper_view", "append", False,
         "paperviewid:int paperid:int paperviewname paperparam openstatus explainurl iscontest contesttime "
         "conteststarttime contestendtime contesttimelimit dayiid:int status creator createtime paperviewcatid:int "
         "modifystatus description papertype downurl paperuse paperdifficult testreport paperuseshow dt dn"),
    _log("QzCenterPaper.log", "dwd_qz_center_paper", "append", False,
         "paperviewid:int centerid:int openstatus sequence creator createtime dt dn"),
    _log("QzPaper.log", "dwd_qz_paper", "append", False,
         "paperid:int papercatid:int courseid:int paperyear chapter suitnum papername status creator createtime "
         "totalscore:dec1 chapterid:int chapterlistid:int dt dn"),
    _log("QzCenter.log", "dwd_qz_center", "append", False,
         "centerid:int centername centeryear centertype openstatus centerparam description creator createtime "
         "sequence provideuser centerviewtype stage dt dn"),
    _log("QzQuestion.log", "dwd_qz_question", "append", False,
         "questionid:int parentid:int questypeid:int quesviewtype:int content answer analysis limitminute "
         "score:dec1z splitscore:dec1z status optnum:int lecture creator createtime modifystatus attanswer questag "
         "vanalysisaddr difficulty quesskill vdeoaddr dt dn"),
    _log("QzQuestionType.log", "dwd_qz_question_type", "append", False,
         "quesviewtype:int viewtypename questypeid:int description status creator createtime papertypename sequence "
         "remark splitscoretype dt dn"),
    _log("QzMemberPaperQuestion.log", "dwd_qz_member_paper_question", "append", False,
         "userid:int paperviewid:int chapterid:int sitecourseid:int questionid:int majorid:int useranswer istrue "
         "lasttime opertype paperid:int spendtime:int score:dec1 question_answer:int dt dn"),
]}

MEMBER_LOGS = tuple(t for t in LOGS if not t.startswith("dwd_qz_"))
EXAM_LOGS = tuple(t for t in LOGS if t.startswith("dwd_qz_"))

# Fields of the stream records.
REGISTER_FIELDS = ("register_id", "platform", "register_time")
QUESTION_FIELDS = ("uid", "courseid", "pointid", "questionid", "isright", "createtime")
PAGE_FIELDS = ("uid", "app_id", "device_id", "ip", "last_page_id", "page_id", "next_page_id")
LEARN_INTS = ("uid", "cwareid", "videoid", "chapterid", "edutypeid", "subjectid", "speed", "ps", "pe")
LEARN_LONGS = ("ts", "te")
LEARN_TEXTS = ("sourceType",)
