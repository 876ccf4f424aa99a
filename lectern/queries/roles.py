"""The supplied star-schema tables in the roles of learning-platform tables.

customer = member, orders = registration and payment, nation = website, course, center, ...,
region = advert, VIP level, business, ..., supplier = chapter and paper view, part = question,
lineitem = answer, events = stream logs. Every reference table exists for two tenants, so joins must use
the tenant as well as the id. Columns without a source are typed nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.plans import etl, exam, member
from lectern.session import materialize
from lectern.sources.specs import LOGS
from lectern.sources.warehouse import SCANS, SCHEMAS, scan_columns

DAY = "20240101"
TENANTS = ("east", "west")
# The event types; their position is the numeric code.
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# The tenant of a key, as SQL text.
TENANT = "CASE WHEN {key} % 2 = 0 THEN 'east' ELSE 'west' END"
# Scores 0.5 to 101.5 in half steps, from quantity and line number, as SQL text.
SCORE = "CAST(l_quantity AS decimal(10,1)) * 2 + (l_linenumber - 4) * 0.5BD"
# The leading digit of the order priority, as SQL text.
CODE = "substring(o_orderpriority, 1, 1)"


def c(name: str) -> Column:
    return F.col(name)


def text(name: str) -> Column:
    return F.col(name).cast("string")


def per_tenant(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", f"explode(array({', '.join(repr(t) for t in TENANTS)})) AS dn")


def as_table(df: DataFrame, table: str, **columns: str) -> DataFrame:
    """``df`` in the shape of a warehouse table, by SQL expression per column; others are null."""
    columns = {"dt": f"'{DAY}'", "dn": "dn", **columns}
    return df.selectExpr(*[f"CAST({columns.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS `{f.name}`"
                           for f in SCHEMAS[table].fields])


class Roles:
    """Cleaned tables of the two subject areas built from one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._exam: dict[str, DataFrame] = {}

    def t(self, table: str) -> DataFrame:
        if table not in self._tables:
            self._tables[table] = load(self.spark, self.sf_dir, table)
        return self._tables[table]

    # member area -----------------------------------------------------------------------------------
    def raw_member(self) -> DataFrame:
        return as_table(
            self.t("customer"), "dwd_member", uid="c_custkey", ad_id="c_nationkey % 5", fullname="c_name",
            memberlevel="c_mktsegment", register="'2024-01-01'", zipcode="c_nationkey",
            phone="concat('138', lpad(c_custkey, 8, '0'))", dn=TENANT.format(key="c_custkey"))

    def member(self) -> DataFrame:
        return scan_columns(etl.mask_member(self.raw_member()), "member")

    def raw_regtype(self) -> DataFrame:
        return as_table(
            self.t("orders"), "dwd_member_regtype", uid="o_custkey", appkey="o_orderstatus",
            appregurl=f"concat('http://app/', {CODE})", createtime="date_format(o_orderdate, 'yyyy-MM-dd')",
            regsource=CODE, regsourcename=CODE, websiteid="o_orderkey % 30", dn=TENANT.format(key="o_custkey"))

    def regtype(self) -> DataFrame:
        return scan_columns(etl.decode_regtype(self.raw_regtype()), "regtype")

    def raw_ad(self) -> DataFrame:
        return as_table(
            per_tenant(self.t("region")), "dwd_base_ad", adid="r_regionkey", adname="concat_ws('@', r_name, dn)")

    def ad(self) -> DataFrame:
        return scan_columns(self.raw_ad(), "ad")

    def raw_website(self) -> DataFrame:
        return as_table(
            per_tenant(self.t("nation")), "dwd_base_website", siteid="n_nationkey",
            sitename="concat_ws('.', n_name, dn)", creator="n_regionkey")

    def website(self) -> DataFrame:
        return scan_columns(self.raw_website(), "website")

    def raw_vip(self) -> DataFrame:
        return as_table(
            per_tenant(self.t("region")), "dwd_vip_level", vip_id="r_regionkey", vip_level="concat('V', r_regionkey)",
            start_time="concat('2020-01-0', r_regionkey + 1)", end_time="concat('2030-01-0', r_regionkey + 1)",
            max_free="r_regionkey * 10", next_level="concat('V', r_regionkey + 1)")

    def vip(self) -> DataFrame:
        return scan_columns(self.raw_vip(), "vip")

    def raw_payment(self) -> DataFrame:
        return self.payments_as_table(self.t("orders"))

    def raw_payment_of(self, orders: DataFrame) -> DataFrame:
        return scan_columns(self.payments_as_table(orders), "payment")

    def payments_as_table(self, orders: DataFrame) -> DataFrame:
        return as_table(
            orders, "dwd_pcentermempaymoney", uid="o_custkey", paymoney="o_totalprice",
            vip_id=CODE, dt="date_format(o_orderdate, 'yyyyMMdd')", dn=TENANT.format(key="o_custkey"))

    def payment(self) -> DataFrame:
        return scan_columns(self.raw_payment(), "payment")

    def members(self) -> DataFrame:
        return member.member_wide(self.member(), self.regtype(), self.ad(), self.website(), self.payment(), self.vip())

    # exam area -------------------------------------------------------------------------------------
    def raw_exam(self) -> dict[str, DataFrame]:
        """The cleaned exam tables."""
        nation, region = per_tenant(self.t("nation")), per_tenant(self.t("region"))
        supplier, part = per_tenant(self.t("supplier")), per_tenant(self.t("part"))
        points = supplier.selectExpr("*", "explode(array(s_suppkey * 2, s_suppkey * 2 + 1)) AS point")
        sources = {
            "dwd_qz_chapter": (supplier, dict(
                chapterid="s_suppkey", chapterlistid="s_nationkey", chaptername="concat_ws('/', s_name, dn)",
                courseid="s_suppkey % 25", chapternum="2")),
            "dwd_qz_chapter_list": (nation, dict(
                chapterlistid="n_nationkey", chapterlistname="n_name", chapterallnum="n_regionkey")),
            "dwd_qz_point": (points, dict(
                pointid="point", chapterid="s_suppkey", pointname="concat('P', point)", score="point % 10")),
            "dwd_qz_point_question": (part, dict(
                pointid="p_partkey", questionid="p_partkey", questype="p_size % 7")),
            "dwd_qz_site_course": (nation, dict(
                sitecourseid="n_nationkey", siteid="n_nationkey", courseid="n_regionkey",
                sitecoursename="concat_ws('/', n_name, dn)", sequence="n_nationkey")),
            "dwd_qz_course": (region, dict(courseid="r_regionkey", majorid="r_regionkey", coursename="r_name")),
            "dwd_qz_course_edusubject": (region, dict(
                courseeduid="r_regionkey + 100", edusubjectid="r_regionkey + 200", courseid="r_regionkey")),
            "dwd_qz_major": (nation, dict(
                majorid="n_nationkey", businessid="n_regionkey", siteid="n_nationkey",
                majorname="concat('M-', n_name)", shortname="concat('M', n_nationkey)")),
            "dwd_qz_website": (nation, dict(
                siteid="n_nationkey", sitename="concat_ws('.', n_name, dn)", domain="dn")),
            "dwd_qz_business": (region, dict(businessid="r_regionkey", businessname="r_name")),
            "dwd_qz_paper_view": (supplier, dict(
                paperviewid="s_suppkey", paperid="s_nationkey", paperviewname="concat_ws('#', s_name, dn)")),
            "dwd_qz_center_paper": (supplier, dict(
                paperviewid="s_suppkey * 2", centerid="s_nationkey", sequence="s_suppkey")),
            "dwd_qz_center": (nation, dict(centerid="n_nationkey", centername="n_name")),
            "dwd_qz_paper": (nation, dict(
                paperid="n_nationkey + 1", papername="concat('paper-', n_name)", totalscore="100")),
            "dwd_qz_question": (part, dict(
                questionid="p_partkey", questypeid="p_size % 7", content="p_name", score="p_size",
                answer="p_brand")),
            "dwd_qz_question_type": (region, dict(
                questypeid="r_regionkey", viewtypename="r_name", description="concat('about ', r_name)")),
            "dwd_qz_member_paper_question": (self.t("lineitem"), dict(
                userid="l_orderkey", paperviewid="l_suppkey", chapterid="l_suppkey", sitecourseid="l_partkey % 30",
                questionid="l_partkey", majorid="l_suppkey % 25", useranswer="l_linestatus",
                spendtime="l_linenumber * 10", score=SCORE,
                question_answer="CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 0 ELSE 2 END",
                dn=TENANT.format(key="l_orderkey"))),
        }
        return {table: as_table(df, table, **columns) for table, (df, columns) in sources.items()}

    def exam_scans(self, *names: str) -> list[DataFrame]:
        if not self._exam:
            self._exam = self.raw_exam()
        return [scan_columns(self._exam[SCANS[name][0]], name) for name in names]

    def chapter_dim(self) -> DataFrame:
        return exam.chapter_dim(*self.exam_scans("chapter", "chapter_list", "point", "point_question"))

    def course_dim(self) -> DataFrame:
        return exam.course_dim(*self.exam_scans("site_course", "course", "edusubject"))

    def major_dim(self) -> DataFrame:
        return exam.major_dim(*self.exam_scans("major", "exam_website", "business"))

    def paper_dim(self) -> DataFrame:
        return exam.paper_dim(*self.exam_scans("paper_view", "center_paper", "center", "paper"))

    def question_dim(self) -> DataFrame:
        return exam.question_dim(*self.exam_scans("question", "question_type"))

    def answer_parts(self) -> list[DataFrame]:
        """Answers and the five dimensions, as the wide-table jobs take them: the dimensions are stored tables, of known size."""
        return [*self.exam_scans("answer"), *[materialize(scan_columns(getattr(self, name)(), name), name) for name in (
            "chapter_dim", "course_dim", "major_dim", "paper_dim", "question_dim")]]

    def answers_wide(self) -> DataFrame:
        return exam.answer_wide(*self.answer_parts())

    def answers(self) -> DataFrame:
        return exam.answer_grain(*self.answer_parts())

    # stream logs -----------------------------------------------------------------------------------
    def events(self) -> DataFrame:
        """Events with a numeric type code and the number inside ``props``."""
        kind = F.array_position(F.array(*[F.lit(e) for e in EVENT_TYPES]), c("event_type")).cast("int")
        return (self.t("events").withColumn("ts", c("ts").cast("timestamp")).withColumn("code", kind)
                .withColumn("k", F.get_json_object("props", "$.k").cast("int")))

    def register_lines(self) -> DataFrame:
        stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return self.events().select(F.concat_ws("\t", text("event_id"), text("code"), stamp).alias("value"))

    def question_lines(self, *keep: str) -> DataFrame:
        return self.events().select(*keep, F.concat_ws(
            "\t", text("user_id"), text("code"), (c("k") % 10).cast("string"), text("k"),
            F.when(c("value") > 100, "1").otherwise("0"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("value"))

    def page_lines(self) -> DataFrame:
        first = (c("user_id") * 37 + c("k")) % 28
        ip = F.concat_ws(".", first.cast("string"), (c("event_id") % 256).cast("string"),
                         (c("k") * 7 % 256).cast("string"), (c("event_id") % 251).cast("string"))
        return self.events().select(F.to_json(F.struct(
            text("user_id").alias("uid"), F.lit("1").alias("app_id"), ip.alias("ip"),
            (c("k") % 4).cast("string").alias("last_page_id"), text("code").alias("page_id"),
            F.when(c("k") % 5 > 0, (c("k") % 5).cast("string")).alias("next_page_id"))).alias("value"))

    def learn_lines(self) -> DataFrame:
        begin = F.unix_millis("ts")
        wall = (c("value").cast("decimal(12,2)") * 1000).cast("bigint")
        return self.events().select(F.to_json(F.struct(
            text("user_id").alias("uid"), c("code").alias("cwareid"), (c("k") % 10).alias("videoid"),
            (c("k") % 7).alias("chapterid"), (c("k") % 3).alias("edutypeid"), (c("k") % 11).alias("subjectid"),
            c("event_type").alias("sourceType"), F.lit(1).alias("speed"), begin.alias("ts"),
            (begin + wall).alias("te"), c("k").alias("ps"), (c("k") - 1 + c("event_id") % 20).alias("pe")))
            .alias("value"))

    def ip_ranges(self) -> DataFrame:
        base = c("n_nationkey").cast("bigint") * 16777216
        return self.t("nation").select(
            (base + 1000).alias("start_ip"), (base + 16777216 - 500000).alias("end_ip"),
            F.concat_ws("|", F.lit("C"), F.lit("0"), c("n_name"), F.lit("city"), F.lit("isp")).alias("region"))


def land_logs(tables: dict[str, DataFrame], folder: str) -> None:
    """The rows of cleaned tables as the raw JSON logs that they are loaded from, packed; missing values are left out of a line."""
    for table, rows in tables.items():
        spec = LOGS[table]
        rows.select(F.to_json(F.struct(*[F.col(f.name).cast("string").alias(f.keys[0]) for f in spec.fields if f.name in rows.columns]))
                    .alias("value")).write.text(f"{folder}/{spec.file}", compression="gzip")
