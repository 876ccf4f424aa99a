"""Running mastery per key, as a plain streaming aggregation: its state is the set of questions and three totals.

It emits full totals and not increments: a batch that runs again writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions import scalars as S

POINT_KEYS = ["uid", "courseid", "pointid"]
VIDEO_KEYS = ["uid", "cwareid", "videoid"]


def question_mastery_stream(answers: DataFrame, questions_per_point: int = S.QUESTIONS_PER_POINT) -> DataFrame:
    """Running mastery per user, course and point; the streaming twin of ``question_mastery``.

    The state of a key holds each question of the point once, so it is bounded by the questions of a point.
    """
    totals = answers.groupBy(*POINT_KEYS).agg(
        F.count(F.lit(1)).alias("qz_sum"), F.count_if(F.col("isright") == "1").alias("qz_istrue"),
        F.min("createtime").alias("createtime"), F.sort_array(F.collect_set("questionid")).alias("_questions"))
    counted = totals.withColumn("qz_count", F.size("_questions").cast("bigint"))
    return counted.select(
        *POINT_KEYS, "qz_sum", "qz_count", "qz_istrue",
        S.correct_rate(F.col("qz_istrue"), F.col("qz_sum")).alias("correct_rate"),
        S.mastery_rate(F.col("qz_count"), F.col("qz_istrue"), F.col("qz_sum"), questions_per_point)
        .alias("mastery_rate"),
        F.array_join(F.transform("_questions", lambda q: q.cast("string")), ",").alias("questionids"), "createtime")


def mastery_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``uid``, ``courseid``, ``pointid``, ``qz_sum``, ``qz_istrue``, ``createtime`` as the state of :func:`question_mastery_stream`
    holds them after the last batch, one row per key; filter the keys to look some up. No result table is read.
    """
    named = "struct<qz_sum:bigint,qz_istrue:bigint,createtime:string,questions:binary>"  # both counts are called alike there
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", F.col("value").cast(named).alias("v")).select(*POINT_KEYS, "v.qz_sum", "v.qz_istrue", "v.createtime")
