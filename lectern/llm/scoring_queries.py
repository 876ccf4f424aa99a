"""Query of the language-model scoring; tested against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import load, materialize, small_side
from lectern.llm.scoring import score


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the model of those labelled good and not toxic."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    good = load(spark, sf_dir, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()
    good = small_side(materialize(good, "good-labels")).withColumn("is_target", F.lit(True))
    return score(docs.join(good, "doc_id", "left"))


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
SQL: dict[str, str] = {}
