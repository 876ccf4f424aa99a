"""Query of the mixing operator; its selection has no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import load
from lectern.llm.mixing import mix


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(load(spark, sf_dir, "documents"))
    return mixed.select("_carry.doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"), "copies")


QUERIES = {"op6_mixing": op6_mixing}
SQL: dict[str, str] = {}
