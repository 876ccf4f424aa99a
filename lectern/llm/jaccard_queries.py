"""Query of the n-gram Jaccard join and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import load
from lectern.llm.jaccard import jaccard_components
from lectern.llm.set_join_sql import jaccard_sql


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
SQL = {"op10_jaccard_join": jaccard_sql(4, 85, "doc_id, n::BIGINT AS n_shingles, component AS component_id")}
