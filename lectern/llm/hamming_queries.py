"""Query of the near-duplicate search by signatures and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import load
from lectern.llm.hamming import near_duplicates
from lectern.llm.set_join_sql import jaccard_sql

#: Words of a shingle and per cent of similarity.
WIDTH, PERCENT = 3, 85


def op13_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), width=WIDTH, percent=PERCENT)


OP13 = jaccard_sql(WIDTH, PERCENT, "doc_id, n::BIGINT AS n_shingles, component AS component_id, doc_id = component AS kept")

QUERIES = {"op13_near_duplicates": op13_near_duplicates}
SQL = {"op13_near_duplicates": OP13}
