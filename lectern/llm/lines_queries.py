"""Query of the line deduplication; tested against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import load
from lectern.llm.lines import dedup_lines


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(load(spark, sf_dir, "documents")).select(
        "_carry.doc_id", "n_lines", "n_removed", "removed_words", "runs", "word_runs", F.length("text").alias("n_chars_left"), "text")


QUERIES = {"op4_line_dedup": op4_line_dedup}
SQL: dict[str, str] = {}
