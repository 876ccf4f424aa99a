"""Query of the HTML extraction; tested on pages of known articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import load
from lectern.llm.html import extract


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages")).select(
        "_carry.page_id", "_carry.url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
SQL: dict[str, str] = {}
