"""Query of the language identification; tested by its accuracy on documents it didn't learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import load
from lectern.llm.language import predict, train

FOLDS = 5


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    held_out = F.pmod(F.crc32(name), F.lit(FOLDS)) == 0
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), model, carry=["doc_id", held_out.alias("held_out")]).select(
        "_carry.doc_id", "_carry.held_out", "lang_pred", "score",
        F.array_join(F.transform("languages", lambda x: x["lang"]), ",").alias("languages"))


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
