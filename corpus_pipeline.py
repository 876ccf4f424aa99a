"""A corpus pipeline of five stages: from raw documents to a clean, mixed and sharded corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``docs``; the last one adds where a document goes.
The caller writes each stage's rows as Parquet and hands them to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import load, materialize
from lectern.llm.contamination import keep_clean
from lectern.llm.jaccard import keep_representatives
from lectern.llm.mixing import mixed
from lectern.llm.quality import keep_good
from lectern.llm.sharding import with_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the verdicts on their hosts keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return keep_representatives(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return keep_clean(docs, load(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights; a document taken twice is two rows."""
    return mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``shard`` and ``slot``."""
    return with_shards(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination),
          ("source mix", source_mix), ("shards", shards)]

#: The mix and the shards have no SQL form; the stages are tested one by one and together against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{number + 1}")
    return docs
