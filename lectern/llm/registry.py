"""All queries of the training-data operators, and the pipeline over them."""

from __future__ import annotations

import corpus_pipeline
from lectern.llm import (chat_queries, contamination_queries, divergence_queries, hamming_queries, html_queries, jaccard_queries,
                         language_queries, lines_queries, mixing_queries, periods_queries, quality_queries, scoring_queries, sharding_queries)

MODULES = (quality_queries, sharding_queries, contamination_queries, lines_queries, chat_queries, mixing_queries,
           scoring_queries, language_queries, html_queries, jaccard_queries, periods_queries, divergence_queries,
           hamming_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()} | {
    "pipeline": corpus_pipeline.run}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
