"""Query of the quality rules and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import quality
from lectern.llm.common import load


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(load(spark, sf_dir, "documents"))
    return judged.selectExpr("_carry.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                             "base_failed", "kept", "failed_rules", "bad_rules")


def _sql(limit: float = 0.5) -> str:
    rules = [rule.replace("BD", "") for rule in quality.RULES.values()]
    failed = " + ".join(f"CASE WHEN {rule} THEN {1 << r} ELSE 0 END" for r, rule in enumerate(rules))
    counts = ", ".join(f"sum((failed >> {r}) & 1)::DOUBLE AS f{r}" for r in range(len(rules)))
    moments = ", ".join(f"sum(f{r}) / sum(n_docs) AS m{r}, sum(f{r} * f{r} / n_docs) AS q{r}" for r in range(len(rules)))
    within = ", ".join(
        f"CASE WHEN m{r} > 0 AND m{r} < 1 AND docs - squares / docs - (hosts - 1) > 0 THEN "
        f"((q{r} - docs * m{r} * m{r}) / (m{r} * (1 - m{r})) - (hosts - 1)) / (docs - squares / docs - (hosts - 1)) "
        f"ELSE 0 END AS c{r}" for r in range(len(rules)))
    bad = " + ".join(
        f"CASE WHEN CASE WHEN c{r} > 0 THEN (f{r} + m{r} * greatest(0, 1 / c{r} - 1)) / (n_docs + greatest(0, 1 / c{r} - 1)) "
        f"ELSE m{r} END > {limit} THEN {1 << r} ELSE 0 END" for r in range(len(rules)))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
windows AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) > 8)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1),
repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) r(k) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN repeated USING (rid)),
f AS (SELECT *, {failed} AS failed FROM m),
hosts AS (SELECT source, count(*) AS n_docs, {counts} FROM f GROUP BY source),
moments AS (SELECT count(*)::DOUBLE AS hosts, sum(n_docs)::DOUBLE AS docs, sum(n_docs::DOUBLE * n_docs) AS squares, {moments} FROM hosts),
prior AS (SELECT *, {within} FROM moments),
verdicts AS (SELECT source, {bad} AS bad_rules FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({quality.BASE_FAILED}) AS base_failed,
       NOT ({quality.BASE_FAILED}) AND (failed & bad_rules) = 0 AND bit_count(failed) < 2 AS kept,
       failed AS failed_rules, bad_rules
FROM f JOIN verdicts ON f.source IS NOT DISTINCT FROM verdicts.source"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL = {"op1_quality_rules": _sql()}
