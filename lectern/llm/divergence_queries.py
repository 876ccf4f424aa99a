"""Query of the source divergence and its SQL twin, which goes through all terms of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import LOWER, UPPER, load
from lectern.llm.divergence import SCALE, source_divergence


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(load(spark, sf_dir, "documents"))


def _share(count: str, total: str) -> str:
    return f"(1 + {SCALE}::HUGEINT * ({count} + 2) // ({total} + 2 * v))"


OP12 = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS MATERIALIZED (SELECT d, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
f AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN k USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n)::BIGINT AS n FROM f GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT f.lang, f.source, f.term, f.n, {_share('f.n', 's.n')} AS p, {_share('f.all_n', 'v.n')} AS q
  FROM f JOIN s USING (lang, source) JOIN v USING (lang)),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10"""

QUERIES = {"op12_source_divergence": op12_source_divergence}
SQL = {"op12_source_divergence": OP12}
