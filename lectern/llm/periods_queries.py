"""Query of the periodic runs and its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.llm.common import bind, load, white_words
from lectern.llm.periods import COPIES, LEAST, periodic_runs


def planted(text: Column, doc_id: Column) -> Column:
    """The text, in which one document of ten repeats a stretch up to its end; the id decides where and how often."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")

        def from_start(a: Column) -> Column:
            p = F.floor((n - a) / (3 + g % 8)) + 1
            places = F.sequence(F.lit(0).cast("long"), n - 1)
            return F.array_join(F.transform(places, lambda i: F.element_at(
                words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))), " ")

        return F.when(n > 0, bind(g % n, from_start))

    return F.when(h % 10 == 0, F.coalesce(bind(white_words(text), repeat), text)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.col("runs")[0], lambda kept, r: F.when(
        r["length"] * kept["period"] > kept["length"] * r["period"], r).otherwise(kept))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "_carry.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# CRC-32 of a short ASCII text, bit by bit. Candidate lags are those of neighbouring equal grams of 2, 4, 8... words; each is then
# compared over the whole text.
OP11 = f"""
WITH RECURSIVE
t AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]),
      lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1))))) AS h
  FROM documents),
s AS (SELECT d, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS yes, h // 10 AS g,
             (h // 10) % greatest(len(w), 1) AS a FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM s),
l AS MATERIALIZED (SELECT d, doc_id, n, CASE WHEN yes THEN
    [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] for i in range(n)] ELSE w END AS w FROM p),
x AS MATERIALIZED (SELECT d, n, unnest(w) AS x, unnest(range(n)) AS i FROM l),
grams(k, d, n, i, h) AS (
  SELECT 0, d, n, i, hash(x) FROM x
  UNION ALL
  SELECT k + 1, d, n, i, hash(h, h2) FROM (
    SELECT k, d, n, i, h, lead(h, (1 << k)::BIGINT) OVER (PARTITION BY d ORDER BY i) AS h2 FROM grams)
  WHERE h2 IS NOT NULL AND n >= 4 * (1 << k)),
lags AS (
  SELECT DISTINCT d, q FROM (
    SELECT k, d, lead(i) OVER (PARTITION BY k, d, h ORDER BY i) - i AS q FROM grams WHERE k > 0)
  WHERE q >= 1 << (k - 1) AND q < 1 << k),
same AS (
  SELECT x.d, q, x.i, x.i - row_number() OVER (PARTITION BY x.d, q ORDER BY x.i) AS island
  FROM lags JOIN x ON x.d = lags.d JOIN x AS y ON y.d = x.d AND y.i = x.i + q AND y.x = x.x),
stretches AS (
  SELECT d, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY d, q, island
  HAVING count(*) + q >= greatest({LEAST}, {COPIES} * q)),
runs AS MATERIALIZED (SELECT d, start, length, min(q) AS q FROM stretches GROUP BY d, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY d ORDER BY length::DOUBLE / q DESC, start, q) = 1),
listed AS (SELECT d, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs
           FROM runs GROUP BY d),
gone AS (SELECT DISTINCT d, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT x.d, string_agg(x, ' ' ORDER BY x.i) AS text FROM x ANTI JOIN gone ON x.d = gone.d AND x.i = gone.i GROUP BY x.d)
SELECT l.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length,
       best.q::BIGINT AS period, (1000 * best.length // best.q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed.runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM l LEFT JOIN best USING (d) LEFT JOIN listed USING (d) LEFT JOIN kept USING (d)"""

QUERIES = {"op11_periodic_runs": op11_periodic_runs}
SQL = {"op11_periodic_runs": OP11}
