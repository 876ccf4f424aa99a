"""SQL of a Jaccard self-join of documents and of its components, as both set joins are checked against."""

from __future__ import annotations

from lectern.llm.common import LOWER, UPPER


def jaccard_sql(width: int, percent: int, columns: str) -> str:
    """All sets with equal texts apart from A-Z once, their pairs by common shingles, and the least id each can reach.

    ``columns`` is the select list over ``doc_id``, ``n`` (size of the set) and ``component``.
    """
    shingles = (f"CASE WHEN len(w) >= {width} THEN list_distinct([hash(array_to_string(w[i:i + {width - 1}], ' ')) "
                f"for i in range(1, len(w) - {width - 2})]) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END")
    return f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
d AS MATERIALIZED (SELECT doc_id, list_sort({shingles}) AS s FROM w),
c AS MATERIALIZED (SELECT s, len(s) AS n, min(doc_id) AS id, row_number() OVER () AS c FROM d WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT c, n, unnest(s) AS h FROM c),
common AS (
  SELECT x.c AS a, y.c AS b, x.n AS n, y.n AS m, count(*) AS k FROM e AS x JOIN e AS y ON x.h = y.h AND x.c < y.c
  WHERE 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * k >= {percent} * (n + m - k)),
ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
least_id AS (SELECT reach.a AS c, min(c.id) AS component FROM reach JOIN c ON c.c = reach.b GROUP BY reach.a),
found AS (SELECT d.doc_id, len(d.s) AS n, coalesce(component, d.doc_id) AS component
          FROM d LEFT JOIN c ON c.s = d.s LEFT JOIN least_id ON least_id.c = c.c)
SELECT {columns} FROM found"""
