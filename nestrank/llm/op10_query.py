"""Query of the near-dedup operator over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestrank.llm.op10_setsketch import components

NAME = "op10_near_dedup"

SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT shingle, row_number() OVER () AS kid FROM s GROUP BY shingle HAVING count(*) > 1),
o AS (SELECT doc_id, kid FROM s JOIN k USING (shingle)),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM o x JOIN o y ON x.kid = y.kid AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a
)
SELECT doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
