"""Query of the line dedup operator over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestrank.llm.op11_lines import line_digests

NAME = "op11_line_dedup"

SQL = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM s),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (SELECT k.doc_id, pos, line, keeper IS NOT NULL AND k.doc_id <> keeper AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
