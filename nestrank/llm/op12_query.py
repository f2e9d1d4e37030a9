"""Query of the conversation trie over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestrank.llm.op12_trie import conversation_trie

NAME = "op12_prefix_trie"

# CRC-32 by its definition, a bit at a time over the digits of the id; only its two low bits are used.
SQL = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, step, v) AS (
  SELECT conv_id, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT conv_id, step + 1, xor(w >> 1, CASE WHEN w & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (
    SELECT conv_id, step, CASE WHEN step % 8 = 0
      THEN xor(v, ascii(substr(conv_id::VARCHAR, (step // 8 + 1)::INT, 1))::BIGINT) ELSE v END AS w
    FROM crc WHERE step < 8 * length(conv_id::VARCHAR)
  )
), heads AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(v, 4294967295) % 4 AS h FROM crc WHERE step = 8 * length(conv_id::VARCHAR)
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations
), parts AS (
  SELECT g.conv_id, 0 AS own, i, role, text FROM heads g JOIN t ON t.conv_id = base AND i <= h
  UNION ALL SELECT g.conv_id, 1, i, role, text FROM heads g JOIN t ON t.conv_id = g.conv_id AND i > h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS path,
    len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '')) AS words
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)
), steps AS (
  SELECT conv_id, depth, path, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up, words FROM paths
  UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM ids
), lasts AS (SELECT conv_id, max(depth) AS depth FROM steps GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(up) AS up, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
    any_value(words) AS words FROM steps GROUP BY path
), fan AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT a.path, count(*) FILTER (fan.path IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM nodes n JOIN steps a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN fan ON fan.path = n.path GROUP BY a.path
), ends AS (
  SELECT path, string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id) AS ids
  FROM steps s JOIN lasts l ON l.conv_id = s.conv_id AND l.depth = s.depth GROUP BY path
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.path = n.up LEFT JOIN fan ON fan.path = n.path
  JOIN below b ON b.path = n.path LEFT JOIN ends e ON e.path = n.path
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
