"""Query of the phrase collocations over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestrank.llm.op13_phrases import collocations

NAME = "op13_collocations"

SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p
), t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS size)
), f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY lang, size, phrase HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
i AS (
  SELECT lang, unnest(list_transform(range(1, size - s + 2), lambda i: array_to_string(ws[i:i + s - 1], ' '))) AS phrase, a
  FROM c, (SELECT unnest([2, 3]) AS s) WHERE s < size
), m AS (SELECT lang, phrase, max(a) AS most FROM i GROUP BY lang, phrase),
o AS (SELECT c.* FROM c LEFT JOIN m USING (lang, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT),
k AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lw, array_to_string(ws[k + 1:], ' ') AS rw
  FROM o, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size
), s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, ((2000000::HUGEINT * k.a) // (x.a + y.a))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = lw JOIN f y ON y.lang = k.lang AND y.phrase = rw
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM s),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE pick = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= 2000
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
