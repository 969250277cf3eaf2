"""Near-duplicate documents by sets of two-word shingles."""

from pyspark.sql import DataFrame, SparkSession

from kinescape.llm.minhash import near_duplicates

#: All pairs that share a shingle, and what links reach; doc_id is unique.
ORACLE = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM words
), sets AS (
  SELECT g.doc_id, g.g, s.n FROM grams g JOIN (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id) s USING (doc_id)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least m ON m.a = d.doc_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of the whole table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, threshold=80)
