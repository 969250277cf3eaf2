"""Links between embeddings of one label."""

from pyspark.sql import DataFrame, SparkSession

from kinescape.llm.pivots import near_vectors

#: All pairs of a label, and what links reach; vec_id is unique.
ORACLE = """WITH RECURSIVE made AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), able AS (
  SELECT vec_id, label, v, list_sum(list_transform(v, lambda x: x * x)) AS s FROM made
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.s > 0 AND b.s > 0 AND list_dot_product(a.v, b.v) / sqrt(a.s * b.s) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(m.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least m ON m.a = e.vec_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector of the whole table."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
