"""The query that compares vectors."""

from __future__ import annotations

from tunelake.llm import embedding_dedup
from tunelake.llm.registry import query, table

NEAR_VECTORS_SQL = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {embedding_dedup.COSINE}),
walked AS (
  SELECT vec_id, vec_id AS reached FROM embeddings
  UNION SELECT walked.vec_id, links.b FROM walked JOIN links ON links.a = walked.reached),
lowest AS (SELECT vec_id, min(reached) AS component_id FROM walked GROUP BY vec_id),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN lowest USING (vec_id) LEFT JOIN counted USING (vec_id)
"""


@query("op11_embedding_dedup", NEAR_VECTORS_SQL)
def near_vectors(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))
