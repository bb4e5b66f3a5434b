"""Queries that store, scan and search token ids."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tunelake.llm import search, token_scan, token_store
from tunelake.llm.queries_format import tokenizer
from tunelake.llm.registry import query, table
from tunelake.session import shared_dir

ORDER_KEY = 20_240_601
END_ID = 50_256


@query("op8_token_shards")
def token_shards(spark, sf_dir):
    ranks, pattern = tokenizer(spark)
    index, path = token_store.materialise(
        table(spark, sf_dir, "documents"), ranks, pattern, order_key=ORDER_KEY, end_id=END_ID)
    files = spark.read.format("binaryFile").load(path).select(F.col("shard").cast("long"), "length")
    return index.join(files, "shard").select(
        "doc_id", "part", "slot", "shard", "byte_offset", "n_tokens", F.col("length").alias("shard_bytes"))


@query("op10_token_counts")
def token_counts(spark, sf_dir):
    ranks, pattern = tokenizer(spark)
    path = f"{shared_dir(spark)}/flat-tokens-{uuid.uuid4().hex}"
    token_scan.write_flat(table(spark, sf_dir, "documents"), ranks, pattern, path)
    number = [F.regexp_extract("file", pattern, 1).cast("int") for pattern in (r"part-(\d+)", r"-c(\d+)")]
    return token_scan.count_tokens(spark, path).select(
        number[0].alias("task"), number[1].alias("file"), "ordinal", "start", "n_tokens", "ended")


SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '(?:[0-9a-z]|[^\x00-\x7F])+')) AS word FROM documents),
counts AS (SELECT doc_id, word, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS length FROM words GROUP BY doc_id),
sizes AS (
  SELECT (SELECT count(*) FROM documents) AS n_docs,
         (SELECT count(*) FROM words) / (SELECT count(*) FROM documents) AS mean),
idfs AS (
  SELECT word, count(*) AS df, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM counts, sizes GROUP BY word, n_docs),
queries AS (
  SELECT query_id, word, idf FROM (
    SELECT doc_id AS query_id, word, idf,
           row_number() OVER (PARTITION BY doc_id ORDER BY round((1 + ln(tf)) * idf, 9) DESC, word) AS place
    FROM counts JOIN idfs USING (word) WHERE df >= 5 AND doc_id % 50 = 0)
  WHERE place <= 16),
scored AS (
  SELECT query_id, doc_id,
         round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM queries JOIN counts USING (word) JOIN lengths USING (doc_id), sizes GROUP BY query_id, doc_id),
ranked AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM scored)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op7_top_k", SEARCH_SQL)
def nearest_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, F.col("doc_id") % 50 == 0).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


WHOLE_TEXT_SQL = SEARCH_SQL.replace("WHERE df >= 5 AND doc_id % 50 = 0", "WHERE doc_id % 50 = 0").replace(
    "  WHERE place <= 16),", "),")


@query("op7_whole_text", WHOLE_TEXT_SQL)
def nearest_whole_texts(spark, sf_dir):
    """As above, with every word of a query document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, F.col("doc_id") % 50 == 0, max_terms=None, min_docs=1).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")
