"""Rating queries over the events and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunelake.operators import feedback as ops
from tunelake.plans.inputs import MESSAGES, RATINGS, id_sql, messages, ratings, table
from tunelake.plans.registry import query


def thumbs(spark, sf_dir):
    """Thumbs on documents: quality decides, and a toxic document is later marked down."""
    labels = table(spark, sf_dir, "labels")
    first = labels.select(
        "doc_id", F.when(F.col("quality") == 1, F.lit("up")).otherwise(F.lit("down")).alias("direction"),
        F.lit(1).alias("ts"),
    )
    later = labels.where("toxic = 1").select("doc_id", F.lit("down").alias("direction"), F.lit(2).alias("ts"))
    return first.unionByName(later).select(
        F.col("doc_id").alias("message_id"), "direction", ops.thumb_score(F.col("direction")).alias("score"), "ts"
    )


THUMBS = """
thumbs AS (
  SELECT doc_id AS message_id, CASE quality WHEN 1 THEN 'up' ELSE 'down' END AS direction,
         CASE quality WHEN 1 THEN 10 ELSE 2 END AS score, 1 AS ts FROM labels
  UNION ALL SELECT doc_id, 'down', 2, 2 FROM labels WHERE toxic = 1)
"""


@query("rating_scores", f"WITH {THUMBS} SELECT message_id, direction, score, ts FROM thumbs")
def rating_scores(spark, sf_dir):
    return thumbs(spark, sf_dir)


@query("rating_capture", f"""WITH {RATINGS}
SELECT {id_sql("2", "message_id", "prompt", "response")} AS example_id, 2::BIGINT AS batch_id, message_id,
       prompt, response, score::DOUBLE AS score, 'human_feedback' AS source
FROM (SELECT * FROM ratings WHERE score >= 7 AND prompt <> '' AND response <> ''
      QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ts, score) = 1)""")
def rating_capture(spark, sf_dir):
    return ops.rating_capture(ratings(spark, sf_dir), 2)


def reply_thumbs(spark, sf_dir):
    """Thumbs on replies; every third reply gets none, every fourth a second one."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant' AND (conv_id + turn) % 3 > 0")
    thumb = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.lit("down")).otherwise(F.lit("up"))
    first = turns.select("conv_id", "turn", thumb.alias("direction"), F.lit(1).alias("ts"))
    return first.unionByName(first.where("turn % 4 = 1").withColumn("ts", F.lit(2)))


@query("reply_capture", f"""WITH {MESSAGES},
rated AS (
  SELECT to_json([conv_id, turn])::VARCHAR AS message_id, prompt, shown AS response FROM pairs
  WHERE (conv_id + turn) % 3 > 0 AND (conv_id + turn) % 5 > 0 AND prompt <> '' AND shown <> '')
SELECT {id_sql("3", "message_id", "prompt", "response")} AS example_id, 3::BIGINT AS batch_id, message_id, prompt,
       response, 10.0::DOUBLE AS score, 'human_feedback' AS source FROM rated""")
def reply_capture(spark, sf_dir):
    return ops.capture_replies(messages(spark, sf_dir), reply_thumbs(spark, sf_dir), 3)


@query("feedback_log", f"WITH {RATINGS} SELECT message_id AS id, score, ts FROM ratings")
def feedback_log(spark, sf_dir):
    return ops.feedback_log(ratings(spark, sf_dir))


@query("feedback_summary", f"""WITH {RATINGS}
SELECT ts::DATE AS day, count(*) AS ratings, round(avg(score), 6) AS mean_score,
       round(avg(CASE WHEN score >= 7 THEN 1.0 ELSE 0.0 END), 6) AS good_share
FROM ratings GROUP BY ALL""")
def feedback_summary(spark, sf_dir):
    return ops.feedback_summary(ops.feedback_log(ratings(spark, sf_dir)))


@query("feedback_rollup", f"""WITH {RATINGS}
SELECT ts::DATE AS day, score, grouping(ts::DATE, score)::BIGINT AS level, count(*) AS ratings
FROM ratings GROUP BY ROLLUP (ts::DATE, score)""")
def feedback_rollup(spark, sf_dir):
    return ops.feedback_rollup(ops.feedback_log(ratings(spark, sf_dir)))


@query("latest_rating", f"""WITH {RATINGS}
SELECT message_id, score, ts FROM ratings
QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ts DESC, score DESC) = 1""")
def latest_rating(spark, sf_dir):
    return ops.latest_rating(ratings(spark, sf_dir))


@query("rated_messages", f"""WITH {THUMBS}
SELECT doc_id AS message_id, lang, rating FROM documents LEFT JOIN (
  SELECT message_id, arg_max(score, ts) AS rating FROM thumbs GROUP BY message_id) ON doc_id = message_id""")
def rated_messages(spark, sf_dir):
    messages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), "lang")
    return ops.rated_messages(messages, thumbs(spark, sf_dir))


@query("compare_adapter", """
WITH scored AS (
  SELECT doc_id // 2 AS prompt_id, max(score) FILTER (doc_id % 2 = 1) AS adapter,
         max(score) FILTER (doc_id % 2 = 0) AS base
  FROM (SELECT doc_id, quality * 8 + 2 - toxic AS score FROM labels JOIN documents USING (doc_id)) GROUP BY ALL)
SELECT count(*) AS prompts, round(avg(adapter), 6) AS adapter_mean, round(avg(base), 6) AS base_mean,
       count(*) FILTER (adapter > base) AS wins, count(*) FILTER (adapter = base) AS ties,
       count(*) FILTER (adapter < base) AS losses
FROM scored WHERE adapter IS NOT NULL AND base IS NOT NULL""")
def compare_adapter(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    scored = table(spark, sf_dir, "labels").join(documents, "doc_id").select(
        F.expr("doc_id div 2").alias("prompt_id"),
        F.when(F.col("doc_id") % 2 == 1, F.lit("adapter")).otherwise(F.lit("base")).alias("variant"),
        (F.col("quality") * 8 + 2 - F.col("toxic")).alias("score"),
    )
    return ops.compare_variants(scored)
