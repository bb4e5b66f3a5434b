"""Decode and adapter queries over events and embeddings."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tunelake.operators import adapter as adapters
from tunelake.operators import decode, runs
from tunelake.plans.inputs import POLICY, candidates, table
from tunelake.plans.registry import query
from tunelake.session import shared_dir

INPUTS, CLASSES = 64, 10


@query("decode_params", """
SELECT event_id,
  least(2, greatest(0.1, value / 100))::DOUBLE AS temperature,
  least(1, greatest(0.1, CASE WHEN event_id % 3 > 0 THEN value / 50 ELSE 0.9 END))::DOUBLE AS top_p,
  least(8192, greatest(1, event_id))::INTEGER AS max_new_tokens,
  least(200, greatest(0, CASE WHEN event_id % 4 > 0 THEN user_id ELSE 50 END))::INTEGER AS top_k,
  1.1::DOUBLE AS repetition_penalty,
  least(512, greatest(0, user_id - 20))::INTEGER AS min_new_tokens,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE least(8192, greatest(1, coalesce(nullif(user_id, 0), 1))) END::INTEGER AS typed
FROM events""")
def decode_params(spark, sf_dir):
    updates = table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("value") / 100).alias("temperature"),
        F.when(F.col("event_id") % 3 > 0, F.col("value") / 50).alias("top_p"),
        F.col("event_id").cast("int").alias("max_new_tokens"),
        F.when(F.col("event_id") % 4 > 0, F.col("user_id")).cast("int").alias("top_k"),
        F.lit(None).cast("double").alias("repetition_penalty"),
        (F.col("user_id") - 20).cast("int").alias("min_new_tokens"),
        F.when(F.col("event_id") % 2 == 0, F.lit("many")).otherwise(F.concat("user_id", F.lit(" tokens"))).alias("typed"),
    )
    typed = decode.params.parsed_integer("max_new_tokens", F.col("typed"))
    return decode.decode_params(updates).withColumn("typed", typed)


@query("decode_policy", f"""WITH {POLICY}
SELECT request_id, candidate, rank, round(probability, 6) AS probability, round(cumulative, 6) AS cumulative
FROM policy""")
def decode_policy(spark, sf_dir):
    rows = decode.decode_policy(candidates(spark, sf_dir))
    return rows.withColumns({name: F.round(name, 6) for name in ("probability", "cumulative")})


@query("decode_sample", f"""WITH {POLICY}
SELECT request_id, arg_min(candidate, rank) AS candidate FROM policy
WHERE round(cumulative, 9) > ('0x' || substr(md5('11:' || request_id), 1, 8))::BIGINT / 4294967296
GROUP BY request_id""")
def decode_sample(spark, sf_dir):
    return decode.decode_sample(decode.decode_policy(candidates(spark, sf_dir)), seed=11)


def features(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def formula_adapter() -> adapters.Adapter:
    """Weights given by a formula, so that SQL can state them too."""
    i, j = np.arange(8)[:, None], np.arange(INPUTS)[None, :]
    c, k = np.arange(CLASSES)[:, None], np.arange(8)[None, :]
    return adapters.Adapter(((i * 31 + j * 17) % 13 - 6) / 100, ((c * 7 + k * 5) % 11 - 5) / 100)


SCORES = """
flat AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
base AS (SELECT label AS c, j, avg(x) AS w FROM flat GROUP BY ALL),
plain AS (SELECT vec_id, c, sum(w * x) AS logit FROM flat JOIN base USING (j) GROUP BY ALL),
hidden AS (
  SELECT vec_id, k, sum(((k * 31 + j * 17) % 13 - 6) / 100 * x) AS h
  FROM flat, (SELECT unnest(range(8)) AS k) GROUP BY ALL),
added AS (
  SELECT vec_id, c, sum(4 * ((c * 7 + k * 5) % 11 - 5) / 100 * h) AS delta
  FROM hidden, (SELECT unnest(range(10)) AS c) GROUP BY ALL)
"""


def scored(spark, sf_dir, adapter):
    rows = features(spark, sf_dir)
    base = adapters.class_centroids(rows, INPUTS, CLASSES)
    scores = adapters.score_features(rows, base, adapter)
    return scores.select("id", F.round(F.array_max("logits"), 6).alias("logit"), "predicted")


@query("base_score", f"""WITH {SCORES}
SELECT vec_id AS id, round(max(logit), 6) AS logit, arg_max(c, logit)::INTEGER AS predicted FROM plain GROUP BY vec_id""")
def base_score(spark, sf_dir):
    """Without an adapter, as after its removal."""
    return scored(spark, sf_dir, None)


@query("adapter_score", f"""WITH {SCORES}
SELECT vec_id AS id, round(max(logit + delta), 6) AS logit, arg_max(c, logit + delta)::INTEGER AS predicted
FROM plain JOIN added USING (vec_id, c) GROUP BY vec_id""")
def adapter_score(spark, sf_dir):
    return scored(spark, sf_dir, formula_adapter())


@query("adapter_fit")
def adapter_fit(spark, sf_dir):
    """Fit, save per epoch, and fold the run's own log to its metrics."""
    rows = features(spark, sf_dir)
    base = adapters.class_centroids(rows, INPUTS, CLASSES)
    root = f"{shared_dir(spark)}/adapters-{uuid.uuid4().hex}"
    fit = adapters.fit_adapter(
        rows, base, steps_per_epoch=4,
        on_epoch=lambda epoch, adapter: adapters.save_adapter(spark, root, "org--base", "fitted", epoch, adapter),
    )
    logs = adapters.fit_log_lines(spark, fit, "fitted")
    saved = spark.read.parquet(root).groupBy().agg(F.count("*").alias("matrix_rows"), F.max("epoch").alias("epochs"))
    metrics = runs.run_metrics(runs.parse_log(logs))
    return metrics.withColumns({
        "matrix_rows": saved.select("matrix_rows").scalar(), "epochs": saved.select("epochs").scalar()
    })


@query("adapter_accuracy")
def adapter_accuracy(spark, sf_dir):
    """Correct predictions of the base and of a fitted adapter on the same rows."""
    rows = features(spark, sf_dir)
    base = adapters.class_centroids(rows, INPUTS, CLASSES)
    fit = adapters.fit_adapter(rows, base, steps_per_epoch=4)
    both = adapters.score_features(rows, base).withColumnRenamed("predicted", "base").drop("logits")
    both = adapters.score_features(both, base, fit.adapter)
    return both.agg(
        F.count("*").alias("n"), F.count_if(F.col("base") == F.col("label")).alias("base_correct"),
        F.count_if(F.col("predicted") == F.col("label")).alias("adapter_correct"),
    )
