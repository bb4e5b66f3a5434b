"""Training-run queries over log lines made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunelake.operators import runs as ops
from tunelake.operators.curation import dataset_summary
from tunelake.plans.inputs import LINES, LOGS, examples, log_lines, run_exits, table
from tunelake.plans.registry import query
from tunelake.sources.logs import log_line


def parsed(spark, sf_dir):
    return ops.parse_log(log_lines(spark, sf_dir))


def rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


@query("training_log_parse", f"""WITH {LOGS}
SELECT run_id, seq, kind, round(loss, 6) AS loss, epoch, status, error FROM parsed""")
def training_log_parse(spark, sf_dir):
    return rounded(parsed(spark, sf_dir), "loss").drop("line")


@query("training_log_emit", f"""WITH {LOGS}
SELECT run_id, seq, round(loss, 6) AS loss, epoch FROM parsed WHERE loss IS NOT NULL""")
def training_log_emit(spark, sf_dir):
    """Metrics written as marked lines and read back."""
    metrics = parsed(spark, sf_dir).where("loss IS NOT NULL")
    lines = metrics.select("run_id", "seq", log_line(F.struct("loss", "epoch")).alias("line"))
    return rounded(ops.parse_log(lines).select("run_id", "seq", "loss", "epoch"), "loss")


@query("run_metrics", f"WITH {LOGS} SELECT * FROM metrics")
def run_metrics(spark, sf_dir):
    return rounded(ops.run_metrics(parsed(spark, sf_dir)), "loss", "perplexity", "progress")


@query("run_status", f"""WITH {LOGS},
exits AS (SELECT DISTINCT 'run-' || user_id AS run_id, (user_id % 3 * 7)::INTEGER AS exit_code FROM events
          WHERE user_id % 3 < 2)
SELECT run_id, exit_code, loss, step,
  CASE WHEN exit_code = 0 THEN 'Complete' WHEN exit_code > 0 THEN 'Failed' ELSE status END AS status,
  CASE WHEN exit_code = 0 THEN 100 ELSE progress END AS progress,
  CASE WHEN exit_code > 0 AND error = '' THEN 'Training process exited with code ' || exit_code ELSE error END AS error,
  CASE WHEN run_id LIKE '%5' THEN NULL ELSE 'org/' || run_id END AS model,
  CASE WHEN run_id LIKE '%5' THEN NULL ELSE 'adapter' END AS adapter
FROM metrics LEFT JOIN exits USING (run_id)""")
def run_status(spark, sf_dir):
    metrics = ops.run_metrics(parsed(spark, sf_dir))
    started = metrics.where(~F.col("run_id").endswith("5")).select(
        "run_id", F.concat(F.lit("org/"), "run_id").alias("model"), F.lit("adapter").alias("adapter")
    )
    rows = ops.run_status(metrics, run_exits(spark, sf_dir), started)
    return rounded(rows, "loss", "progress").select(
        "run_id", "exit_code", "loss", "step", "status", "progress", "error", "model", "adapter"
    )


@query("loss_history", f"""WITH {LOGS},
points AS (
  SELECT run_id, loss, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM parsed WHERE loss IS NOT NULL)
SELECT run_id, (i - 1) // 16 AS block, string_agg(printf('%.4f', loss), ' ' ORDER BY i) AS losses
FROM points GROUP BY run_id, (i - 1) // 16""")
def loss_history(spark, sf_dir):
    rows = ops.loss_history(parsed(spark, sf_dir), log_lines(spark, sf_dir), block=16)
    text = F.array_join(F.transform("losses", lambda v: F.format_string("%.4f", v)), " ")
    return rows.select("run_id", "block", text.alias("losses"))


@query("loss_curve_summary", f"""WITH {LOGS}
SELECT run_id, count(*) AS n, round(arg_min(loss, seq), 6) AS first, round(arg_max(loss, seq), 6) AS last,
  round(min(loss), 6) AS min, round(max(loss), 6) AS max,
  round(coalesce(nullif(max(loss) - min(loss), 0), 1), 6) AS span
FROM parsed WHERE loss IS NOT NULL GROUP BY run_id HAVING count(*) >= 2""")
def loss_curve_summary(spark, sf_dir):
    return rounded(ops.loss_curve_summary(parsed(spark, sf_dir)), "first", "last", "min", "max", "span")


@query("loss_curve_points", f"""WITH {LOGS},
points AS (
  SELECT run_id, loss, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i, count(*) OVER r AS n,
         min(loss) OVER r AS low, max(loss) OVER r AS high
  FROM parsed WHERE loss IS NOT NULL WINDOW r AS (PARTITION BY run_id))
SELECT run_id, i, round((i - 1) / (n - 1), 6) AS x, round((loss - low) / coalesce(nullif(high - low, 0), 1), 6) AS y
FROM points WHERE n >= 2""")
def loss_curve_points(spark, sf_dir):
    return rounded(ops.loss_curve_points(parsed(spark, sf_dir), log_lines(spark, sf_dir)), "x", "y")


def planned_runs(spark, sf_dir):
    """A planned run per customer: models asked for or loaded, adapter names good and bad."""
    key = F.col("c_custkey")
    eligible = dataset_summary(examples(spark, sf_dir)).select("eligible")
    plans = table(spark, sf_dir, "customer").select(
        key.alias("plan"),
        F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("org/"), F.lower("c_mktsegment"))).alias("requested"),
        F.when(key % 2 == 0, F.lit("org/base")).alias("current"),
        F.when(key % 4 == 0, F.col("c_name")).otherwise(F.regexp_replace("c_name", "#", "_")).alias("adapter_name"),
        (key % 7 > 0).alias("online"), (key % 11 == 0).alias("is_training"),
    )
    return plans.withColumn("eligible", eligible.scalar())


PLANS = f"""{LINES},
plans AS (
  SELECT c_custkey AS plan, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'org/' || lower(c_mktsegment) END AS requested,
    CASE WHEN c_custkey % 2 = 0 THEN 'org/base' END AS current,
    CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE replace(c_name, '#', '_') END AS adapter_name,
    c_custkey % 7 > 0 AS online, c_custkey % 11 = 0 AS is_training,
    (SELECT count(*) FILTER (usable) FROM listed) AS eligible
  FROM customer)
"""


@query("training_target", f"""WITH {PLANS}
SELECT plan, coalesce(nullif(requested, ''), current, 'stabilityai/stablelm-zephyr-3b') AS target FROM plans""")
def training_target(spark, sf_dir):
    return ops.training_target(planned_runs(spark, sf_dir)).select("plan", "target")


@query("run_blockers", f"""WITH {PLANS}
SELECT plan, concat_ws('|', CASE WHEN NOT online THEN 'The backend is offline.' END,
  CASE WHEN eligible = 0 THEN 'Add at least one example to the dataset.' END,
  CASE WHEN requested = '' AND current IS NULL THEN 'Choose a base model.' END,
  CASE WHEN plan % 4 = 0 THEN 'Use only letters, numbers, dashes and underscores in the adapter name.' END,
  CASE WHEN is_training THEN 'Already training' END) AS blockers FROM plans""")
def run_blockers(spark, sf_dir):
    model = ops.base_model(F.col("requested"), F.col("current"), F.lit(""))
    rows = ops.run_blockers(planned_runs(spark, sf_dir).withColumn("model", model))
    return rows.select("plan", F.array_join("blockers", "|").alias("blockers"))
