"""Streaming queries: the shared tables are read as streams and run until nothing is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.plans.catalog import DEBOUNCED, QUIET_HOURS
from tunelake.plans.inputs import LINES, LOGS, RATINGS, example_lines, log_lines, polls, ratings, table
from tunelake.plans.registry import query
from tunelake.plans.runs import rounded
from tunelake.session import shared_dir
from tunelake.sources.jsonl import read_examples, read_quarantined
from tunelake.streaming import ingest, live


class _Streamed:
    """Stands in for a session so that the table derivations of ``inputs`` read streams."""

    def __init__(self, spark: SparkSession):
        self.read = _StreamReader(spark)


class _StreamReader:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def parquet(self, path: str) -> DataFrame:
        """The table's file, or all files of its folder. A stream reads the latter or a pattern, and a pattern of one
        name fits both; below the parent, folders such as ``day=1`` give columns as they do in a plain read."""
        folder, name = path.rsplit("/", 1)
        schema = self.spark.read.parquet(path).schema
        reader = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
        return reader.option("basePath", folder).parquet(f"{folder}/{{{name}}}")


def finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def to_table(spark: SparkSession, rows: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream to its end into files of the shared folder and reads them."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        finish(rows.writeStream.format("parquet").option("path", f"{root}/rows")
               .option("checkpointLocation", f"{root}/state").outputMode("append"))
    else:
        finish(rows.writeStream.option("checkpointLocation", f"{root}/state").outputMode(mode).foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/rows")))
    return spark.read.schema(rows.schema).parquet(f"{root}/rows")


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def plain_time(df: DataFrame, name: str = "ts") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("timestamp_ntz"))


@query("stream_ingest", f"""WITH {LINES}
SELECT seq, status, prompt, response, score, source FROM ingested WHERE status = 'accepted' UNION ALL
SELECT seq, status, NULL, NULL, NULL, NULL FROM ingested WHERE status NOT IN ('accepted', 'blank')""")
def stream_ingest(spark, sf_dir):
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    lines = example_lines(_Streamed(spark), sf_dir)
    finish(ingest.ingest_stream(lines, f"{root}/accepted", f"{root}/quarantine", f"{root}/state"))
    good = read_examples(spark, f"{root}/accepted").withColumn("status", F.lit("accepted"))
    bad = read_quarantined(spark, f"{root}/quarantine").select("seq", "status")
    return good.select("seq", "status", "prompt", "response", "score", "source").unionByName(
        bad, allowMissingColumns=True
    )


@query("stream_rating_log", f"WITH {RATINGS} SELECT message_id AS id, score, ts FROM ratings")
def stream_rating_log(spark, sf_dir):
    rows = ingest.rating_log_stream(timed(ratings(_Streamed(spark), sf_dir)))
    return plain_time(to_table(spark, rows))


@query("stream_ratings", f"""WITH {RATINGS}
SELECT message_id, 10.0::DOUBLE AS best FROM ratings WHERE score >= 7 AND prompt <> '' AND response <> ''
GROUP BY message_id""")
def stream_ratings(spark, sf_dir):
    """One example per message; which of a message's good ratings came first is the stream's order."""
    rows = ingest.rating_capture_stream(timed(ratings(_Streamed(spark), sf_dir)), "60 days")
    return to_table(spark, rows).select(
        "message_id", F.when(F.col("score").between(7, 10), F.lit(10.0)).alias("best")
    )


@query("stream_run_metrics", f"WITH {LOGS} SELECT * FROM metrics")
def stream_run_metrics(spark, sf_dir):
    rows = live.run_metrics_stream(log_lines(_Streamed(spark), sf_dir))
    return rounded(to_table(spark, rows, "complete"), "loss", "perplexity", "progress")


@query("stream_losses", f"WITH {LOGS} SELECT run_id, seq, round(loss, 6) AS loss FROM parsed WHERE loss IS NOT NULL")
def stream_losses(spark, sf_dir):
    return rounded(to_table(spark, live.loss_stream(log_lines(_Streamed(spark), sf_dir))), "loss")


@query("stream_debounce", f"""WITH {DEBOUNCED}
SELECT * FROM debounced WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL {QUIET_HOURS} HOUR - INTERVAL 10 MINUTE""")
def stream_debounce(spark, sf_dir):
    """Bursts that the watermark has closed; the last ones stay open."""
    changes = timed(table(_Streamed(spark), sf_dir, "events")).select(
        F.col("user_id").alias("session"), "ts", "event_id", "value"
    )
    return plain_time(to_table(spark, live.debounce_stream(changes, quiet_millis=QUIET_HOURS * 3_600_000)))


STATUS_EVENTS = """
good AS (
  SELECT *, lag(status) OVER w AS prev_status, lag(model) OVER w AS prev_model FROM polls WHERE ok
  WINDOW w AS (PARTITION BY host ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY host ORDER BY ts, event_id) AS successes FROM polls),
spells AS (
  SELECT host, successes, ts AS hit FROM numbered WHERE NOT ok
  QUALIFY row_number() OVER (PARTITION BY host, successes ORDER BY ts, event_id) = 2)
SELECT host, ts, CASE status WHEN 'ready' THEN 'loaded' ELSE 'failed' END AS event FROM good
WHERE prev_status IN ('starting', 'loading') AND status IN ('ready', 'error')
UNION ALL SELECT host, ts, 'model_changed' FROM good WHERE model IS DISTINCT FROM prev_model
UNION ALL SELECT host, hit, 'offline' FROM spells
UNION ALL SELECT n.host, n.ts, 'online' FROM numbered n JOIN spells s
  ON n.host = s.host AND n.ok AND n.successes = s.successes + 1"""

POLLED = """
polls AS (
  SELECT 'host-' || user_id AS host, ts, event_id, event_type <> 'error' AS ok,
         CASE event_type WHEN 'signup' THEN 'starting' WHEN 'click' THEN 'loading' WHEN 'view' THEN 'ready'
                         WHEN 'purchase' THEN 'error' END AS status,
         'org/model-' || ((user_id + event_id) % 3) AS model FROM events
"""


@query("stream_status", f"WITH {POLLED}), {STATUS_EVENTS}")
def stream_status(spark, sf_dir):
    rows = live.status_stream(timed(polls(_Streamed(spark), sf_dir)))
    return plain_time(to_table(spark, rows))


@query("stream_status_ordered", f"""WITH {POLLED}
  WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM events) - 600000), {STATUS_EVENTS}""")
def stream_status_ordered(spark, sf_dir):
    """Events of all polls that the watermark has passed; the last ten minutes stay open."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    live.use_ordered_state(spark)
    try:
        return plain_time(to_table(spark, live.ordered_status_stream(timed(polls(_Streamed(spark), sf_dir)))))
    finally:
        spark.conf.set(key, before)
