"""Lines and ratings as they arrive."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tunelake import fixed_values as fixed
from tunelake.functions.json_lines import example_id
from tunelake.operators.curation import accepted, ingest_examples, quarantined
from tunelake.operators.feedback import captured, feedback_log
from tunelake.sources.jsonl import append_batch


def ingest_stream(lines: DataFrame, accepted_path: str, quarantine_path: str, checkpoint: str) -> DataStreamWriter:
    """Validates arriving lines and appends them to the accepted or the quarantine table.

    Each micro-batch is one ``batch_id`` of the stream, whose id (kept in its checkpoint) is the writer. A batch
    repeated after a failure replaces itself, and a new stream, which counts from 0 again, replaces nothing. The
    batch is parsed once for both tables. Lines without their own ``seq`` are numbered within the batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if "seq" not in batch.columns:
            batch = batch.withColumn("seq", F.monotonically_increasing_id())
        ingested = ingest_examples(batch, batch_id).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            append_batch(accepted(ingested), accepted_path, writer, replay=True)
            append_batch(quarantined(ingested), quarantine_path, writer, replay=True)
        finally:
            ingested.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def rating_log_stream(ratings: DataFrame) -> DataFrame:
    """Every rating; write it in append mode."""
    return feedback_log(ratings)


def rating_capture_stream(ratings: DataFrame, delay: str = "1 day") -> DataFrame:
    """Examples from good ratings, once per message within the watermark delay. Append mode.

    Only this branch drops repeats; the log keeps them. State holds message ids, and no older ones than
    the delay.
    """
    fresh = (
        captured(ratings)
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["message_id"])
    )
    return fresh.select(
        example_id(F.lit("stream"), F.col("message_id"), F.col("prompt"), F.col("response")).alias("example_id"),
        "message_id", "prompt", "response", F.col("score").cast("double").alias("score"),
        F.lit(fixed.RATING_SOURCE).alias("source"),
    )
