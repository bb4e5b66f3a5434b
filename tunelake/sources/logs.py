"""Training logs as text files: one run per directory ``run_id=<id>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake import schemas

ROW_BITS = (1 << 33) - 1
"""Part of a generated row number that counts rows inside a partition."""


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with the run from the directory name and ``seq`` in the order in which they were written.

    Files of a run follow one another by modification time, then name; inside a file the position counts. The parts
    of files that are read by themselves are numbered per run, of which there are few.
    """
    lines = spark.read.text(path).select(
        F.col("run_id").cast("string").alias("run_id"), F.col("value").alias("line"),
        F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().bitwiseAND(ROW_BITS).alias("_row"),
    )
    order = Window.partitionBy("run_id").orderBy("_time", "_file", "_start")
    parts = lines.select("run_id", "_time", "_file", "_start").distinct().select(
        "run_id", "_file", "_start", F.row_number().over(order).alias("_part"))
    return lines.join(parts, ["run_id", "_file", "_start"]).select(
        "run_id", ((F.col("_part") - 1).cast("bigint") * (ROW_BITS + 1) + F.col("_row")).alias("seq"), "line")


def stream_logs(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stored log rows (run_id, seq, line) as they arrive, a bounded number of files per micro-batch."""
    return spark.readStream.schema(schemas.LOG_LINE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def log_line(fields: Column) -> Column:
    """A struct of metrics as one marked log line."""
    return F.concat(F.lit(fixed.LOG_MARK), F.to_json(fields))


def write_logs(logs: DataFrame, path: str) -> None:
    """Writes lines per run in ``seq`` order within each file."""
    (
        logs.sortWithinPartitions("run_id", "seq")
        .select("run_id", F.col("line").alias("value"))
        .write.mode("append")
        .partitionBy("run_id")
        .text(path)
    )
