"""Reading lines from text files and appending example batches."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunelake import schemas
from tunelake.session import shared_dir

IMPORT_GLOB = "*.{jsonl,json,txt}"


def read_lines(spark: SparkSession, path: str, glob: str = IMPORT_GLOB) -> DataFrame:
    """Every physical line under ``path``. A missing path gives an empty table of the same shape.

    ``seq`` grows with the position in a file and is unique in one read; ingest stores it, so it stays
    stable afterwards.
    """
    reader = spark.read.option("pathGlobFilter", glob)
    try:
        lines = reader.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.RAW_LINE)
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq")
    )


def read_numbered_lines(spark: SparkSession, path: str, glob: str = IMPORT_GLOB) -> DataFrame:
    """As :func:`read_lines`, with ``seq`` the number of lines before: files go by path, lines by place.

    Two readings of the same files agree whatever the size of splits, so that ids of an upload hold before it is
    ingested. The lines are stored once in the shared folder with the split they come from, so that counts and lines
    are of one reading even if executors come or go. Only counts meet: a row per split in a window of its file, and a
    row per file in one task. No text is shuffled unless the counts are too large to be sent to all tasks.
    """
    reader = spark.read.option("pathGlobFilter", glob)
    try:
        lines = reader.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.RAW_LINE)
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    ).write.parquet(folder)
    return number_places(spark.read.parquet(folder))


def number_places(stored: DataFrame) -> DataFrame:
    """Numbers stored lines (value, file, start, place) over all files, from 0. Places grow within a split."""
    splits = stored.groupBy("file", "start").agg(F.min("place").alias("_first"), F.count("*").alias("_n"))
    files = stored.groupBy("file").agg(F.count("*").alias("_n"))
    before = files.select(
        "file", F.sum("_n").over(Window.orderBy("file")).alias("_end"), "_n").select(
        "file", (F.col("_end") - F.col("_n")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy("file").orderBy("start")) - F.col("_n")
    offsets = splits.withColumn("_inside", inside).join(before, "file").select(
        "file", "start", (F.col("_before") + F.col("_inside") - F.col("_first")).alias("_offset"))
    return stored.join(offsets, ["file", "start"]).select(
        "value", "file", (F.col("place") + F.col("_offset")).alias("seq"))


def stream_lines(
    spark: SparkSession, path: str, glob: str = IMPORT_GLOB, files_per_batch: int = 1000
) -> DataFrame:
    """Lines of files as they arrive, a bounded number of files per micro-batch."""
    return (
        spark.readStream.option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )


def write_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    lines.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def append_batch(examples: DataFrame, root: str, writer: str = "upload", replay: bool = False) -> None:
    """Appends a batch under its writer and ``batch_id``; batches of other writers stay apart.

    A writer's batch that is there already is refused, for it would be lost. Only a ``replay``, a writer that repeats
    its own batch after a failure, replaces it.
    """
    spark = examples.sparkSession
    rows = examples.withColumn("writer", F.lit(writer))
    if not replay:
        there = read_examples(spark, root).where(F.col("writer") == writer).select("batch_id").distinct()
        taken = rows.select("batch_id").distinct().join(there, "batch_id").first()
        if taken:
            raise ValueError(f"writer {writer!r} has written batch {taken['batch_id']} before")
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("writer", "batch_id")
        .parquet(root)
    )


def read_examples(spark: SparkSession, root: str) -> DataFrame:
    """The appended examples; none yet is an empty table of the same shape."""
    return _read_batches(spark, root, schemas.EXAMPLE)


def read_quarantined(spark: SparkSession, root: str) -> DataFrame:
    """As :func:`read_examples`, for appended lines that were set aside."""
    return _read_batches(spark, root, schemas.QUARANTINED)


def _read_batches(spark: SparkSession, root: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_version(examples: DataFrame, root: str, version: int) -> None:
    """Writes a whole dataset version beside the earlier ones; a version is never changed."""
    examples.write.mode("errorifexists").parquet(f"{root}/v={version}")


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version}")


def export_training_set(examples: DataFrame, path: str) -> None:
    """Prompt and response of the training rows as JSON lines."""
    examples.select("prompt", "response").write.mode("errorifexists").json(path)
