"""Connected components of a graph given by its links, and intermediate tables that leave nothing behind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm.blocks import partitions
from tunelake.session import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

WAVES = 4
PARTITIONS_PER_FILE = 8
"""A stored table has ``WAVES`` files for each core or, where that is more, one for so many of the session's shuffle
partitions; a task writes each."""


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, where several later steps read it and lost executors don't matter.

    The shuffle files of the job that wrote it are dropped right away, so that steps don't add up on executors' disks.
    Several partitions are a file: a store may pay for each one (a local one starts processes to set its permissions).
    """
    spark = df.sparkSession
    files = max(WAVES * spark.sparkContext.defaultParallelism, -(-partitions(df) // PARTITIONS_PER_FILE))
    folder = folder or new_folder(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.coalesce(files).write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"


def forget(spark: SparkSession, folder: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for the nodes of ``links`` (columns ``a, b``),
    roots left out.

    Alternates large-star and small-star steps: every node links its larger neighbours to its smallest one, then its
    smaller neighbours. Each step is a partial minimum and a join; a round's links are stored in the shared folder and
    those of the round before dropped. Ends when a round changes nothing, after about the logarithm of the longest path.
    """
    spark = links.sparkSession
    folder = new_folder(spark)
    current = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), folder)
    before = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return current
        before = mark
        both = current.unionByName(current.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("low"))
        large = both.join(low, "node").where(F.col("root") > F.col("node")).select(
            F.col("root").alias("node"), F.least("low", "node").alias("root")).distinct()
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").where(F.col("root") > F.col("low")).select(
            F.col("root").alias("node"), F.col("low").alias("root"))
        further = new_folder(spark)
        current = stored(small.unionByName(low.select("node", F.col("low").alias("root"))).distinct(), further)
        forget(spark, folder)
        folder = further
