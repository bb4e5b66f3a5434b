"""Session settings and the folder that every executor can reach."""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tunelake", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators rely on; the cluster manager supplies the rest."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """What a caller's own session needs before the operators run.

    A repeated key in a JSON line keeps its last value instead of failing the line. The package's few
    Python functions travel inside the tasks, so that executors need no copy of it.
    """
    cloudpickle.register_pickle_by_value(sys.modules["tunelake"])
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only where none is named is a local one made, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tunelake-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Stores an intermediate result in the shared folder, where several later steps read it.

    Used where a plan would otherwise compute a costly part once per use. The stored rows outlive lost
    executors.
    """
    folder = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
