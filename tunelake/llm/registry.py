"""Registration of this subpackage's queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tunelake.plans.registry import Query, Run
from tunelake.session import prepare

QUERIES: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_ROWS = 1_000
ARROW_BYTES = "8m"


def ready(spark: SparkSession) -> SparkSession:
    """A prepared session that hands texts to Python in small batches: workers of two cores share an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return prepare(spark)


def query(name: str, sql: str | None = None):
    def register(run: Run) -> Run:
        QUERIES[name] = Query(lambda spark, sf_dir: run(ready(spark), sf_dir), sql)
        return run

    return register
