"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tunelake.session import prepare

Run = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Registers ``run(spark, sf_dir)`` under ``name``; ``sql`` is left out where SQL cannot state it."""

    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(lambda spark, sf_dir: run(prepare(spark), sf_dir), sql)
        return run

    return register
