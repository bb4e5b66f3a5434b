"""A dataset of examples as immutable snapshots with a current version.

A snapshot is a manifest: which stored parts make up the dataset, and what made it so. Parts are Parquet folders that
are written once and never changed; a manifest is one small file named by its version. The current version is the
highest one. A change reads a version, writes its new parts, and commits version + 1 by creating that file, which
fails if it exists: of two writers that started from one version, one wins and the other is told (:class:`Conflict`)
and loses nothing but its own parts, which no manifest names. Readers see whole versions only.

An append adds a part and refers to the others, a delete rewrites only the parts that hold a deleted example, and a clear
refers to none. Old versions stay readable until :func:`vacuum` drops the parts that no kept manifest names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tunelake import schemas

ATTEMPTS = 8


class Conflict(Exception):
    """Another writer committed the version that this change was to become."""


@dataclass(frozen=True)
class Snapshot:
    """One version of a dataset. Version 0 is the empty dataset that every root begins with."""

    root: str
    version: int
    parts: tuple[str, ...] = ()
    note: str = ""
    schema: str = ""

    def read(self, spark: SparkSession) -> DataFrame:
        """The examples of this version, with ``_part``, the stored part each of them is in."""
        kind = StructType.fromJson(json.loads(self.schema)) if self.schema else StructType.fromDDL(schemas.EXAMPLE)
        if not self.parts:
            return spark.createDataFrame([], kind).withColumn("_part", F.lit(None).cast("string"))
        rows = spark.read.schema(kind).parquet(*[f"{self.root}/parts/{part}" for part in self.parts])
        return rows.withColumn("_part", F.regexp_extract("_metadata.file_path", "/parts/([^/]+)/", 1))

    def examples(self, spark: SparkSession) -> DataFrame:
        return self.read(spark).drop("_part")


def _files(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(conf)


def _names(spark: SparkSession, path: str) -> list[str]:
    where, files = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with ``text``, whole or not at all; False if it exists.

    A store's own create-only write decides between two writers. Local folders have none that is atomic, so there a hard
    link does.
    """
    where, files = _files(spark, path)
    data = text.encode()
    files.mkdirs(where.getParent())
    if files.getScheme() == "file":
        final = where.toUri().getPath()
        draft = f"{final}.{uuid.uuid4().hex}.draft"
        with open(draft, "xb") as out:
            out.write(data)
        try:
            os.link(draft, final)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    # The draft is complete before it gets its name, which a rename without overwriting gives to one writer only.
    jvm = spark._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = files.create(draft, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if files.rename(draft, where):
        return True
    files.delete(draft, False)
    return False


def _manifest(version: int) -> str:
    return f"{version:020d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, oldest first."""
    return [int(name[:20]) for name in _names(spark, f"{root}/versions") if name.endswith(".json")]


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The current version, or an earlier one."""
    root = root.rstrip("/")
    if version is None:
        version = max(versions(spark, root), default=0)
    if version == 0:
        return Snapshot(root, 0)
    where, files = _files(spark, f"{root}/versions/{_manifest(version)}")
    if not files.exists(where):
        raise ValueError(f"{root} has no version {version}")
    stream = files.open(where)
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(root, version, tuple(said["parts"]), said["note"], said["schema"])


def _write_part(rows: DataFrame, root: str) -> str:
    name = uuid.uuid4().hex
    rows.write.mode("errorifexists").parquet(f"{root}/parts/{name}")
    return name


def commit(spark: SparkSession, base: Snapshot, parts: list[str], note: str, schema: StructType | None = None) -> Snapshot:
    """Makes ``parts`` the version after ``base``; :class:`Conflict` if there is one by now."""
    text = base.schema if schema is None else schema.json()
    done = Snapshot(base.root, base.version + 1, tuple(parts), note, text)
    said = json.dumps({"parts": parts, "note": note, "schema": text})
    if not _create(spark, f"{base.root}/versions/{_manifest(done.version)}", said):
        raise Conflict(f"{base.root} has a version {done.version} already")
    return done


def append(base: Snapshot, examples: DataFrame) -> Snapshot:
    """``base`` and more examples. The columns of a dataset are those of its first examples."""
    spark = examples.sparkSession
    if base.schema:
        names = StructType.fromJson(json.loads(base.schema)).names
        examples = examples.select(names)
    return commit(spark, base, [*base.parts, _write_part(examples, base.root)], "append", examples.schema)


def delete(base: Snapshot, requests: DataFrame) -> Snapshot:
    """``base`` without the examples whose id and prompt both match a request; other parts stay where they are.

    Nothing that matches is no change: ``base`` itself.
    """
    spark = requests.sparkSession
    rows = base.read(spark)
    wanted = requests.select("example_id", "prompt").distinct()
    keys = ["example_id", "prompt"]
    touched = [r["_part"] for r in rows.join(wanted, keys, "left_semi").select("_part").distinct().collect()]
    if not touched:
        return base
    left = rows.where(F.col("_part").isin(touched)).join(wanted, keys, "left_anti").drop("_part").select(
        StructType.fromJson(json.loads(base.schema)).names)
    kept = [part for part in base.parts if part not in touched]
    return commit(spark, base, [*kept, _write_part(left, base.root)], "delete")


def clear(spark: SparkSession, base: Snapshot) -> Snapshot:
    """The empty dataset as the next version."""
    return commit(spark, base, [], "clear")


def change(spark: SparkSession, root: str, step: Callable[[Snapshot], Snapshot], attempts: int = ATTEMPTS) -> Snapshot:
    """Applies ``step`` to the current version, and again to a newer one for as long as other writers come first."""
    for _ in range(attempts - 1):
        try:
            return step(snapshot(spark, root))
        except Conflict:
            continue
    return step(snapshot(spark, root))


def history(spark: SparkSession, root: str) -> DataFrame:
    """One row per version: ``version, note, n_parts``."""
    rows = [snapshot(spark, root, version) for version in versions(spark, root)]
    return spark.createDataFrame([(s.version, s.note, len(s.parts)) for s in rows], "version long, note string, n_parts int")


def vacuum(spark: SparkSession, root: str, keep_versions: int, running: tuple[str, ...] = ()) -> list[str]:
    """Drops the manifests before the last ``keep_versions`` and the parts that no other manifest names, except those of
    ``running`` writers. Not to be run while a writer is between its part and its commit unless it is named."""
    found = versions(spark, root)
    last = found[-keep_versions:] if keep_versions else []
    named = {part for version in last for part in snapshot(spark, root, version).parts} | set(running)
    gone = [name for name in _names(spark, f"{root}/parts") if name not in named]
    for path in [f"{root}/versions/{_manifest(v)}" for v in found if v not in last] + [f"{root}/parts/{n}" for n in gone]:
        where, files = _files(spark, path)
        files.delete(where, True)
    return gone
