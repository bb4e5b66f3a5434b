"""Token counts of flat, unindexed token files by a scan for end-of-document ids.

A file is nothing but 16-bit big-endian ids, documents one after the other, each closed by the separator. Files are
cut into blocks of fixed size; a vectorised search finds the separators of a block. Where a block's first document
began is known from the last separator of the blocks before it: a running maximum over the blocks of a file, one row
per block, carries it across (a prefix scan). So a document may span any number of blocks, and no block waits for
another.

:func:`write_flat` writes such files with Spark's text writer: the separator 0xC480 is the UTF-8 form of U+0100, which
the writer takes as record mark, and lies above the ids of a vocabulary of 50,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunelake.llm.token_store import ROWS, library_encoder

SEPARATOR = 0xC480
MARK = "Ā"
BLOCK_BYTES = 1 << 20
DOCS_PER_FILE = 8_192


def write_flat(docs: DataFrame, ranks, pattern: str, path: str, text: str = "text",
               docs_per_file: int = DOCS_PER_FILE) -> None:
    """Flat token files of the texts, in the order of the rows; a NULL or empty text is a document of no tokens."""
    if max(ranks.value.values()) >= SEPARATOR:
        raise ValueError("an id of the vocabulary is the separator")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids = [np.array(encoder.encode_ordinary(v or ""), ">u2").tobytes()
                       for v in batch.column(0).slice(at, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["value"])

    docs.select(text).mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option(
        "lineSep", MARK).option("maxRecordsPerFile", docs_per_file).text(path)


def count_tokens(spark: SparkSession, path: str, *, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES
                 ) -> DataFrame:
    """One row per document: ``file`` (name), ``ordinal`` in the file, ``start`` (first token) and ``n_tokens``, and
    ``ended``: false for tokens behind a file's last separator, which are counted as a document. Documents do not
    cross files. An empty file gives no rows; a last odd byte is no token."""
    if block_bytes % 2:
        raise ValueError("a block must hold whole ids")
    length = F.col("length") - F.col("length") % 2
    files = spark.read.format("binaryFile").load(path).where(length > 0)
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(length / block_bytes) - 1)).alias("block")
    cut = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", length.alias("length"), places)
    pieces = cut.select("file", "block", (F.col("length") / 2).cast("long").alias("total"), F.expr(
        f"substring(content, int(block * {block_bytes} + 1), int(least({block_bytes}, length - block * {block_bytes})))"
    ).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(1).to_pylist()
            found = [np.flatnonzero(np.frombuffer(value.as_buffer(), ">u2") == separator) + block * block_bytes // 2
                     for block, value in zip(blocks, batch.column(3), strict=True)]
            lists = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["file", "block", "total", "ends"])

    scanned = pieces.mapInArrow(run, "file string, block long, total long, ends array<long>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned.select(
        "file", "block", "total", "ends",
        F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1).cast("long")).alias("last"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long").alias("seen"))
    starts = F.transform(F.concat(F.array("last"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))),
                         lambda end: end + 1)
    ended = carried.where(F.size("ends") > 0).select(
        "file", "seen", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end")))).select(
        "file", (F.col("seen") + F.col("pos")).alias("ordinal"), F.col("col.start").alias("start"),
        (F.col("col.end") - F.col("col.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    summed = scanned.groupBy("file").agg(
        F.max("total").alias("total"), F.max(F.coalesce(F.array_max("ends"), F.lit(-1))).alias("last"),
        F.sum(F.size("ends")).cast("long").alias("ordinal"))
    rest = summed.where("total > last + 1").select(
        "file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("total") - F.col("last") - 1).alias("n_tokens"),
        F.lit(False).alias("ended"))
    return ended.unionByName(rest)
