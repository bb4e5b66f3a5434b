"""Training-order materialisation: fixed-stride binary shards of token sequences in a keyed random order.

Each document's ids and an end mark are cut into sequences of ``length`` ids, the last one filled up with the end
mark. A first reading stores the documents' index (a few bytes each); the numbers of sequences per task of the scan
give every sequence an index from 0 to N - 1. A keyed Feistel permutation of the next larger even power of two,
walked until it falls below N, turns it into the global slot, without a sort and without state. Slots are cut into
shards of ``per_shard``; each shard is written by one task in slot order. Ids are encoded in both readings rather than
stored: storing them would cost more disk than the shards.

A shard file holds, per sequence, ``length`` 16-bit little-endian ids and two line feeds as a record mark: slot s is
in folder ``shard=s // per_shard`` at byte ``s % per_shard * stride``, so a reader continues anywhere by arithmetic.
Files are written by Spark's own text writer, whose record mark is an option, so any store and commit protocol does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.llm import blocks
from tunelake.llm.texts import mix, worker_cache
from tunelake.session import shared_dir

LENGTH = 256
PER_SHARD = 32_768
MARK = "\n\n"
ROUNDS = 6
MAX_TASKS = 1_000_000
ROWS = 500


def stride(length: int = LENGTH) -> int:
    return 2 * length + len(MARK)


def library_encoder(ranks, pattern: str) -> tiktoken.Encoding:
    """The public library's encoder of a rank file, once per worker."""
    return worker_cache(f"library_{len(ranks.value)}_{hash(pattern)}", lambda: tiktoken.Encoding(
        "own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}))


def feistel(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A permutation of 0 to size - 1: a balanced Feistel network on the smallest even number of bits that holds
    ``size``; values at or above ``size`` are permuted again until they fall below (cycle walking)."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.uint64(key % (1 << 64)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _encoded(batches: Iterator[pa.RecordBatch], encoder: tiktoken.Encoding, end_id: int
             ) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Keys and ids (with the end mark) of a few hundred documents at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.column(0).slice(at, ROWS), [
                np.append(np.array(encoder.encode_ordinary(v or ""), np.uint16), np.uint16(end_id))
                for v in batch.column(1).slice(at, ROWS).to_pylist()]


def _parts(ids: list[np.ndarray], length: int) -> np.ndarray:
    return np.array([-(-len(i) // length) for i in ids], np.int64)


def _check(first: np.ndarray, sizes: np.ndarray) -> int:
    return int(((first % 65_521 + 1) * sizes).sum())


def document_index(docs: DataFrame, ranks, pattern: str, end_id: int, key: str, text: str, length: int) -> DataFrame:
    """``task, first, key, n_tokens``: for each document the task of the scan that reads it, the number of the task's
    sequences before it, and its ids with the end mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, position = library_encoder(ranks, pattern), TaskContext.get().partitionId(), 0
        for keys, ids in _encoded(batches, encoder, end_id):
            counts = _parts(ids, length)
            first = position + np.cumsum(counts) - counts
            position += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), task, np.int32)), pa.array(first), keys,
                 pa.array(np.array([len(i) for i in ids], np.int64))], names=["task", "first", "key", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"task int, first long, key {kind}, n_tokens long")


def materialise(
    docs: DataFrame, ranks, pattern: str, *, order_key: int, end_id: int, path: str | None = None,
    key: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD,
) -> tuple[DataFrame, str]:
    """Writes the shards and returns the index (``key, part, slot, shard, byte_offset, n_tokens``) and their folder.

    ``docs`` must be a stored table, which is read twice: for the index, and for the records. Every task of the second
    reading checks that it met the same documents in the same order as in the first, and fails otherwise. ``path`` is
    a new folder of a shared store; without it one is made in the cluster's shared folder. A NULL or empty text is one
    sequence of the end mark, repeated rows are sequences of their own, other columns are left out, an empty table
    writes no shard.
    """
    spark = docs.sparkSession
    if max(ranks.value.values()) >= 1 << 16 or end_id >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    path = path or f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    document_index(docs, ranks, pattern, end_id, key, text, length).write.option("compression", "zstd").parquet(
        f"{path}/documents")
    stored = spark.read.parquet(f"{path}/documents")
    parts = F.ceil(F.col("n_tokens") / length).cast("long")
    # One row per task of the scan: 24 bytes for each of its partitions, so a million of them are 24 MB.
    tasks = stored.groupBy("task").agg(
        F.sum(parts).alias("n"), F.sum((F.col("first") % 65_521 + 1) * F.col("n_tokens")).alias("checked")
    ).orderBy("task").limit(MAX_TASKS + 1).toPandas()
    if len(tasks) > MAX_TASKS:
        raise ValueError("the table is read by too many tasks: raise spark.sql.files.maxPartitionBytes")
    numbers, counts, checks = (tasks[c].to_numpy(np.int64) for c in ("task", "n", "checked"))
    size, bases = int(counts.sum()), np.cumsum(counts) - counts
    plan = spark.sparkContext.broadcast((numbers, counts, checks, bases))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts, checks, bases = plan.value
        encoder, task, position, checked = library_encoder(ranks, pattern), TaskContext.get().partitionId(), 0, 0
        at = int(np.searchsorted(numbers, task))
        for _, ids in _encoded(batches, encoder, end_id):
            if at == len(numbers) or numbers[at] != task:
                raise RuntimeError("the documents changed between the two readings")
            n = _parts(ids, length)
            total = int(n.sum())
            first = np.cumsum(n) - n
            checked += _check(position + first, np.array([len(i) for i in ids], np.int64))
            flat = np.full(total * length, end_id, "<u2")
            for i, start in zip(ids, first * length, strict=True):
                flat[start: start + len(i)] = i
            slot = feistel(bases[at] + position + np.arange(total), size, order_key)
            position += total
            bounds = np.arange(0, 2 * length * (total + 1), 2 * length, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // per_shard), pa.Array.from_buffers(
                    pa.binary(), total, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat.tobytes())])],
                names=["slot", "shard", "record"])
        if position and (position != counts[at] or checked != checks[at]):
            raise RuntimeError("the documents changed between the two readings")

    shards = max(1, -(-size // per_shard))
    docs.select(key, text).mapInArrow(records, "slot long, shard long, record binary").repartition(
        min(shards, blocks.partitions(docs)), "shard").sortWithinPartitions("shard", "slot").select(
        "shard", F.col("record").cast("string").alias("value")).write.partitionBy(
        "shard").option("lineSep", MARK).text(f"{path}/shards")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, _, _, bases = plan.value
        for batch in batches:
            at = np.searchsorted(numbers, batch.column(0).to_numpy())
            index = (bases[at] if len(at) else np.zeros(0, np.int64)) + batch.column(1).to_numpy()
            slot = feistel(index, size, order_key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *batch.columns[2:]], names=["slot", *batch.schema.names[2:]])

    kind = docs.schema[key].dataType.simpleString()
    part = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")
    index = stored.select("task", "first", "key", "n_tokens", part).select(
        "task", F.col("first") + F.col("part"), "key", "part", "n_tokens",
    ).mapInArrow(slots, f"slot long, key {kind}, part long, n_tokens long").select(
        F.col("key").alias(key), F.col("part").cast("int").alias("part"), "slot",
        F.floor(F.col("slot") / per_shard).alias("shard"), (F.col("slot") % per_shard * stride(length)).alias("byte_offset"),
        F.least(F.col("n_tokens") - F.col("part") * length, F.lit(length)).cast("int").alias("n_tokens"))
    return index, f"{path}/shards"


def read_shards(spark, path: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """``slot`` and ``ids`` of every record of the shards; any of them can be read without the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                records = np.frombuffer(content.as_buffer(), "<u2").reshape(-1, length + 1)
                for at in range(0, len(records), 4096):
                    some = np.ascontiguousarray(records[at: at + 4096, :length]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * length, pa.int32()),
                                                     pa.array(some.ravel()))
                    slots = shard * per_shard + at + np.arange(len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(slots), lists], names=["slot", "ids"])

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("shard").cast("long"), "content").mapInArrow(run, "slot long, ids array<int>")
