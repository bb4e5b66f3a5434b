"""Documents in blocks, and fingerprints between them.

Documents are dealt by key into blocks of a few megabytes. What a block asks of the whole collection it sends as one
binary row per range of the fingerprint space, already free of repeats within the block; a range's task answers
with one row per block. So neither a frequent fingerprint nor a large group of copies makes a large task, and rows
stay few and even.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm.texts import release

BLOCKS_PER_PARTITION = 4
"""Blocks are several per partition, so that hashing them to partitions leaves these even. Ranges are one per
partition: a block writes one message to each, and messages should stay few."""

ROWS = 1_000

NO_ID = np.iinfo(np.int64).max
"""Stands for a NULL key, which comes after all others."""


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which users size by their data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def n_ranges(df: DataFrame) -> int:
    return partitions(df)


def block_of(number: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(n_blocks)).cast("int")


def in_blocks(
    df: DataFrame, key: str, text: Column, keep: list[str], per_partition: int = BLOCKS_PER_PARTITION,
) -> DataFrame:
    """``_block, _id, _text`` (compressed, see :func:`opened`) and the columns ``keep``, shuffled once by block; several
    steps read that shuffle."""
    n = partitions(df)
    number = F.coalesce(F.col(key).cast("long"), F.lit(int(NO_ID)))
    rows = df.select(
        text.cast("binary").alias("_text"), block_of(number, n * per_partition).alias("_block"), number.alias("_id"),
        *[F.col(name) for name in keep],
    )
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(_compressed, schema).repartition(n, "_block")


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            packed = [None if v is None else len(v).to_bytes(8, "little") + codec.compress(v, asbytes=True)
                      for v in some.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *some.columns[1:]],
                                             names=some.schema.names)
    release()


def opened(table: pa.Table) -> pa.Table:
    """A block's table with its texts as bytes."""
    codec = pa.Codec("zstd")
    found = [None if v is None else codec.decompress(v[8:], int.from_bytes(v[:8], "little"), asbytes=True) if len(v) > 8
             else b"" for v in table["_text"].to_pylist()]
    place = table.schema.get_field_index("_text")
    return table.set_column(place, "_text", pa.array(found, pa.large_binary()))


def in_order(table: pa.Table) -> pa.Table:
    """Rows of a block, opened, in an order that every step finds again: by key, then text."""
    return opened(table.take(pc.sort_indices(table, sort_keys=[("_id", "ascending"), ("_text", "ascending")])))


def ranges(fingerprints: np.ndarray, n: int) -> np.ndarray:
    """The range (0 to n - 1) of 64-bit fingerprints, by their upper half; the lower half stays free."""
    return ((fingerprints >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def low(fingerprints: np.ndarray) -> np.ndarray:
    return (fingerprints & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed binary value: for each its length in bytes, then its bytes."""
    body = b"".join(np.int64(a.nbytes).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.int64(len(body)).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack(value: bytes, *kinds) -> list[np.ndarray]:
    size = int(np.frombuffer(value, np.int64, 1)[0])
    body = pa.decompress(value[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    arrays, at = [], 0
    for kind in kinds:
        length = int(np.frombuffer(body, np.int64, 1, at)[0])
        arrays.append(np.frombuffer(body, kind, length // np.dtype(kind).itemsize, at + 8))
        at += 8 + length
    return arrays


def filled(bounds: np.ndarray) -> list[int]:
    """The ranges that have something between their bounds."""
    return np.flatnonzero(np.diff(bounds)).tolist()


def cut(order_key: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the ranges 0 to n - 1 in sorted range numbers."""
    return np.searchsorted(order_key, np.arange(n + 1, dtype=order_key.dtype))
