"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, and exchanged in place.

A text becomes one byte array: sentinels go in where its parts begin, and two neighbouring segments change places by
three reversals, without a second copy of the parts. The order is prefix, suffix, middle (``psm``) or suffix, prefix,
middle (``spm``). Rotations undo themselves, so the same steps in reverse give the text back exactly.

Where a text is cut and which form it takes depends on the seed and its key alone. A text is handled row by row, in
the task that reads it: no shuffle, and memory follows the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 7
RATE = 100
"""Percent of the texts that are transformed."""

SUFFIX_FIRST = 50
"""Percent of these that take the form ``spm``."""

SENTINELS = ("<P>", "<S>", "<M>")


def draws(seed: int, key: int | None) -> list[int]:
    """Four 32-bit numbers of a key; those of a NULL key are of the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return np.frombuffer(digest, ">u4", 4).tolist()


def rotate(buffer: bytearray, low: int, middle: int, high: int) -> None:
    """Exchanges the segments before and after ``middle`` by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((low, middle), (middle, high), (low, high)):
        view[a:b] = view[a:b][::-1].copy()


def line_ends(text: bytes) -> np.ndarray:
    """Where the lines of a text end, the line feed included; what follows the last one is a line too."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def characters(buffer: bytes | bytearray, low: int, high: int) -> int:
    """Code points of a span that begins and ends between two of them."""
    return int(np.count_nonzero((np.frombuffer(buffer, np.uint8)[low:high] & 0xC0) != 0x80))


def exchange(text: bytes, prefix: int, middle: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text with its parts marked and in the order of ``form``; the cuts are byte places."""
    first, last, inner = marks
    buffer = bytearray(text)
    for place, mark in ((middle, last), (prefix, inner), (0, first)):
        buffer[place:place] = mark
    at_middle = len(first) + prefix
    at_suffix = at_middle + len(inner) + middle - prefix
    rotate(buffer, at_middle if form == "psm" else 0, at_suffix, len(buffer))
    return buffer


def restore_text(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text that :func:`exchange` was given."""
    first, last, inner = marks
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "psm":
        at_suffix = buffer.index(last, len(first))
        at_middle = buffer.index(inner, at_suffix + len(last))
        rotate(buffer, at_suffix, at_middle, len(buffer))
        at_middle, at_suffix = at_suffix, at_suffix + len(buffer) - at_middle
    else:
        at_prefix = buffer.index(first, len(last))
        at_middle = buffer.index(inner, at_prefix + len(first))
        rotate(buffer, 0, at_prefix, len(buffer))
        at_middle, at_suffix = at_middle - at_prefix, len(buffer) - at_prefix
    for place, mark in ((at_suffix, last), (at_middle, inner), (0, first)):
        del buffer[place: place + len(mark)]
    return bytes(buffer)


def _transformed(batches: Iterator[pa.RecordBatch], seed: int, rate: int, suffix_first: int, marks) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            text = text or b""
            ends = line_ends(text)
            n = len(ends)
            one, two, chance, kind = draws(seed, key)
            if not text or any(mark in text for mark in marks) or chance % 100 >= rate:
                rows.append((n, "plain", None, None, text))
                continue
            low, high = sorted((one % (n + 1), two % (n + 1)))
            prefix, middle = (int(ends[k - 1]) if k else 0 for k in (low, high))
            form = "spm" if kind % 100 < suffix_first else "psm"
            rows.append((n, form, characters(text, 0, prefix), characters(text, prefix, middle),
                         bytes(exchange(text, prefix, middle, form, marks))))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        found = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], *found],
                                         names=[*batch.schema.names[2:], "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, seed: int = SEED,
    rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """One row per row of ``docs``: the key, the columns ``keep``, ``n`` (lines), ``form`` (``psm``, ``spm`` or
    ``plain``), ``prefix_chars``, ``middle_chars`` (NULL if plain) and ``output``, the transformed text.

    A NULL text is empty; an empty text, and one that contains a sentinel, stays plain. Repeated rows are cut alike, and
    so are rows of equal keys and texts; a NULL key has draws of its own. Columns in ``keep`` that have the name of a
    result are left out. An empty table gives no rows.
    """
    marks = tuple(mark.encode() for mark in sentinels)
    given = [key, *[name for name in keep or [] if name not in (
        key, "n", "form", "prefix_chars", "middle_chars", "output")]]
    named = [f"_keep{i}" for i in range(len(given))]
    rows = docs.select(F.col(key).alias("_id"), F.col(text).cast("binary").alias("_text"),
                       *[F.col(name).alias(alias) for name, alias in zip(given, named, strict=True)])
    fields = ", ".join(f"{alias} {rows.schema[alias].dataType.simpleString()}" for alias in named)
    out = rows.mapInArrow(lambda b: _transformed(b, seed, rate, suffix_first, marks),
                          f"{fields}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.select(*[F.col(alias).alias(name) for alias, name in zip(named, given, strict=True)], "n", "form",
                      "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restore(transformed: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Adds ``restored``, the text that each ``output`` was made of, found from output and form alone.

    A NULL output or form gives NULL. A column ``restored`` is replaced.
    """
    marks = tuple(mark.encode() for mark in sentinels)
    names = [name for name in transformed.columns if name != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if output is None or form is None else restore_text(output, form, marks) for output, form in zip(
                batch.column("_output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())],
                                             names=[*batch.schema.names[:-1], "restored"])

    rows = transformed.select(*names, F.col("output").cast("binary").alias("_output"))
    fields = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in names)
    out = rows.mapInArrow(run, f"{fields}, restored binary")
    return out.withColumn("restored", F.col("restored").cast("string"))
