"""Vectorised views of the texts in an Arrow batch: bytes, words, lines and their hashes.

A text is its UTF-8 bytes and a NULL text is an empty one. Words are maximal runs without ASCII white space
(``[^\\x20\\x09-\\x0D]+``). A batch is read in slices of whole texts of about ``SLICE_BYTES``; a longer text is
a slice of its own, so that memory follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
import functools
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
MAX_ROWS = 60_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

HASH_BYTES = 1 << 14
"""Bytes that are hashed at a time, in arrays that stay in a core's cache."""

_MULTIPLIER = 0x9E3779B97F4A7C15
PRIME = (1 << 61) - 1
_HALF, _LOW = np.uint64(31), np.uint64((1 << 31) - 1)
_BASE = 0x1B7A5E2D93C4F86D % PRIME
_BYTE_SEED = 20241


def worker_cache(key: str, build: Callable):
    """Keeps ``build()`` for the life of the Python worker, which serves many tasks."""
    held = sys.modules.setdefault("_tunelake_worker", types.ModuleType("_tunelake_worker"))
    if not hasattr(held, key):
        setattr(held, key, build())
    return getattr(held, key)


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(function: Callable) -> Callable:
    """``function``, with freed memory given back after each call."""

    @functools.wraps(function)
    def run(*args):
        try:
            return function(*args)
        finally:
            release()

    return run


class Slice:
    """Whole consecutive texts: ``data`` has their bytes, ``offsets`` the bounds of each text in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.size = len(offsets) - 1

    def words(self, is_space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the number of words before it (size + 1 values)."""
        space = SPACE[self.data] if is_space is None else is_space
        edge = np.ones(len(space) + 1, bool)
        edge[1:] = space
        edge[self.offsets] = True
        starts = np.flatnonzero(edge[:-1] & ~space)
        edge = np.ones(len(space) + 1, bool)
        edge[:-1] = space
        edge[self.offsets] = True
        ends = np.flatnonzero(~space & edge[1:]) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive slices of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(kind).fill_null(b"")
    if len(column) == 0:
        return
    _, bounds, values = column.buffers()
    offsets = np.frombuffer(bounds, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), len(column), row + MAX_ROWS)
        yield Slice(data[offsets[row]: offsets[stop]], offsets[row: stop + 1] - offsets[row], row)
        row = stop


def _folded(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo ``PRIME``."""
    prime = np.uint64(PRIME)
    x = (x & prime) + (x >> np.uint64(61))
    return np.where(x >= prime, x - prime, x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo ``PRIME`` of values below it, put together from halves of 31 bits."""
    a_high, a_low, b_high, b_low = a >> _HALF, a & _LOW, b >> _HALF, b & _LOW
    middle = a_high * b_low + a_low * b_high
    return _folded(((a_high * b_high) << np.uint64(1)) + (middle >> np.uint64(30))
                   + ((middle & np.uint64((1 << 30) - 1)) << _HALF) + a_low * b_low)


def _powers(base: int, size: int) -> np.ndarray:
    found = np.ones(1, np.uint64)
    while len(found) < size + 1:
        found = np.concatenate([found, times(found, np.uint64(pow(base, len(found), PRIME)))])
    return found[: size + 1]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (size - 1).bit_length())
    codes = np.random.default_rng(_BYTE_SEED).integers(1, PRIME, 256, dtype=np.uint64)
    return _powers(_BASE, size), _powers(pow(_BASE, -1, PRIME), size), codes


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that any of their bits may be used."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hashes of the bytes modulo ``PRIME``, from which :func:`span_hashes` takes those of any span.

    Modulo a power of two, texts of regular patterns (complementary Thue-Morse words) would share their hash whatever
    the base.
    """
    powers, inverses, codes = worker_cache("powers_prime", lambda: _power_tables(2 * SLICE_BYTES))
    if len(data) >= len(powers):
        powers, inverses, codes = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    codes_high, codes_low = codes >> _HALF, codes & _LOW
    work = np.empty((6, min(len(data), HASH_BYTES)), np.uint64)
    for at in range(0, len(data), HASH_BYTES):
        some = data[at: at + HASH_BYTES]
        b, (a_high, a_low, b_high, b_low, middle, part) = powers[at: at + len(some)], work[:, : len(some)]
        # As in times(), without new arrays and not folded: terms stay below 2^64.
        np.take(codes_high, some, out=a_high, mode="clip")
        np.take(codes_low, some, out=a_low, mode="clip")
        np.right_shift(b, _HALF, out=b_high)
        np.bitwise_and(b, _LOW, out=b_low)
        np.multiply(a_high, b_low, out=middle)
        np.multiply(a_low, b_high, out=part)
        middle += part
        terms = a_high
        terms *= b_high
        terms <<= np.uint64(1)
        a_low *= b_low
        terms += a_low
        terms += np.right_shift(middle, np.uint64(30), out=part)
        middle &= np.uint64((1 << 30) - 1)
        middle <<= _HALF
        terms += middle
        # Sums of the upper and the lower halves cannot overflow; 2^32 of an upper one is folded by hand.
        high = np.cumsum(np.right_shift(terms, np.uint64(32), out=middle), out=middle)
        terms &= np.uint64(0xFFFFFFFF)
        total = np.cumsum(terms, out=terms)
        total += sums[at]
        total += np.right_shift(high, np.uint64(29), out=part)
        high &= np.uint64((1 << 29) - 1)
        high <<= np.uint64(32)
        total += high
        sums[at + 1: at + 1 + len(some)] = _folded(total)
    return sums, inverses


def span_hashes(hashes: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; they depend on the bytes alone, not on where a span lies."""
    sums, inverses = hashes
    span = _folded(sums[ends] + (np.uint64(PRIME) - sums[starts]))
    return mix(times(span, inverses[starts]) + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """Hash of each run of ``length`` bytes."""
    sums, inverses = hashes
    size = len(sums) - length
    return mix(times(_folded(sums[length:] + (np.uint64(PRIME) - sums[:size])), inverses[:size]))


def window_hashes(items: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of ``length`` consecutive item hashes."""
    n = max(0, len(items) - length + 1)
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total += items[j: j + n] * np.uint64((2 * j + 1) * _MULTIPLIER % (1 << 64))
        total ^= total >> np.uint64(29)
    return mix(total)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    again = np.zeros(len(keys), bool)
    again[1:] |= same
    again[:-1] |= same
    found = np.zeros(len(keys), bool)
    found[order] = again
    return found


def later_copies(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = sorted_keys[1:] == sorted_keys[:-1]
    return later


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
