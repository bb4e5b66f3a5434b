"""Removal of passages that an earlier document has, by longest previous factors in suffix order.

A byte is removed if some string of ``min_length`` bytes over it also starts in a document with a smaller key: a
position whose longest previous factor (the longest match that begins in a document with a smaller key) reaches
``min_length`` covers that many bytes. In suffix order, that match is with the nearest suffix above or below that has a
smaller key (previous and next smaller value), as long as the common prefix is between them
(:func:`previous_factors`). Suffixes count to depth ``min_length``, for a longer match decides nothing more.

One suffix array over a large collection is out of reach, so it is cut into shards that never miss a match: each
window of ``min_length`` bytes belongs to the anchor inside it, its k-gram of the lowest hash (the leftmost of equal
ones). Equal windows have equal anchors, so a shard per range of anchors sees all copies of its windows. The
neighbouring windows of one anchor travel as one context. An anchor that many contexts have (a common line) would
make a large shard: its windows are dealt by a second anchor as well, the lowest k-gram that is not the first one.
Steps, with blocks as in :mod:`tunelake.llm.blocks`:

1. blocks send their distinct anchors with counts; ranges answer with those that several blocks have, and which of
   these are hot;
2. blocks send the contexts of shared anchors, of equal ones in a block only those of the smallest key; documents
   equal to an earlier one as a whole are marked at once and take no further part;
3. shards order suffixes and answer with the positions that have an earlier match; a large shard takes its anchors
   in parts, one after the other;
4. blocks merge them into spans and cut these out.

Anchors found shared by chance cost a context, not a result: windows are compared byte by byte. Contexts count as equal
by a 64-bit hash modulo a prime, whole documents by one of 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.llm import blocks, texts

MIN_LENGTH = 50
GRAM = 25
_PLACE_BITS = 28
_ROW_SHIFT = 40
WINDOWS = 200_000
"""Windows that a shard puts in order at a time."""

PART_BYTES = 4 << 20
"""Compressed messages that a shard opens at a time, in the mean."""

PER_PARTITION = 2
"""Blocks per partition: nearly every block has a message for every range, and these should stay few."""

HOT_CONTEXTS = 2_000
"""Contexts of an anchor, counted in all blocks, from which its windows are dealt by a second anchor too. Results don't
depend on it: equal windows have equal second anchors."""


def _anchors(part: texts.Slice, hashes: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: row, start, run length, anchor hash, and the run's place in the slice.
    ``hashes`` are those of the slice's k-grams."""
    none = np.zeros(0, np.int64)
    if len(part.data) < length:
        return none, none, none, none.astype(np.uint64), none
    size = len(hashes)
    place = np.uint64((1 << _PLACE_BITS) - 1)
    best = (hashes & ~place) | np.arange(size, dtype=np.uint64)
    width, window = 1, length - gram + 1
    while 2 * width <= window:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < window:
        best = np.minimum(best[: len(best) - (window - width)], best[window - width:])
    anchor = (best & place).astype(np.int64)
    inside = np.ones(len(anchor) + 1, bool)
    for low, high in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True):
        inside[max(low, high - length + 1): high] = False
    inside[len(anchor)] = False
    inside = inside[:-1]
    change = np.ones(len(anchor) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    bounds = np.flatnonzero(change)
    begins, runs = bounds[:-1], np.diff(bounds)
    kept = inside[begins]
    begins, runs = begins[kept], runs[kept]
    row = np.searchsorted(part.offsets, begins, "right") - 1
    return row + part.first, begins - part.offsets[row], runs, hashes[anchor[begins]], begins


def _second_anchors(row, start, run, anchor, place, hashes, length: int, gram: int):
    """Runs of one anchor cut where the second anchor changes; the anchor returned names both."""
    total = int(run.sum())
    context = np.repeat(np.arange(len(run)), run)
    offset = np.arange(total) - np.repeat(np.cumsum(run) - run, run)
    base = place[context] + offset
    where, what = np.zeros(total, np.int64), np.zeros(total, np.uint64)
    within = np.arange(length - gram + 1)
    for at in range(0, total, 1 << 15):
        some = slice(at, at + (1 << 15))
        grams = hashes[base[some, None] + within]
        grams[grams == anchor[context[some], None]] = np.uint64((1 << 64) - 1)
        best = grams.argmin(1)
        where[some] = base[some] + best
        what[some] = grams[np.arange(len(best)), best]
    new = np.ones(total, bool)
    new[1:] = (context[1:] != context[:-1]) | (where[1:] != where[:-1])
    at = np.flatnonzero(new)
    of = context[at]
    return (row[of], start[of] + offset[at], np.diff(np.append(at, total)), texts.mix(anchor[of] ^ texts.mix(what[at])),
            base[at])


def _spread(anchors: np.ndarray) -> np.ndarray:
    """Anchors are the lowest of many hashes: dealt as they are, the first of n ranges would get up to ``length - gram + 1``
    times the mean."""
    return texts.mix(anchors)


def _gram_hashes(part: texts.Slice, gram: int):
    hashes = texts.prefix_hashes(part.data)
    return hashes, texts.gram_hashes(hashes, gram) if len(part.data) >= gram else np.zeros(0, np.uint64)


def _digests(column: pa.ChunkedArray, length: int) -> list[bytes | None]:
    return [hashlib.blake2b(v, digest_size=16).digest() if v is not None and len(v) >= length else None
            for v in column.to_pylist()]


@texts.releasing
def _ask(table: pa.Table, n: int, length: int, gram: int) -> pa.Table:
    """Step 1 of a block: distinct anchors and the digests of whole texts, by range."""
    table = blocks.in_order(table)
    found = [_spread(_anchors(part, _gram_hashes(part, gram)[1], length, gram)[3]) for part in texts.slices(table["_text"])]
    anchors, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    counts = np.minimum(counts, 255).astype(np.uint8)
    bounds = blocks.cut(blocks.ranges(anchors, n), n)
    digests = [(d, i) for d, i in zip(_digests(table["_text"], length), table["_id"].to_pylist(), strict=True) if d]
    whole = np.frombuffer(b"".join(d for d, _ in digests), np.uint64).reshape(-1, 2)
    ids = np.array([i for _, i in digests], np.int64)
    order = np.argsort(whole[:, 0], kind="stable")
    whole, ids = whole[order], ids[order]
    whole_bounds = blocks.cut(blocks.ranges(whole[:, 0].copy(), n), n)
    block = table["_block"][0].as_py()
    rows = [(p, block, blocks.pack(blocks.low(anchors[bounds[p]: bounds[p + 1]]), counts[bounds[p]: bounds[p + 1]],
                                   whole[whole_bounds[p]: whole_bounds[p + 1]], ids[whole_bounds[p]: whole_bounds[p + 1]]))
            for p in sorted({*blocks.filled(bounds), *blocks.filled(whole_bounds)})]
    return _rows(rows)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    ps, bs, values = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"_range": pa.array(ps, pa.int32()), "_block": pa.array(bs, pa.int32()),
                     "payload": pa.array(values, pa.binary())})


MESSAGE = "_range int, _block int, payload binary"


@texts.releasing
def _share(table: pa.Table) -> pa.Table:
    """Step 1 of a range: which anchors several blocks have, and which whole texts a smaller key has."""
    which = table["_block"].to_pylist()
    parts = [blocks.unpack(v, np.uint32, np.uint8, np.uint64, np.int64) for v in table["payload"].to_pylist()]
    values, place, n_blocks = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
    hot = np.bincount(place, np.concatenate([p[1] for p in parts]), len(values)) > HOT_CONTEXTS
    parts = [(p[0], p[2], p[3]) for p in parts]
    shared, hot = values[n_blocks > 1], hot[n_blocks > 1]
    first: dict[bytes, int] = {}
    digests = [[p[1][2 * i: 2 * i + 2].tobytes() for i in range(len(p[2]))] for p in parts]
    for keys, part in zip(digests, parts, strict=True):
        for key, i in zip(keys, part[2].tolist(), strict=True):
            first[key] = min(i, first.get(key, i))
    rows = []
    for block, keys, part in zip(which, digests, parts, strict=True):
        later = sorted({k for k, i in zip(keys, part[2].tolist(), strict=True) if first[k] < i})
        own = part[0][np.isin(part[0], shared, assume_unique=True)]
        if len(own) or later:
            rows.append((table["_range"][0].as_py(), block, blocks.pack(
                own, hot[np.searchsorted(shared, own)].astype(np.uint8), np.frombuffer(b"".join(later), np.uint64), np.array([first[k] for k in later], np.int64))))
    return _rows(rows)


@texts.releasing
def _send(table: pa.Table, answers: pa.Table, n: int, length: int, gram: int) -> pa.Table:
    """Step 2 of a block: contexts of shared anchors by range. What the block can mark itself goes along."""
    if not table.num_rows:
        return _rows([])
    table = blocks.in_order(table)
    block = table["_block"][0].as_py()
    ids = table["_id"].to_numpy()
    shared, hot, earlier = [], [], {}
    for p, value in sorted(zip(answers["_range"].to_pylist(), answers["payload"].to_pylist(), strict=True)):
        own, common, keys, firsts = blocks.unpack(value, np.uint32, np.uint8, np.uint64, np.int64)
        shared.append(own.astype(np.uint64) | np.uint64(p << 32))
        hot.append(shared[-1][common > 0])
        earlier |= {keys[2 * i: 2 * i + 2].tobytes(): first for i, first in enumerate(firsts.tolist())}
    shared, hot = (np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in (shared, hot))
    copy = np.array([d is not None and earlier.get(d, i) < i
                     for d, i in zip(_digests(table["_text"], length), ids.tolist(), strict=True)], bool)

    everywhere = list(texts.slices(table["_text"]))
    found = []
    for number, part in enumerate(everywhere):
        hashes, grams = _gram_hashes(part, gram)
        runs = _anchors(part, grams, length, gram)
        keep = ~copy[runs[0]]
        runs = [x[keep] for x in runs]
        even = _spread(runs[3])
        asked = (blocks.ranges(even, n) << np.uint64(32)) | (even & np.uint64(0xFFFFFFFF))
        much = np.isin(asked, hot)
        more = _second_anchors(*(x[much] for x in runs), grams, length, gram) if much.any() else None
        runs[3] = even
        if more:
            # What the windows of a hot anchor are dealt by is shared as far as the anchor is.
            runs = [np.concatenate([x[~much], y]) for x, y in zip(runs, more, strict=True)]
            asked = np.concatenate([asked[~much], np.full(len(more[0]), hot[0], np.uint64)])
        row, start, run, anchor, place = runs
        spans = texts.span_hashes(hashes, place, place + run + length - 1)
        found.append((row, start, run, anchor, place, np.full(len(row), number), spans ^ texts.mix(anchor), asked))
    row, start, run, anchor, place, number, content, full = (
        np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(8))
    anchor, content, full = (x.astype(np.uint64) for x in (anchor, content, full))
    several = texts.repeated(anchor)
    at = np.flatnonzero(several | np.isin(full, shared))
    # Of equal contexts in the block, those of the smallest key are sent; the others have an earlier match.
    order = at[np.lexsort((ids[row[at]], content[at]))]
    head = np.ones(len(order), bool)
    head[1:] = content[order[1:]] != content[order[:-1]]
    smallest = ids[row[order[np.flatnonzero(head)]]][np.cumsum(head) - 1] if len(order) else ids[:0]
    own_id = ids[row[order]]
    local = order[own_id > smallest]
    sent = order[own_id == smallest]
    sent = sent[np.argsort(blocks.ranges(anchor[sent], n), kind="stable")]
    bounds = blocks.cut(blocks.ranges(anchor[sent], n), n)
    whole = np.flatnonzero(copy)
    sizes = pc.fill_null(pc.binary_length(table["_text"]), 0).to_numpy()
    marks = np.concatenate([
        np.stack([row[local], start[local], start[local] + run[local]], 1),
        np.stack([whole, np.zeros(len(whole), np.int64), sizes[whole].astype(np.int64) - length + 1], 1)]).astype(np.int64)
    rows = [(block % n, block, blocks.pack(marks, *[np.zeros(0, np.int64)] * 6))] if len(marks) else []
    for p in blocks.filled(bounds):
        chosen = sent[bounds[p]: bounds[p + 1]]
        pieces = [everywhere[k].data[at: at + r + length - 1].tobytes() for k, at, r in zip(
            number[chosen].tolist(), place[chosen].tolist(), run[chosen].tolist(), strict=True)]
        rows.append((p, block, blocks.pack(
            marks[:0], row[chosen].astype(np.int32), ids[row[chosen]], start[chosen].astype(np.int64),
            run[chosen].astype(np.int32), blocks.low(anchor[chosen]), np.frombuffer(b"".join(pieces), np.uint8))))
    return _rows(rows)


def _nearest_smaller(keys: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix (in order) with the nearest one above that has a smaller key, where it reaches
    ``least``. ``common`` is that with the suffix right above.

    All suffixes look one place up and then go where the one they met looks, all at once: whatever lies between has no
    smaller key. The prefix shrinks along, and where it is below ``least``, nothing further up can match.
    """
    at, reach = np.arange(len(keys)) - 1, common.copy()
    open_ = np.flatnonzero((reach >= least) & (at >= 0))
    open_ = open_[keys[at[open_]] >= keys[open_]]
    while len(open_):
        met = at[open_]
        reach[open_] = np.minimum(reach[open_], reach[met])
        at[open_] = at[met]
        open_ = open_[(at[open_] >= 0) & (reach[open_] >= least)]
        open_ = open_[keys[at[open_]] >= keys[open_]]
    reach[at < 0] = 0
    return np.where(reach >= least, reach, 0)


def previous_factors(windows: np.ndarray, keys: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factors: the longest prefix that each window shares with one of a smaller key, 0 where it is
    shorter than ``least``.

    ``windows`` has a fixed-width row of bytes per suffix, all that counts of it. Suffixes are put in order (equal ones by
    key); among those of a smaller key, the nearest above and the nearest below share most.
    """
    by_key = np.argsort(keys, kind="stable")
    order = by_key[np.argsort(windows[by_key], kind="stable")]
    width = windows.dtype.itemsize
    rows = windows[order].view(np.uint8).reshape(-1, width)
    common = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 16):
        differ = rows[at: at + (1 << 16)] != rows[at - 1: at - 1 + len(rows[at: at + (1 << 16)])]
        common[at: at + (1 << 16)] = np.where(differ.any(1), differ.argmax(1), width)
    own = keys[order]
    below = np.append(common[1:], 0)
    longest = np.maximum(_nearest_smaller(own, common, least),
                         _nearest_smaller(own[::-1], below[::-1], least)[::-1])
    out = np.zeros(len(order), np.int64)
    out[order] = longest
    return out


def _by_anchor(contexts: np.ndarray, anchor: np.ndarray, run: np.ndarray):
    """Parts of contexts sorted by anchor, whole anchors, of about ``WINDOWS`` windows each."""
    at, total = 0, np.cumsum(run[contexts])
    while at < len(contexts):
        stop = int(np.searchsorted(total, (total[at - 1] if at else 0) + WINDOWS, "right"))
        stop = min(max(stop, at + 1), len(contexts))
        stop = at + int(np.searchsorted(anchor[contexts[at:]], anchor[contexts[stop - 1]], "right"))
        yield contexts[at:stop]
        at = stop


def _matched(contexts, reps, begins, run, key, data, length):
    """Ranges of windows, relative to their context, that have an earlier match among these contexts. More windows than
    ``WINDOWS`` are put in order by shares of their hash, so that equal ones stay together."""
    runs = run[reps[contexts]]
    context = np.repeat(contexts, runs)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(runs) - runs, runs)
    place = begins[reps[context]] + offset
    view, hit = np.lib.stride_tricks.sliding_window_view(data, length), np.zeros(len(context), bool)
    n_shares = -(-len(context) // WINDOWS)
    share = np.zeros(len(context), np.uint64)
    if n_shares > 1:
        for at in range(0, len(place), WINDOWS):
            some = view[place[at: at + WINDOWS]]
            for j in range(0, length - 7, 7):
                share[at: at + WINDOWS] = texts.mix(share[at: at + WINDOWS] + np.ascontiguousarray(some[:, j: j + 8]).view(np.uint64)[:, 0])
        share %= np.uint64(n_shares)
    for number in range(n_shares):
        own = np.flatnonzero(share == np.uint64(number))
        windows = np.ascontiguousarray(view[place[own]]).view(f"S{length}").ravel()
        hit[own] = previous_factors(windows, key[reps[context[own]]], length) >= length
    edge = np.zeros(len(hit) + 2, bool)
    edge[1:-1] = hit
    new = np.ones(len(hit) + 1, bool)
    new[1:-1] = context[1:] != context[:-1]
    opens = np.flatnonzero(edge[1:-1] & (~edge[:-2] | new[:-1]))
    closes = np.flatnonzero(edge[1:-1] & (~edge[2:] | new[1:]))
    return context[opens], offset[opens], offset[closes] + 1


def _match_part(parts: list, length: int):
    """Block, row, first and last window of the runs of windows with an earlier match, for a part of a shard."""
    block = np.concatenate([np.full(len(p[0]), b) for b, p in parts])
    row, key, start, run, anchor, data = (np.concatenate([p[j] for _, p in parts]) for j in range(6))
    parts.clear()
    run = run.astype(np.int64)
    ends = np.cumsum(run + length - 1)
    begins = ends - run - length + 1
    content = np.zeros(len(run), np.uint64)
    at = 0
    while at < len(run):
        stop = max(at + 1, int(np.searchsorted(ends, begins[at] + texts.SLICE_BYTES)))
        hashes = texts.prefix_hashes(data[begins[at]: ends[stop - 1]])
        content[at:stop] = texts.span_hashes(hashes, begins[at:stop] - begins[at], ends[at:stop] - begins[at])
        at = stop
    content ^= texts.mix(anchor.astype(np.uint64) + (run.astype(np.uint64) << np.uint64(32)))
    order = np.lexsort((key, content))
    head = np.ones(len(order), bool)
    head[1:] = content[order[1:]] != content[order[:-1]]
    group = np.cumsum(head) - 1
    reps = order[np.flatnonzero(head)]
    later = key[order] > key[reps][group]
    low, high = [start[order[later]]], [start[order[later]] + run[order[later]]]
    rows, where = [row[order[later]]], [block[order[later]]]

    # Contexts that differ but share their anchor may still share windows.
    chosen = np.flatnonzero(texts.repeated(anchor[reps]))
    chosen = chosen[np.argsort(anchor[reps[chosen]], kind="stable")]
    same = np.flatnonzero(~later)
    member_group, member = group[same], order[same]
    for contexts in _by_anchor(chosen, anchor[reps], run[reps]):
        of, low_off, high_off = _matched(contexts, reps, begins, run, key, data, length)
        # A document may hold a context several times: all of them get what the first was given.
        a, b = np.searchsorted(member_group, of), np.searchsorted(member_group, of, "right")
        times = b - a
        pick = member[np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        low.append(start[pick] + np.repeat(low_off, times))
        high.append(start[pick] + np.repeat(high_off, times))
        rows.append(row[pick])
        where.append(block[pick])
    return tuple(np.concatenate(x) for x in (where, rows, low, high))


def _opened(payload: bytes, number: int, n_parts: int, length: int) -> tuple | None:
    """The contexts of a message whose anchors are of a part."""
    row, key, start, run, anchor, data = blocks.unpack(
        payload, np.int64, np.int32, np.int64, np.int64, np.int32, np.uint32, np.uint8)[1:]
    own = (anchor.astype(np.uint64) * np.uint64(n_parts)) >> np.uint64(32) == np.uint64(number)
    if not own.any():
        return None
    return (*(x[own] for x in (row, key, start, run, anchor)), data[np.repeat(own, run + length - 1)])


@texts.releasing
def _match(table: pa.Table, length: int) -> pa.Table:
    """Step 3, a shard: positions with an earlier match, one row for each block that has any."""
    where, payloads = table["_block"].to_pylist(), table["payload"].to_pylist()
    found = []
    for b, payload in zip(where, payloads, strict=True):
        marks = blocks.unpack(payload, np.int64)[0].reshape(-1, 3)
        found.append((np.full(len(marks), b), *marks.T))
    n_parts = 1 + sum(map(len, payloads)) // PART_BYTES
    for number in range(n_parts):
        parts = [(b, part) for b, payload in zip(where, payloads, strict=True)
                 if (part := _opened(payload, number, n_parts, length))]
        if parts:
            found.append(_match_part(parts, length))
    block, row, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(block, kind="stable")
    block, marks = block[order], np.stack([row[order], low[order], high[order]], 1).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
    rows = [(table["_range"][0].as_py(), int(block[c]), blocks.pack(m))
            for c, m in zip(cuts, np.split(marks, cuts[1:]), strict=True)] if len(cuts) else []
    return _rows(rows)


@texts.releasing
def _cut_out(table: pa.Table, marks: pa.Table, length: int, whole_chars: bool, keep: list[str]) -> pa.Table:
    """Step 4 of a block: spans from marked positions, and what remains of each text."""
    table = blocks.in_order(table)
    raw = [v or b"" for v in table["_text"].to_pylist()]
    spans: list[list[dict]] = [[] for _ in raw]
    if marks.num_rows and raw:
        found = np.concatenate([blocks.unpack(v, np.int64)[0].reshape(-1, 3) for v in marks["payload"].to_pylist()])
        shift = np.int64(1) << _ROW_SHIFT
        low, high = found[:, 0] * shift + found[:, 1], found[:, 0] * shift + found[:, 2] - 1 + length
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order])
        opens = np.ones(len(low), bool)
        opens[1:] = low[1:] > high[:-1]
        at = np.flatnonzero(opens)
        last = np.append(at[1:], len(low)) - 1
        for row, a, b in zip((low[at] // shift).tolist(), (low[at] % shift).tolist(), (high[last] % shift).tolist(),
                             strict=True):
            text = raw[row]
            if whole_chars:
                while a < b and a < len(text) and text[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                    b -= 1
            if a < b:
                spans[row].append({"start": a, "stop": b})
    rest = []
    for text, cuts in zip(raw, spans, strict=True):
        at, pieces = 0, []
        for span in cuts:
            pieces.append(text[at: span["start"]])
            at = span["stop"]
        rest.append(b"".join([*pieces, text[at:]]) if cuts else text)
    ids = table["_id"].to_numpy()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    columns = {"_id": pa.array(ids, pa.int64(), mask=ids == blocks.NO_ID)} | {k: table[k] for k in keep}
    return pa.table(columns | {"spans": pa.array(spans, kind), "kept": pa.array(rest, pa.binary())})


def remove_repeats(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None,
    min_length: int = MIN_LENGTH, gram: int = GRAM, whole_chars: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: the key, the columns ``keep``, ``spans`` (removed byte ranges, maximal) and
    ``kept`` (the remaining bytes). With ``whole_chars``, spans shrink to whole characters, so that ``kept`` is UTF-8.

    The key is an integer; NULL comes after all others and removes nothing from other NULLs, and neither do equal
    keys from each other. A NULL text is empty; a text shorter than ``min_length`` keeps everything. Columns in
    ``keep`` must not be named ``spans`` or ``kept``; those are replaced. An empty table gives no rows.
    """
    keep = [name for name in keep or [] if name not in (key, "spans", "kept")]
    named = [f"_keep{i}" for i in range(len(keep))]
    renamed = docs.select(key, F.col(text).alias("_given"), *[F.col(c).alias(a) for c, a in zip(keep, named, strict=True)])
    blocked = blocks.in_blocks(renamed, key, F.col("_given"), named, PER_PARTITION)
    n = blocks.n_ranges(docs)
    asked = blocked.groupBy("_block").applyInArrow(lambda t: _ask(t, n, min_length, gram), MESSAGE)
    answers = asked.groupBy("_range").applyInArrow(lambda t: _share(t), MESSAGE)
    sent = blocked.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(
        lambda t, a: _send(t, a, n, min_length, gram), MESSAGE)
    marks = sent.groupBy("_range").applyInArrow(lambda t: _match(t, min_length), MESSAGE)
    fields = ", ".join(f"{a} {renamed.schema[a].dataType.simpleString()}" for a in named)
    out = blocked.groupBy("_block").cogroup(marks.groupBy("_block")).applyInArrow(
        lambda t, m: _cut_out(t, m, min_length, whole_chars, named),
        f"_id long, {fields + ', ' if named else ''}spans array<struct<start: bigint, stop: bigint>>, kept binary")
    return out.select(F.col("_id").alias(key), *[F.col(a).alias(c) for c, a in zip(keep, named, strict=True)],
                      "spans", "kept")
