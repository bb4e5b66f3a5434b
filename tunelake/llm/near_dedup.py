"""Near duplicates by weighted MinHash: improved consistent weighted sampling of TF-IDF shingles.

A text is its lower-case words (runs of letters, digits and non-ASCII characters); a shingle is five words in a row,
or all words of a shorter text; a text without words is one shingle, itself. A shingle of count c in the text weighs
``(1 + ln c) * (1 + IDF_SHARE * (1 - ln df / ln N))``. The similarity of two texts is weighted Jaccard: the sum of the
smaller weights over the sum of the larger ones. The mild IDF keeps the meaning of "0.8 or more": copies in a group
of thousands share shingles that the group itself makes frequent, and a steep IDF would part them.

1. Blocks send their shingles' hashes and counts to ranges, which answer with those that several documents have.
2. Each document draws ``BANDS * ROWS`` consistent samples: a shingle of weight w gets a value that falls with w and is
   the same in every document where ``floor(ln w / r + beta)`` is; the least value is the sample. Two documents
   share a sample with probability of their similarity. Variates are drawn from each shingle's own hash.
3. Documents with equal shingles and counts are one node. Nodes that share a band (``ROWS`` samples) form a bucket.
   In a bucket, agreement of all samples gives a spanning forest of candidate pairs; a group's pairs are never
   written out. The forests of all buckets join nodes to candidate components. A bucket of more than a group is cut
   first; then its nodes of different components meet in units as in step 5, so that the cut loses nothing.
4. The vectors of a candidate component meet, each of them sent once. Pairs are verified in the order of their samples'
   agreement unless links join them already: links are pairs whose weighted Jaccard reaches ``threshold``.
   Components and buckets of any size are walked in groups of bounded size that share the most central nodes.
5. In a component of more than a group, pairs that met in no group and that links do not join yet meet in units: each
   tile of nodes outside the largest class with every tile. All of them whose samples agree enough are verified.
6. Classes are the connected components of the links.

Within a candidate component, however large, no link of two classes is lost but by the samples: 0.4 % of the pairs at
0.8 exactly share no band or agree in too few samples, and less above.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.llm import blocks, texts
from tunelake.llm.components import components
from tunelake.llm.components import stored as kept_table

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 10
ROWS = 3
IDF_SHARE = 0.1
DF_BITS = 27
VECTOR_BITS = 28
GROUP = 1024
CENTRAL = 32
PART_NODES = 20_000
PAIRWISE = 8
"""Open pairs for each node of a group from which all its pairs are compared at once, by matrix products."""

MATRIX_BYTES = 8 << 20
"""Packed vectors that are opened at a time for it; groups of longer texts go pair by pair."""

FEATURES = 2048
DOUBT = 0.6
"""Share of equal samples below which no pair is compared; one at 0.8 falls below it in 3 of 1,000 cases."""

_LEVELS_DRAWN = 1 << 16
_LEVELS = 8

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _lowered(table: pa.Table):
    """Slices of the lower-case texts of an opened block."""
    return texts.slices(pc.utf8_lower(table["_text"].combine_chunks().cast(pa.large_string())))


def _shingles(part: texts.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, 48 bits, sorted by text and value: their text, value and count."""
    starts, ends, bounds = part.words(SEPARATOR[part.data])
    hashes = texts.prefix_hashes(part.data)
    words = texts.span_hashes(hashes, starts, ends)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(part.size), n_words)
    windows = texts.window_hashes(words, SHINGLE_WORDS)
    inside = owner[: len(windows)] == owner[SHINGLE_WORDS - 1:] if len(windows) else np.zeros(0, bool)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE_WORDS))
    few = np.zeros(len(short), np.uint64)
    for j in range(SHINGLE_WORDS - 1):
        has = n_words[short] > j
        few[has] = texts.mix(few[has] * np.uint64(31) + words[bounds[short[has]] + j])
    none = np.flatnonzero(n_words == 0)
    whole = texts.mix(texts.span_hashes(hashes, part.offsets[none], part.offsets[none + 1]) + np.uint64(7))
    owners = np.concatenate([owner[: len(windows)][inside], short, none]).astype(np.uint64)
    values = np.concatenate([windows[inside], few, whole]) >> np.uint64(16)
    joined = np.sort((owners << np.uint64(48)) | values)
    first = np.ones(len(joined), bool)
    first[1:] = joined[1:] != joined[:-1]
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(joined)))
    joined = joined[at]
    return (joined >> np.uint64(48)).astype(np.int64), joined & np.uint64((1 << 48) - 1), counts


def _df_keys(values: np.ndarray) -> np.ndarray:
    return texts.mix(values + np.uint64(0x51))


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << DF_BITS) - 1)).astype(np.uint32)


MESSAGE = "_range int, _block int, payload binary"


def _messages(rows) -> pa.Table:
    ps, bs, values = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"_range": pa.array(ps, pa.int32()), "_block": pa.array(bs, pa.int32()),
                     "payload": pa.array(values, pa.binary())})


@texts.releasing
def _ask(table: pa.Table, n: int) -> pa.Table:
    """Step 1 of a block: by range, its shingles' slots and the number of its documents that have each."""
    found = [_df_keys(_shingles(part)[1]) for part in _lowered(blocks.opened(table))]
    keys = np.concatenate(found) if found else np.zeros(0, np.uint64)
    joined, counts = np.unique((blocks.ranges(keys, n) << np.uint64(32)) | _slots(keys), return_counts=True)
    bounds = blocks.cut(joined >> np.uint64(32), n)
    block = table["_block"][0].as_py()
    rows = []
    for p in blocks.filled(bounds):
        a, b = bounds[p], bounds[p + 1]
        slots = blocks.low(joined[a:b])
        several = np.flatnonzero(counts[a:b] > 1)
        rows.append((p, block, blocks.pack(np.diff(slots, prepend=np.uint32(0)), several.astype(np.uint32),
                                           counts[a:b][several].astype(np.uint32))))
    return _messages(rows)


@texts.releasing
def _count(table: pa.Table) -> pa.Table:
    """Step 1 of a range: levels (eighths of log2) of the document counts over one."""
    asked = []
    for value in table["payload"].to_pylist():
        gaps, several, counts = blocks.unpack(value, np.uint32, np.uint32, np.uint32)
        mine = np.ones(len(gaps), np.uint32)
        mine[several] = counts
        asked.append((np.cumsum(gaps, dtype=np.uint32), mine))
    slots, place = np.unique(np.concatenate([s for s, _ in asked]), return_inverse=True)
    total = np.bincount(place, np.concatenate([c for _, c in asked]), len(slots))
    levels = np.rint(_LEVELS * np.log2(total)).astype(np.uint8)
    rows, at, p = [], 0, table["_range"][0].as_py()
    for block, (own, _) in zip(table["_block"].to_pylist(), asked, strict=True):
        found = levels[place[at: at + len(own)]]
        at += len(own)
        shared = found > 0
        if shared.any():
            rows.append((p, block, blocks.pack(own[shared].astype(np.uint32), found[shared])))
    return _messages(rows)


def _answered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The levels that ranges sent to a block, by (range, slot)."""
    keys, levels = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for p, value in zip(table["_range"].to_pylist(), table["payload"].to_pylist(), strict=True):
        if p is not None:
            slots, found = blocks.unpack(value, np.uint32, np.uint8)
            keys.append(slots.astype(np.uint64) | np.uint64(p << 32))
            levels.append(found)
    keys, levels = np.concatenate(keys), np.concatenate(levels)
    order = np.argsort(keys)
    return keys[order], levels[order]


def _levels(values: np.ndarray, answers: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    keys = _df_keys(values)
    wanted = (blocks.ranges(keys, n) << np.uint64(32)) | _slots(keys)
    if not len(answers[0]):
        return np.zeros(len(wanted), np.uint8)
    at = np.minimum(np.searchsorted(answers[0], wanted), len(answers[0]) - 1)
    return np.where(answers[0][at] == wanted, answers[1][at], np.uint8(0))


def _weights(counts: np.ndarray, levels: np.ndarray, n_docs: int) -> np.ndarray:
    rarity = np.maximum(0, 1 - np.arange(256) * (math.log(2) / _LEVELS) / math.log(max(n_docs, 2)))
    return (1 + np.log(counts)) * (1 + IDF_SHARE * rarity)[levels]


def _draws() -> list[np.ndarray]:
    """Quantiles of the gamma variates of consistent weighted sampling, as r and 1/r, and the logarithm of c."""
    draw = np.random.default_rng(77)
    r = draw.gamma(2.0, 1.0, _LEVELS_DRAWN)
    return [x.astype(np.float32) for x in (1 / r, r, np.log(draw.gamma(2.0, 1.0, _LEVELS_DRAWN)))]


def _samples(values: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Samples (texts x size) as the bits of the least value: that value depends on the shingle's variates and
    ``t = floor(ln w / r + beta)`` only, so it names the sample.

    A shingle draws r, c and beta for each sample from 48 bits of its own hash, 16 for each, so that no two shingles
    share their variates but by chance, however many a text has.
    """
    inverse, r, ln_c = texts.worker_cache("cws_draws", _draws)
    logs = np.log(weights).astype(np.float32)
    out = np.empty((size, len(starts)), np.float32)
    low = np.uint64(_LEVELS_DRAWN - 1)
    for k in range(size):
        bits = texts.mix(values + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
        one, two = (bits & low).astype(np.int64), ((bits >> np.uint64(16)) & low).astype(np.int64)
        beta = ((bits >> np.uint64(32)) & low).astype(np.float32) * np.float32(1 / _LEVELS_DRAWN)
        t = np.floor(logs * inverse[one] + beta)
        out[k] = np.minimum.reduceat(ln_c[two] + r[one] * (beta - 1 - t), starts)
    return (out.T + np.float32(0)).copy().view(np.uint32)


def _documents(table: pa.Table):
    """For each slice of a block: its texts' bounds in the shingles, values and counts."""
    for part in _lowered(table):
        owner, values, counts = _shingles(part)
        starts = np.searchsorted(owner, np.arange(part.size + 1))
        yield part.first, part.size, starts, values, counts


def _digest(values: np.ndarray, counts: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes() + counts.astype(np.int64).tobytes(), digest_size=16).digest()


@texts.releasing
def _sketch(table: pa.Table, answers: pa.Table, n: int, n_docs: int, bands: int, rows: int) -> pa.Table:
    """Step 2 of a block: each document's node (digest of its vector) and its samples, 16 bits of each."""
    if not table.num_rows:
        return pa.table({"_id": pa.array([], pa.int64()), "node": pa.array([], pa.binary()),
                         "samples": pa.array([], pa.binary())})
    known = _answered(answers)
    nodes, samples = [], []
    for _, _, starts, values, counts in _documents(blocks.opened(table)):
        weights = _weights(counts, _levels(values, known, n), n_docs)
        drawn = _samples(values, weights, starts[:-1], bands * rows)
        samples.append((texts.mix(drawn.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16))
        nodes += [_digest(values[a:b], counts[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    samples = np.concatenate(samples)
    return pa.table({"_id": table["_id"], "node": pa.array(nodes, pa.binary()),
                     "samples": pa.array([row.tobytes() for row in samples], pa.binary())})


def _band_keys(samples: pa.Array, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of 16-bit samples."""
    drawn = np.frombuffer(b"".join(samples.to_pylist()), np.uint16).reshape(-1, bands, rows).astype(np.uint64)
    keys = np.empty(drawn.shape[:2], np.uint64)
    for b in range(bands):
        total = np.full(len(drawn), b + 1, np.uint64)
        for j in range(rows):
            total = total * np.uint64(0x9E3779B97F4A7C15) + drawn[:, b, j] + np.uint64(1)
        keys[:, b] = texts.mix(total)
    return keys.view(np.int64)


def _members(
    batches: Iterator[pa.RecordBatch], bands: int, rows: int, also: tuple[str, ...] = (),
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = _band_keys(batch.column("samples"), bands, rows)
            again = pa.array(np.repeat(np.arange(len(keys)), bands))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name).take(again) for name in ("node", *also)), pa.array(keys.ravel())],
                names=["node", *also, "band"])


PLACED = "band long, part int, node binary, _id long, met long, n long, samples binary"


def _placed(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """A node's rows in the buckets that it shares. A bucket of many nodes is cut by the band that follows, in which
    similar ones mostly agree, and beyond ``PART_NODES`` by chance; those that the cut keeps apart meet later."""
    for batch in batches:
        out = []
        if batch.num_rows:
            keys = _band_keys(batch.column("samples"), bands, rows)
            for row, own in zip(batch.to_pylist(), keys.tolist(), strict=True):
                for bucket in row["buckets"]:
                    part = 0
                    if bucket["n"] > GROUP:
                        following = own[(own.index(bucket["band"]) + 1) % bands]
                        part = hash((following, row["_id"] % -(-bucket["n"] // PART_NODES))) % (1 << 31)
                    out.append({"band": bucket["band"], "part": part, "node": row["node"], "_id": row["_id"],
                                "met": row["met"], "n": bucket["n"], "samples": row["samples"]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([
            ("band", pa.int64()), ("part", pa.int32()), ("node", pa.binary()), ("_id", pa.int64()),
            ("met", pa.int64()), ("n", pa.int64()), ("samples", pa.binary())]))


def _forest(rows: list[tuple], least: int) -> Iterator[tuple[int, int]]:
    """Pairs (parent, child) of a spanning forest of greatest agreement of samples, in a group sorted by how central
    its nodes are (the more central parent if agreement is equal)."""
    m = len(rows)
    if m == 2:
        yield 0, 1
        return
    drawn = np.frombuffer(b"".join(row[6] for row in rows), np.uint16).reshape(m, -1)
    agree = np.zeros((m, m), np.int32)
    for k in range(drawn.shape[1]):
        agree += drawn[:, k, None] == drawn[None, :, k]
    np.fill_diagonal(agree, -1)
    worth = agree * (2 * m) - np.arange(m)[:, None]
    floor = least * 2 * m - m
    joined = np.zeros(m, bool)
    joined[0] = True
    best, parent = worth[0].copy(), np.zeros(m, np.int64)
    for _ in range(m - 1):
        child = int(np.argmax(np.where(joined, -(1 << 30), best)))
        if best[child] >= floor:
            yield int(parent[child]), child
        joined[child] = True
        better = worth[child] > best
        best[better], parent[better] = worth[child][better], child


def _candidates(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    """Walks buckets (rows come sorted by bucket, central nodes first) in groups of ``GROUP`` nodes; the most central
    nodes of a bucket are in all its groups."""
    least = int(DOUBT * samples)
    group: list[tuple] = []
    fresh, out = 0, []

    def close():
        if len(group) > 1 and fresh:
            label = np.arange(len(group))
            for parent, child in _forest(group, least):
                label[label == label[child]] = label[parent]
            out.extend(_stars([row[2] for row in group], label))

    def table():
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()),
                                           pa.array([x[1] for x in out], pa.binary())], names=["a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[0][:2] != row[:2]:
                close()
                group, fresh = [], 0
            elif len(group) >= GROUP:
                close()
                group, fresh = group[:CENTRAL], 0
            group.append(row)
            fresh += 1
        if out:
            yield table()
            out.clear()
    close()
    if out:
        yield table()


ASKED = "root binary, part int, home_n long, home_band long, met long, node binary, samples binary"
UNIT = "root binary, low long, high long, tile long, class binary, node binary, samples binary"


@texts.releasing
def _vectors(table: pa.Table, given: pa.Table, n: int, shown: list[str]) -> pa.Table:
    """Steps 4 and 5 of a block: the vectors that are asked for, with what the request says about them."""
    asked = given.filter(pc.is_null(given["_range"])).select([*shown, "_id"])
    wanted: dict[bytes, list[dict]] = {}
    for row in asked.to_pylist():
        wanted.setdefault(row["node"], []).append(row)
    out = []
    if wanted:
        known = _answered(given)
        rows = table.filter(pc.is_in(table["_id"], asked["_id"].combine_chunks()))
        for _, _, starts, values, counts in _documents(blocks.opened(rows)):
            levels = _levels(values, known, n)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                node = _digest(values[a:b], counts[a:b])
                requests = wanted.pop(node, ())
                if requests:
                    short = (values[a:b] & np.uint64((1 << VECTOR_BITS) - 1)).astype(np.uint32)
                    order = np.argsort(short, kind="stable")
                    vector = blocks.pack(np.diff(short[order], prepend=np.uint32(0)),
                                         counts[a:b][order].astype(np.uint32), levels[a:b][order])
                    out += [{key: row[key] for key in shown} | {"payload": vector} for row in requests]
    return pa.Table.from_pylist(out, pa.schema(
        [asked.schema.field(key) for key in shown] + [pa.field("payload", pa.binary())]))


class _Vectors:
    """The weighted vectors of a group, opened as they are needed."""

    def __init__(self, payloads: list[bytes], n_docs: int):
        self.payloads, self.n_docs, self.known = payloads, n_docs, {}

    def get(self, i: int):
        if i not in self.known:
            gaps, counts, levels = blocks.unpack(self.payloads[i], np.uint32, np.uint32, np.uint8)
            weights = _weights(counts, levels, self.n_docs)
            self.known[i] = np.cumsum(gaps, dtype=np.int64), weights, weights.sum()
        return self.known[i]

    def similarity(self, i: int, j: int) -> float:
        """Weighted Jaccard of the whole vectors."""
        (a, wa, ta), (b, wb, tb) = self.get(i), self.get(j)
        at = np.minimum(np.searchsorted(a, b), len(a) - 1)
        hit = a[at] == b
        shared = np.minimum(wb[hit], wa[at[hit]]).sum()
        return shared / (ta + tb - shared)


    def all_similarities(self) -> np.ndarray:
        """Weighted Jaccard of all pairs of the group by matrix products.

        A shingle of count c is c features: its weight grows by a step with each count, and the smaller of two weights
        is the sum of the steps that both have. Features that one node has alone add to totals only.
        """
        names, steps, nodes, n = [], [], [], len(self.payloads)
        for i, payload in enumerate(self.payloads):
            gaps, counts, levels = blocks.unpack(payload, np.uint32, np.uint32, np.uint8)
            counts = counts.astype(np.int64)
            at = np.repeat(np.arange(len(counts)), counts)
            step = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            names.append(np.cumsum(gaps, dtype=np.int64)[at] + (step << VECTOR_BITS))
            grown = np.where(step > 1, np.log(step / np.maximum(step - 1, 1)), 1.0)
            steps.append(grown * _weights(np.ones(len(counts)), levels, self.n_docs)[at])
            nodes.append(np.full(len(at), i))
        names, steps, nodes = np.concatenate(names), np.concatenate(steps), np.concatenate(nodes)
        total = np.bincount(nodes, steps, n)
        order = np.argsort(names, kind="stable")
        head = np.append(True, names[order][1:] != names[order][:-1])
        several = np.diff(np.append(np.flatnonzero(head), len(order))) > 1
        column = np.cumsum(head) - 1
        kept = several[column]
        order, column = order[kept], (np.cumsum(several) - 1)[column[kept]]
        shared = np.zeros((n, n))
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, FEATURES):
            a, b = np.searchsorted(column, (low, low + FEATURES))
            dense = np.zeros((n, FEATURES))
            dense[nodes[order[a:b]], column[a:b] - low] = np.sqrt(steps[order[a:b]])
            shared += dense @ dense.T
        return shared / (total[:, None] + total[None, :] - shared)


def _verified_joins(payloads: list[bytes], n_docs: int, threshold: float, first, second, label) -> Iterator[tuple[int, int]]:
    """Open pairs that reach the threshold and join two labels. Many pairs are compared all at once."""
    vectors = _Vectors(payloads, n_docs)
    if len(first) > PAIRWISE * len(payloads) and sum(map(len, payloads)) <= MATRIX_BYTES:
        sure = vectors.all_similarities()[first, second] >= threshold - 1e-9
        yield from _joins(first[sure], second[sure], label, lambda i, j: True)
    else:
        yield from _joins(first, second, label, lambda i, j: vectors.similarity(i, j) >= threshold - 1e-9)


def _group_links(group: list[tuple], n_docs: int, threshold: float) -> list[tuple[bytes, bytes]]:
    """What the links of a group join, as links to the smallest node: pairs are verified in the order of their samples'
    agreement, unless earlier links join the two already."""
    label = np.arange(len(group))
    first, second = _open_pairs([row[6] for row in group], label)
    for _ in _verified_joins([row[7] for row in group], n_docs, threshold, first, second, label):
        pass
    return _stars([row[5] for row in group], label)


def _open_pairs(samples: list[bytes], label: np.ndarray, tile: np.ndarray | None = None):
    """Pairs of different labels (and tiles, if there are several) whose samples agree enough, best agreement first."""
    drawn = np.frombuffer(b"".join(samples), np.uint16).reshape(len(samples), -1)
    agree = np.zeros((len(drawn), len(drawn)), np.int16)
    for k in range(drawn.shape[1]):
        agree += drawn[:, k, None] == drawn[None, :, k]
    may = np.triu(agree >= int(DOUBT * drawn.shape[1]), 1) & (label[:, None] != label[None, :])
    if tile is not None and tile.min() != tile.max():
        may &= tile[:, None] != tile[None, :]
    first, second = np.nonzero(may)
    order = np.argsort(-agree[first, second], kind="stable")
    return first[order], second[order]


def _joins(first: np.ndarray, second: np.ndarray, label: np.ndarray, sure) -> Iterator[tuple[int, int]]:
    """Pairs that are sure and join two labels; joins them in ``label``."""
    for at in range(0, len(first), 4096):
        some, others = first[at: at + 4096], second[at: at + 4096]
        apart = np.flatnonzero(label[some] != label[others])
        for i, j in zip(some[apart].tolist(), others[apart].tolist(), strict=True):
            if label[i] != label[j] and sure(i, j):
                label[label == label[j]] = label[i]
                yield i, j


def _stars(nodes: list[bytes], label: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Every node of a class linked to its smallest one, so that later rounds over links stay few."""
    classes: dict[int, list[bytes]] = {}
    for node, one in zip(nodes, label.tolist(), strict=True):
        classes.setdefault(one, []).append(node)
    return [(low, node) for members in classes.values() if len(members) > 1 for low in [min(members)]
            for node in members if node != low]


def _linked(batches: Iterator[pa.RecordBatch], n_docs: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Walks candidate components in groups of ``GROUP`` nodes. Nodes come by their largest bucket, so that similar
    ones stay together, and the largest of these first: its most central nodes are in all groups."""
    group: list[tuple] = []
    links: list[tuple[bytes, bytes]] = []

    def table():
        found = pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()),
                                            pa.array([x[1] for x in links], pa.binary())], names=["a", "b"])
        links.clear()
        return found

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[0][:2] != row[:2]:
                links += _group_links(group, n_docs, threshold)
                group = []
            elif len(group) >= GROUP:
                links += _group_links(group, n_docs, threshold)
                group = group[:CENTRAL]
            group.append(row)
        if links:
            yield table()
    if len(group) > 1:
        links += _group_links(group, n_docs, threshold)
    yield table()


def _same(batches):
    yield from batches


def _units(rows: DataFrame, by: str) -> DataFrame:
    """Deals the nodes of each ``by`` to units (``low``, ``high``) of about ``GROUP`` nodes, so that every two nodes of
    different classes meet in one unit. The nodes of the largest class need not meet each other; where there is no other
    class, there are no units."""
    half = max(GROUP // 2, 1)
    n = rows.groupBy(by, "class").agg(F.count("*").alias("n"))
    n = n.groupBy(by).agg(F.sum("n").alias("whole"), F.max(F.struct("n", "class")).alias("most")).where("whole > most.n")
    few = F.col("whole") <= GROUP
    sizes = n.select(by, F.col("most.class").alias("main"),
                     F.when(few, 1).otherwise(F.ceil((F.col("whole") - F.col("most.n")) / half)).alias("rests"),
                     F.when(few, 0).otherwise(F.ceil(F.col("most.n") / half)).alias("mains"))
    drawn = F.xxhash64("node", F.lit(5))
    main = (F.col("class") == F.col("main")) & (F.col("mains") > 0)
    tile = F.when(main, F.col("rests") + F.pmod(drawn, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(drawn, "rests"))
    last = F.when(F.col("tile") < F.col("rests"), F.col("rests") + F.col("mains")).otherwise(F.col("rests")) - 1
    return rows.join(sizes, by).withColumn("tile", tile).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumns(
        {"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("main", "rests", "mains", "other")


def _by_unit(units: DataFrame, by: str, partitions: int) -> DataFrame:
    return units.repartition(partitions, by, "low", "high").sortWithinPartitions(by, "low", "high", "node")


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one unit after the other: by, low, high, tile, class, node, samples and more."""
    unit: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if unit and unit[0][:3] != row[:3]:
                yield unit
                unit = []
            unit.append(row)
    if unit:
        yield unit


def _unit_pairs(unit: list[tuple]):
    """The open pairs of a unit, and its rows' labels by class."""
    label = np.unique(np.array([row[4].hex() for row in unit]), return_inverse=True)[1]
    return *_open_pairs([row[6] for row in unit], label, np.array([row[3] for row in unit])), label


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs that join the candidate components of a unit."""
    for unit in _unit_rows(batches):
        first, second, label = _unit_pairs(unit)
        found = [(unit[i][5], unit[j][5]) for i, j in _joins(first, second, label, lambda i, j: True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()),
                                          pa.array([x[1] for x in found], pa.binary())], names=["a", "b"])


def _doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit that are in an open pair."""
    for unit in _unit_rows(batches):
        first, second, _ = _unit_pairs(unit)
        if len(first):
            rows = [unit[i] for i in np.union1d(first, second)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), (
                    pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()),
                    strict=True)], names=["root", "low", "high", "tile", "class", "node", "samples", "_id"])


def _verified(batches: Iterator[pa.RecordBatch], n_docs: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links that join classes in a unit; every open pair is verified unless links join it already."""
    for unit in _unit_rows(batches):
        first, second, label = _unit_pairs(unit)
        found = [(unit[i][5], unit[j][5]) for i, j in _verified_joins(
            [row[7] for row in unit], n_docs, threshold, first, second, label)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()),
                                          pa.array([x[1] for x in found], pa.binary())], names=["a", "b"])


def _rooted(
    docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """``_id``, ``node`` and the ``root`` of its class for every row."""
    n, n_docs = blocks.n_ranges(docs), docs.count()
    blocked = blocks.in_blocks(docs, key, F.col(text), [])
    asked = blocked.groupBy("_block").applyInArrow(lambda t: _ask(t, n), MESSAGE)
    answers = asked.groupBy("_range").applyInArrow(lambda t: _count(t), MESSAGE).repartition(
        blocks.partitions(docs), "_block")
    schema = "_id long, node binary, samples binary"
    sketched = blocked.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(
        lambda t, a: _sketch(t, a, n, n_docs, bands, rows), schema)
    # Several steps read this shuffle; a Python step above it keeps Spark from cutting it differently for each.
    dealt = sketched.repartition(blocks.partitions(docs), "_id")
    nodes = dealt.mapInArrow(_same, schema).groupBy("node").agg(
        F.min("_id").alias("_id"), F.max("samples").alias("samples"))
    members = nodes.mapInArrow(lambda b: _members(b, bands, rows), "node binary, band long")
    shared = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    central = members.join(shared, "band").groupBy("node").agg(
        F.sum("n").alias("met"), F.max(F.struct("n", "band")).alias("home"),
        F.collect_list(F.struct("band", "n")).alias("buckets"))
    placed = nodes.join(central, "node").mapInArrow(lambda b: _placed(b, bands, rows), PLACED)
    found = placed.repartition(blocks.partitions(docs), "band", "part").sortWithinPartitions(
        "band", "part", F.col("met").desc(), "node").mapInArrow(
        lambda b: _candidates(b, bands * rows), "a binary, b binary").distinct()
    stored = kept_table(
        answers.mapInArrow(_same, MESSAGE).withColumn("kind", F.lit("answer"))
        .unionByName(dealt.mapInArrow(_same, schema).select("_id", "node", F.lit("row").alias("kind")), True)
        .unionByName(nodes.join(central, "node").select(
            "_id", "node", "samples", "met", "home", F.lit("met").alias("kind")), True)
        .unionByName(found.withColumn("kind", F.lit("pair")), True))

    # Step 4: the vectors of a candidate component meet once.
    apart = components(stored.where("kind = 'pair'").select("a", "b"))
    crowded = stored.where("kind = 'met'").where(F.col("home.n") > GROUP).select("node", "samples")
    if not crowded.isEmpty():
        # Nodes of buckets of more than a group that did not meet, as such buckets are cut above.
        crowded = crowded.join(apart, "node", "left").select(
            "node", "samples", F.coalesce("root", "node").alias("class")).mapInArrow(
            lambda b: _members(b, bands, rows, ("samples", "class")), "node binary, samples binary, class binary, band long")
        large = crowded.join(crowded.groupBy("band").count().where(F.col("count") > GROUP), "band")
        more = _by_unit(_units(large, "band"), "band", blocks.partitions(docs)).select(
            "band", "low", "high", "tile", "class", "node", "samples").mapInArrow(_agreeing, "a binary, b binary")
        apart = components(apart.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    placed = apart.unionByName(apart.select(F.col("root").alias("node"), "root").distinct()).join(
        stored.where("kind = 'met'").select("node", "_id", "samples", "met", "home"), "node")
    whole = F.struct("node", "_id", "samples", "met", "home")
    sizes = placed.groupBy("root").agg(F.ceil(F.count("*") / PART_NODES).alias("parts"),
                                       F.max_by(whole, F.struct("met", "node")).alias("hub"))
    own = placed.join(sizes, "root").select(
        "root", F.pmod(F.xxhash64("home"), "parts").cast("int").alias("part"), "node", "_id", "samples", "met", "home")
    hubs = sizes.where("parts > 1").select(
        "root", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), "hub.*")
    requests = own.unionByName(hubs).distinct().select("*", F.col("home.n").alias("home_n"), F.col("home.band").alias(
        "home_band")).drop("home").withColumn("_block", blocks.block_of(
        F.col("_id"), blocks.partitions(docs) * blocks.BLOCKS_PER_PARTITION))
    given = stored.where("kind = 'answer'").select("_range", "_block", "payload").unionByName(requests, True)
    said = [name.split()[0] for name in ASKED.split(", ")]
    vectors = blocked.groupBy("_block").cogroup(given.groupBy("_block")).applyInArrow(
        lambda t, g: _vectors(t, g, n, said), ASKED + ", payload binary")
    links = kept_table(vectors.repartition(blocks.partitions(docs), "root", "part").sortWithinPartitions(
        "root", "part", F.col("home_n").desc(), "home_band", F.col("met").desc(), "node").mapInArrow(
        lambda b: _linked(b, n_docs, threshold), "a binary, b binary"))

    roots = components(links)

    # Step 5: pairs of large components that did not meet above.
    large = placed.join(placed.groupBy("root").count().where(F.col("count") > GROUP), "root").select(
        "root", "node", "_id", "samples").join(roots.withColumnRenamed("root", "class"), "node", "left").withColumn(
        "class", F.coalesce("class", "node"))
    shown = [name.split()[0] for name in UNIT.split(", ")]
    doubtful = kept_table(_by_unit(_units(large, "root"), "root", blocks.partitions(docs)).select(*shown, "_id").mapInArrow(
        _doubtful, UNIT + ", _id long"))
    if not doubtful.isEmpty():
        given = stored.where("kind = 'answer'").select("_range", "_block", "payload").unionByName(
            doubtful.withColumn("_block", blocks.block_of(
                F.col("_id"), blocks.partitions(docs) * blocks.BLOCKS_PER_PARTITION)), True)
        met = blocked.groupBy("_block").cogroup(given.groupBy("_block")).applyInArrow(
            lambda t, g: _vectors(t, g, n, shown), UNIT + ", payload binary")
        more = _by_unit(met, "root", blocks.partitions(docs)).mapInArrow(
            lambda b: _verified(b, n_docs, threshold), "a binary, b binary")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    rows_ = stored.where("kind = 'row'").select("node", "_id")
    return rows_.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "node", "_id")


@texts.releasing
def _pick(table: pa.Table, kept: pa.Table, keep: list[str]) -> pa.Table:
    """The rows of a block that stay: the first row of each kept (key, node)."""
    nodes: dict[int, set[bytes]] = {}
    for number, node in zip(kept["_id"].to_pylist(), kept["node"].to_pylist(), strict=True):
        nodes.setdefault(number, set()).add(node)
    rows = np.flatnonzero(pc.is_in(table["_id"], pa.array(sorted(nodes), pa.int64())).to_numpy(zero_copy_only=False))
    numbers = table["_id"].to_numpy()[rows]
    several = texts.repeated(numbers)
    chosen = rows[~several].tolist()
    unsure = blocks.opened(table.take(pa.array(rows[several], pa.int64())))
    if unsure.num_rows:
        digests = [_digest(values[a:b], counts[a:b]) for _, _, starts, values, counts in _documents(unsure)
                   for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for row, number, digest in zip(rows[several].tolist(), numbers[several].tolist(), digests, strict=True):
            if digest in nodes[number]:
                nodes[number].discard(digest)
                chosen.append(row)
    found = blocks.opened(table.take(pa.array(sorted(chosen), pa.int64()))).select(keep)
    place = found.schema.get_field_index("_text")
    return found.set_column(place, "_text", found["_text"].cast(pa.binary()))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` with one row of each class of :func:`classes` (that of the smallest key, of repeated rows
    one), and all their columns. Texts are shuffled once, by block."""
    rooted = _rooted(docs, key, text, **settings)
    kept = rooted.groupBy("root").agg(F.min(F.struct("_id", "node")).alias("first")).select(
        "first.*", blocks.block_of(F.col("first._id"), blocks.partitions(docs) * blocks.BLOCKS_PER_PARTITION)
        .alias("_block"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(name).alias(alias) for name, alias in zip(docs.columns, names, strict=True)])
    at = dict(zip(docs.columns, names, strict=True))
    rest = [name for name in names if name != at[text]]
    shown = ["_text" if name == at[text] else name for name in names]
    blocked = blocks.in_blocks(plain, at[key], F.col(at[text]), rest)
    schema = ", ".join(f"{name} {blocked.schema[name].dataType.simpleString()}" for name in shown)
    picked = blocked.groupBy("_block").cogroup(kept.groupBy("_block")).applyInArrow(
        lambda t, k: _pick(t, k, shown), schema)
    return picked.select(*[F.col(name).cast(docs.schema[given].dataType).alias(given)
                           for name, given in zip(shown, docs.columns, strict=True)])


def classes(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: the key, ``class_id`` (the smallest key of its class), ``n_class`` (rows in the
    class) and ``copy`` (0 for the one row to keep of each class).

    Keys are integers; a NULL key comes last. Empty and NULL texts are one class; texts without words are copies only
    if equal in lower case. Repeated rows are copies. Other columns are left out; an empty table gives no rows.
    """
    rooted = _rooted(docs, key, text, threshold, bands, rows)
    summed = rooted.groupBy("root").agg(F.count("*").alias("n_class"), F.min(F.struct("_id", "node")).alias("first"))
    out = rooted.join(summed, "root")
    keeper = (F.col("_id") == F.col("first._id")) & (F.col("node") == F.col("first.node"))
    shown = F.when(F.col("_id") != F.lit(int(blocks.NO_ID)), F.col("_id"))
    first = F.when(F.col("first._id") != F.lit(int(blocks.NO_ID)), F.col("first._id"))
    return out.select(shown.alias(key), first.alias("class_id"), "n_class", (~keeper).cast("int").alias("copy"))
