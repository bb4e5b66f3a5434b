"""Byte-level BPE by longest matches and backtracking, with exactly the merges of a rank file.

The vocabulary is an Aho-Corasick automaton over bytes read as Latin-1. One pass over a piece gives the longest token
that starts at each byte. The encoder takes longest matches from left to right; a token may follow another only if
the merges themselves would leave the two beside each other, which is decided by undoing the merges of both at their
border and remembered per pair. Where no token fits, the last one is taken back and a shorter prefix of it tried;
a position found impossible is never entered again, so that the work is linear in the length of the piece.
The short pieces of a batch that are new take these steps side by side in arrays; a long one takes them alone.

Ranks are read by the driver and sent to the tasks; they are as many as the vocabulary has tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tunelake.llm.texts import release, worker_cache

MEMO_ENTRIES = 200_000
ROWS = 500
"""Texts encoded at a time."""
MEMO_CHARS = 64
SIDE_BY_SIDE = 20_000
"""Pieces encoded at a time."""
SHORT_BYTES = 256
"""A longer piece is encoded alone."""
DECODED = 1 << 18
"""Ids decoded at a time."""
SLOT_BITS = 20
_HASH = 0x9E3779B97F4A7C15
_NO_PAIR = (1 << 63) - 1

WHITE = frozenset("\t\n\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
"""Unicode white space but the space itself."""
_UNCUT = re.compile(rf" (?:[ {''.join(sorted(WHITE))}]|\Z)").search


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token (base64) and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the items of runs, one run after another."""
    before = np.cumsum(counts) - counts
    return np.repeat((starts - before).astype(np.int32), counts) + np.arange(counts.sum(), dtype=np.int32)


class _Memo:
    """Ids of texts, which are numbered as they come. The most used short ones stay when there are too many."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers, self.chars = defaultdict(count().__next__), 0
        self.starts, self.counts, self.used = np.zeros((3, 0), np.int64)
        self.ids = np.zeros(0, np.int32)

    def number(self, texts: Iterable[str], size: int) -> tuple[np.ndarray, list[str]]:
        """Numbers of the ``size`` texts, and those that are new, in the order of their numbers."""
        known = len(self.numbers)
        numbers = np.fromiter(map(self.numbers.__getitem__, texts), np.int64, size)
        new = list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
        self.chars += sum(map(len, new))
        self.starts, self.counts, self.used = (
            np.concatenate([kept, np.zeros(len(new), np.int64)]) for kept in (self.starts, self.counts, self.used))
        self.used += np.bincount(numbers, minlength=len(self.used))
        return numbers, new

    def add(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Notes the ids of the texts of these numbers, given one text after another."""
        self.starts[numbers], self.counts[numbers] = len(self.ids) + np.cumsum(counts) - counts, counts
        self.ids = np.concatenate([self.ids, ids])

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these texts, one text after another, and how many each has."""
        counts = self.counts[numbers]
        return self.ids[_places(self.starts[numbers], counts)], counts

    def shrink(self) -> None:
        """Called between batches, when no number is in use."""
        if len(self.numbers) <= MEMO_ENTRIES and self.chars <= MEMO_ENTRIES * MEMO_CHARS // 2:
            return
        short = np.fromiter(map(len, self.numbers), np.int64, len(self.numbers)) <= MEMO_CHARS
        stay = np.flatnonzero(short & (self.used > 1))
        stay = np.sort(stay[np.argsort(-self.used[stay], kind="stable")[:MEMO_ENTRIES // 2]])
        texts = list(self.numbers)
        texts, (ids, counts), used = [texts[i] for i in stay.tolist()], self.get(stay), self.used[stay] // 2
        self.clear()
        self.number(texts, len(texts))
        self.add(np.arange(len(texts)), ids, counts)
        self.used = used


class ByteBpe:
    """Encoder and decoder of one vocabulary. ``pattern`` cuts a text into pieces that are encoded apart."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern)
        self._fits: dict[int, bool] = {}
        self._build()
        self._tables()
        self.piece_ids, self.chunk_ids = _Memo(), _Memo()

    def _build(self) -> None:
        """Finds the last merge of each token, from short ranks to long. A token that its own bytes do not merge
        to can only be a whole piece and is left out of the automaton."""
        self.halves, self.merged, self.shorter, self.whole_only = {}, {}, {}, set()
        trie = ahocorasick.Automaton()
        for token, rank in sorted(self.ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                self.halves[rank] = None
            else:
                pair = self._last_merge(token, rank)
                if pair is None:
                    self.whole_only.add(token)
                    continue
                self.halves[rank] = pair
                self.merged[pair] = rank
            trie.add_word(token.decode("latin-1"), rank)
        for rank in self.halves:
            token = self.tokens[rank]
            for end in range(len(token) - 1, 0, -1):
                prefix = self.ranks.get(token[:end])
                if prefix in self.halves:
                    self.shorter[rank] = prefix
                    break
        trie.make_automaton()
        self.trie = trie

    def _tables(self) -> None:
        """Lengths, shorter prefixes and merges as arrays by rank; -1 is none."""
        self.size = max(self.ranks.values(), default=0) + 1
        self.length, self.cut, self.left, self.right = np.full((4, self.size), -1, np.int64)
        for rank, halves in self.halves.items():
            self.length[rank], self.cut[rank] = self.lengths[rank], self.shorter.get(rank, -1)
            self.left[rank], self.right[rank] = halves or (-1, -1)
        merged = sorted((a * self.size + b, rank) for (a, b), rank in self.merged.items())
        self.pairs, self.pair_ranks = np.array([*merged, (_NO_PAIR, -1)], np.int64).T.copy()
        self._pair_fits = np.full(1 << SLOT_BITS, -1, np.int64)

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        for end in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:end]), self.ranks.get(token[end:])
            if left in self.halves and right in self.halves and max(left, right) < rank and self.fits(left, right):
                return left, right
        return None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens beside each other. Undoes merges at the border, the later one
        first; if some pair there would have merged before, the border would not exist."""
        a, b, limit = left, right, float("inf")
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            undo_left = self.halves[a] and (a > b or not self.halves[b])
            if undo_left:
                limit, a = a, self.halves[a][1]
            elif self.halves[b]:
                limit, b = b + 1, self.halves[b][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        letters = piece.decode("latin-1")
        longest = [0] * len(letters)
        lengths, shorter, known = self.lengths, self.shorter, self._fits
        for end, rank in self.trie.iter(letters):
            longest[end + 1 - lengths[rank]] = rank
        blocked = bytearray(len(letters) + 1)
        ids: list[int] = []
        at, token, last, size = 0, longest[0], -1, len(letters)
        while True:
            end = at + lengths[token]
            if not blocked[end]:
                pair = last << 32 | token
                fit = known.get(pair)
                if fit is None:
                    if len(known) >= MEMO_ENTRIES:
                        known.clear()
                    fit = known[pair] = last < 0 or self.fits(last, token)
                if fit:
                    ids.append(token)
                    if end == size:
                        return ids
                    at, last = end, token
                    token = longest[at]
                    continue
            token = shorter.get(token)
            while token is None:
                blocked[at] = 1
                ids.pop()
                at -= lengths[last]
                token = shorter.get(last)
                last = ids[-1] if ids else -1

    def _fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`fits` of many pairs."""
        fit, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), self.size)
        while len(live):
            pair = a * self.size + b
            at = np.searchsorted(self.pairs, pair)
            merges = (self.pairs[at] == pair) & (self.pair_ranks[at] < limit)
            fit[live[merges]] = False
            whole_a, whole_b = self.left[a] < 0, self.left[b] < 0
            on = np.flatnonzero(~merges & ~(whole_a & whole_b))
            undo_left = (~whole_a & ((a > b) | whole_b))[on]
            live, a, b = live[on], a[on], b[on]
            limit = np.where(undo_left, a, b + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return fit

    def _known_fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`fits` of many pairs, each remembered in the slot of its hash until another pair takes it."""
        pair = a * self.size + b
        slot = (pair.astype(np.uint64) * np.uint64(_HASH) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        kept = self._pair_fits[slot]
        fit = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != pair)
        if len(new):
            _, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
            first = new[first]
            found = self._fit_all(a[first], b[first])
            fit[new] = found[back]
            self._pair_fits[slot[first]] = pair[first] << 1 | found
        return fit

    def _one_by_one(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(self.encode_piece(piece), np.int32) for piece in pieces]
        return np.concatenate([np.zeros(0, np.int32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _side_by_side(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one piece after another, and how many each has: the steps of :meth:`encode_piece`, each taken
        by all pieces that have not reached their end. ``ids`` has room for a piece's ids from its first byte on."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stop = np.cumsum(sizes)
        first = starts = stop - sizes
        letters = b"".join(pieces).decode("latin-1")
        end, rank = np.fromiter(chain.from_iterable(self.trie.iter(letters)), np.int32).reshape(-1, 2).T
        begin = end + 1 - self.length[rank]
        inside = np.flatnonzero(begin >= np.repeat(starts, sizes)[end])
        longest = np.zeros(len(letters) + 1, np.int64)
        longest[begin[inside]] = rank[inside]  # matches come by their ends, so the longest stays
        blocked, ids = np.zeros(len(letters) + 1, bool), np.zeros(len(letters), np.int32)
        counts, live = np.zeros(len(pieces), np.int64), np.arange(len(pieces))
        at, top, token, last = starts.copy(), starts.copy(), longest[starts], np.full(len(pieces), -1)
        while len(live):
            end = at + self.length[token]
            good = ~blocked[end]
            follow = np.flatnonzero(good & (last >= 0))
            good[follow] = self._known_fits(last[follow], token[follow])
            take, leave = np.flatnonzero(good), np.flatnonzero(~good)
            ids[top[take]] = last[take] = token[take]
            top[take] += 1
            at[take] = end[take]
            token[take] = longest[end[take]]
            token[leave] = self.cut[token[leave]]
            done, on = np.flatnonzero(at == stop), np.flatnonzero(at < stop)
            if len(done):
                counts[live[done]] = top[done] - first[done]
                live, first, stop, at, top, token, last = (x[on] for x in (live, first, stop, at, top, token, last))
            while len(back := np.flatnonzero(token < 0)):
                gone = last[back]
                blocked[at[back]] = True
                top[back] -= 1
                at[back] -= self.length[gone]
                token[back] = self.cut[gone]
                last[back] = np.where(top[back] > first[back], ids[top[back] - 1], -1)
        return ids[_places(starts, counts)], counts

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one piece after another, and how many each has."""
        numbers, new = self.piece_ids.number(pieces, len(pieces))
        base, new = len(self.piece_ids.numbers) - len(new), list(map(str.encode, new))
        apart = np.fromiter(map(len, new), np.int64, len(new)) > SHORT_BYTES
        if self.whole_only:
            apart |= np.fromiter(map(self.whole_only.__contains__, new), bool, len(new))
        short, apart = np.flatnonzero(~apart), np.flatnonzero(apart)
        found = [self._one_by_one([new[i] for i in apart.tolist()])]
        for at in range(0, len(short), SIDE_BY_SIDE):
            found.append(self._side_by_side([new[i] for i in short[at: at + SIDE_BY_SIDE].tolist()]))
        self.piece_ids.add(base + np.concatenate([apart, short]), *map(np.concatenate, zip(*found, strict=True)))
        return self.piece_ids.get(numbers)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one chunk after another, and how many each has. A chunk is what follows a space up to the next
        space and begins with no white space, or a space and a text's beginning."""
        begin = [chunk[:1] == " " for chunk in chunks]
        order = np.argsort(begin, kind="stable")
        pieces = self.pieces.findall("".join([" " + chunk for chunk, first in zip(chunks, begin, strict=True) if not first]))
        bounds = [i for i, piece in enumerate(pieces) if piece[0] == " "]
        for chunk in (chunk for chunk, first in zip(chunks, begin, strict=True) if first):
            bounds.append(len(pieces))
            pieces += self.pieces.findall(chunk[1:])
        ids, counts = self._encode_pieces(pieces)
        before = np.concatenate([[0], np.cumsum(counts)])
        self.chunk_ids.add(len(self.chunk_ids.numbers) - len(chunks) + order, ids, np.diff(before[[*bounds, len(pieces)]]))

    def encode_all(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts as 32-bit integers, one text after another, and how many each has. A piece always begins at a
        space before something that is no white space, so a text may be cut there; where two white spaces meet or a
        space ends the text, the whole text goes through the pattern."""
        rows = [[text] if _UNCUT(text) else text.split(" ") for text in texts]
        for row in rows:
            row[0] = " " + row[0]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        numbers, new = self.chunk_ids.number(chain.from_iterable(rows), sizes.sum())
        if new:
            self._encode_chunks(new)
        ids, counts = self.chunk_ids.get(numbers)
        self.piece_ids.shrink()
        self.chunk_ids.shrink()
        before, ends = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(sizes)
        return ids, before[ends] - before[ends - sizes]

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        return self.encode_all([text])[0].tobytes()

    def forget(self) -> None:
        """Drops what is remembered of texts; the worker waits for its next task without it."""
        self.piece_ids.clear()
        self.chunk_ids.clear()
        self._fits.clear()
        release()


def _name(ranks, purpose: str) -> str:
    return "bpe_" + hashlib.md5(repr((sorted(ranks.value.items())[:50], len(ranks.value), purpose)).encode()).hexdigest()


def _tokenizer(ranks, pattern: str) -> ByteBpe:
    """The worker's tokenizer of these ranks, built once per worker."""
    return worker_cache(_name(ranks, pattern), lambda: ByteBpe(ranks.value, pattern))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


class _Tokens:
    """Bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.lengths = np.full(max(ranks.values(), default=0) + 1, -1, np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))
        self.starts = np.zeros(len(self.lengths), np.int64)
        self.starts[list(ranks.values())] = np.cumsum(list(map(len, ranks))) - list(map(len, ranks))
        self.data = np.frombuffer(b"".join(ranks), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Bytes of ids in parts, and how many each id has."""
        unknown = (ids < 0) | (ids >= len(self.lengths))
        lengths = self.lengths[np.where(unknown, 0, ids)]
        unknown |= lengths < 0
        if unknown.any():
            raise KeyError(ids[unknown][0].item())
        parts = [slice(at, at + DECODED) for at in range(0, len(ids), DECODED)]
        return [self.data[_places(self.starts[ids[part]], lengths[part])] for part in parts], lengths


def _pass_on(df: DataFrame, dropped: tuple[str, ...]) -> tuple[list[str], list[str]]:
    kept = [name for name in df.columns if name not in dropped]
    return kept, [f"`{name}` {df.schema[name].dataType.simpleString()}" for name in kept]


def _to_encode(df: DataFrame, text: str, keep: list[str] | None, added: tuple[str, ...] = ("ids",)):
    """The text and the columns to pass on, with their names and fields."""
    base = df.select(text, *[name for name in (df.columns if keep is None else keep) if name not in (text, *added)])
    return base, *_pass_on(base, (text,))


def _encoded(batches: Iterator[pa.RecordBatch], ranks, pattern: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches whose first column is the text, with its ids instead, as last column."""
    bpe = _tokenizer(ranks, pattern)
    for batch in _small(batches):
        ids, counts = bpe.encode_all([value or "" for value in batch.column(0).to_pylist()])
        columns = [batch.column(i) for i in range(1, batch.num_columns)]
        lists = pa.ListArray.from_arrays(pa.array(_offsets(counts)), pa.array(ids))
        yield pa.RecordBatch.from_arrays([*columns, lists], names=[*kept, "ids"])
    bpe.forget()


def _decoded(batches: Iterator[pa.RecordBatch], ranks, kept: list[str], place: int) -> Iterator[pa.RecordBatch]:
    """Batches with the bytes of the ids in column ``place`` as last column."""
    tokens = worker_cache(_name(ranks, "decode"), lambda: _Tokens(ranks.value))
    for batch in _small(batches):
        lists = batch.column(place)
        bounds = lists.offsets.to_numpy()
        parts, lengths = tokens.decode(lists.values.to_numpy(zero_copy_only=False)[bounds[0]: bounds[-1]])
        offsets = _offsets(lengths)[bounds - bounds[0]]
        found = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts))])
        yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*kept, "bytes"])
    release()


def broadcast_ranks(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(df: DataFrame, ranks, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text if not given) and ``ids``, an array of token ids.

    ``ranks`` is a broadcast of :func:`read_ranks`. A NULL or empty text has no ids. An input column ``ids`` is
    replaced. Rows are worked on one by one, so repeated rows are encoded alike and an empty table gives no rows.
    """
    base, kept, fields = _to_encode(df, text, keep)
    return base.mapInArrow(lambda batches: _encoded(batches, ranks, pattern, kept), ", ".join([*fields, "ids array<int>"]))


def decode(df: DataFrame, ranks, ids: str = "ids") -> DataFrame:
    """``df`` with ``bytes``, what the ids stand for; NULL ids have none. An input column ``bytes`` is replaced."""
    base = df.select(ids, *[name for name in df.columns if name not in (ids, "bytes")])
    kept, fields = _pass_on(base, ())
    return base.mapInArrow(lambda batches: _decoded(batches, ranks, kept, 0), ", ".join([*fields, "bytes binary"]))


def round_trip(df: DataFrame, ranks, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep``, ``ids`` and ``bytes``: what :func:`decode` makes of the ids of :func:`encode`, in one pass.

    Two Python operators in a row hold two workers per task, each with its own tables, and an executor keeps the workers
    for the steps that follow; here both run in one. An input column ``bytes`` is replaced as well.
    """
    base, kept, fields = _to_encode(df, text, keep, ("ids", "bytes"))
    return base.mapInArrow(
        lambda batches: _decoded(_encoded(batches, ranks, pattern, kept), ranks, [*kept, "ids"], len(kept)),
        ", ".join([*fields, "ids array<int>", "bytes binary"]))
