"""Spelling variants: words one edit apart, found by Gram matrices of letter counts in blocks.

One inserted or deleted letter moves a word's letter counts by a squared distance of 1, a replaced one by 2. Words
therefore meet in blocks of one length and the lengths beside it: a NumPy product of two blocks' count matrices gives
all squared distances at once, pairs of at most two are kept, and their edits are verified letter by letter.

So that blocks stay small in a large vocabulary, a length is cut further by the counts of a few groups of letters,
which an edit can only move by one: a block meets its neighbours in these counts, a fixed number of them. A block that
is still large is cut into tiles, each of which meets each. Tiles are packed once; a pair of tiles is one row, and
returns one row per word with a partner: its number of partners and the best of them.

The words come from all texts: runs of letters are cut, counted and folded by Spark's own functions, with partial
counts before the shuffle, so that a frequent word is one row per task.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.session import settle

RUNS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 5
MIN_COUNT = 3
TYPO_ONE_IN = 97
TIMES = 2
"""How many times as frequent as a word its form must be."""

GROUPS = 5
TILE_LETTERS = 40_000
_SLAB = 1024
_CODES = 256


def with_typos(key: Column, word: Column, one_in: int = TYPO_ONE_IN) -> Column:
    """The word, without one letter where a hash of key and word says so; a NULL key is an empty one."""
    drawn = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    place = (drawn % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))
    return F.when(drawn % one_in == 0, cut).otherwise(word)


def words(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    one_in: int = TYPO_ONE_IN,
) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts, for words of enough letters and occurrences.

    Words are maximal runs of letters (ASCII and U+00C0 to U+00FF), of which only A to Z are made small, then given
    typos by :func:`with_typos`. A NULL or empty text has none; repeated rows count again.
    """
    runs = docs.select(F.col(key).alias("_key"), F.explode(F.regexp_extract_all(
        F.col(text), F.lit(RUNS), F.lit(0))).alias("_run"))
    small = F.translate("_run", string.ascii_uppercase, string.ascii_lowercase)
    found = runs.select("_key", small.alias("_small")).select(with_typos(F.col("_key"), F.col("_small"), one_in).alias("word"))
    return found.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= min_count)


def _group_counts(word: Column) -> list[Column]:
    """How many letters of a word each group has; the groups deal the letters out by their codes."""
    letters = [*map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))]
    found = []
    for group in range(GROUPS - 1):
        own = "".join(x for x in letters if ord(x) % GROUPS == group)
        found.append(F.length(F.regexp_replace(word, f"[^{own}]", "")))
    return [*found, F.length(word) - sum(found[1:], found[0])]


def _code(counts: list[Column]) -> Column:
    return F.concat_ws(".", *counts)


def _neighbours(counts: Column) -> Column:
    """Codes of the blocks that may hold partners, the block itself included, each pair of blocks from one side:
    one letter more in a group, or one more and one less in two groups of the same length."""
    moved = [[0] * GROUPS] + [[int(i == j) for i in range(GROUPS)] for j in range(GROUPS)] + [
        [(i == j) - (i == k) for i in range(GROUPS)] for j, k in permutations(range(GROUPS), 2) if j < k]
    return F.array(*[F.concat_ws(".", *[(counts[i] + step[i]).cast("string") for i in range(GROUPS)]) for step in moved])


class _Tile:
    """Words of one length: their codes as a matrix and how often each has each letter."""

    def __init__(self, words_: list[str], uses: list[int]):
        order = np.argsort(np.array(words_))
        self.words, self.uses = [words_[i] for i in order], np.array(uses, np.int64)[order]
        length = len(words_[0])
        self.codes = np.frombuffer("".join(self.words).encode("latin-1"), np.uint8).reshape(-1, length)
        self.counts = np.zeros((len(words_), _CODES), np.float32)
        np.add.at(self.counts, (np.repeat(np.arange(len(words_)), length), self.codes.ravel()), 1)
        used = self.counts.any(0)
        self.letters = np.flatnonzero(used)
        self.norms = (self.counts ** 2).sum(1)


def near_pairs(a: _Tile, b: _Tile, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs one edit apart; ``b`` has the words of greater length where lengths differ."""
    letters = np.union1d(a.letters, b.letters)
    left, right = a.counts[:, letters], b.counts[:, letters]
    apart = b.codes.shape[1] - a.codes.shape[1]
    wanted = 1 if apart else 2
    first, second = [], []
    for at in range(0, len(left), _SLAB):
        square = a.norms[at: at + _SLAB, None] + b.norms[None, :] - 2 * (left[at: at + _SLAB] @ right.T)
        near = square <= 2
        if same:
            near &= np.arange(at, at + len(near))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(near & (square == wanted))
        i = i + at
        sure = _one_edit(a.codes, b.codes, i, j, apart)
        first.append(i[sure]), second.append(j[sure])
    return np.concatenate(first), np.concatenate(second)


def _one_edit(short: np.ndarray, long: np.ndarray, i: np.ndarray, j: np.ndarray, apart: int) -> np.ndarray:
    """Which pairs differ by one replaced letter (equal lengths) or one inserted one."""
    sure = np.zeros(len(i), bool)
    step = max(1, (1 << 22) // long.shape[1])
    for at in range(0, len(i), step):
        x, y = short[i[at: at + step]], long[j[at: at + step]]
        if apart == 0:
            sure[at: at + step] = (x != y).sum(1) == 1
        else:
            front = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(1)
            back = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
            sure[at: at + step] = front + back >= x.shape[1]
    return sure


PARTNERS = "word string, n_near long, form_n long, form string"


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two tiles to one row per word: its partners there and the best of them (most uses, then smallest)."""
    for batch in batches:
        rows = []
        for same, *sides in zip(*(batch.column(c).to_pylist() for c in ("same", "words_a", "uses_a", "words_b", "uses_b")),
                                strict=True):
            a = _Tile(sides[0], sides[1])
            b = a if same else _Tile(sides[2], sides[3])
            if a.codes.shape[1] > b.codes.shape[1]:
                a, b = b, a
            first, second = near_pairs(a, b, same)
            for own, other, x, y in ((a, b, first, second), (b, a, second, first)):
                # Words of a tile are in order, so the first of equal uses is the smallest.
                order = np.lexsort((y, -other.uses[y], x))
                x, y = x[order], y[order]
                heads = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(heads, len(x)))
                rows += [(own.words[i], n, int(other.uses[j]), other.words[j]) for i, n, j in zip(
                    x[heads].tolist(), sizes.tolist(), y[heads].tolist(), strict=True)]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                                         names=[field.split()[0] for field in PARTNERS.split(", ")])


def near_words(vocabulary: DataFrame, tile_letters: int = TILE_LETTERS) -> DataFrame:
    """``word``, ``n_near`` (words one edit apart), and of these ``form``, the one of most uses (of equal ones the
    smallest), with its uses ``form_n``. Words without any have no row. ``vocabulary`` has distinct words of letters
    up to U+00FF, and ``n``."""
    counted = vocabulary.select("word", "n", _code(_group_counts(F.col("word"))).alias("block"), F.length("word").alias("_length"))
    sizes = counted.groupBy("block").agg(F.ceil(F.sum("_length") / tile_letters).cast("int").alias("tiles"))
    tiles = counted.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("word"), "tiles").cast("int")).groupBy(
        "block", "tile").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("uses"))
    # Several steps read the tiles; stored once, they are the vocabulary's size.
    tiles = settle(tiles)
    codes = F.transform(F.split("block", r"\."), lambda x: x.cast("int"))
    has = tiles.select("block", "tile")
    units = has.select("block", "tile", F.explode(_neighbours(codes)).alias("other")).join(
        has.select(F.col("block").alias("other"), F.col("tile").alias("other_tile")), "other").where(
        "block <> other OR tile <= other_tile")
    same = (F.col("block") == F.col("other")) & (F.col("tile") == F.col("other_tile"))
    left = tiles.select("block", "tile", F.col("words").alias("words_a"), F.col("uses").alias("uses_a"))
    right = tiles.select(F.col("block").alias("other"), F.col("tile").alias("other_tile"), F.col("words").alias("words_b"),
                         F.col("uses").alias("uses_b"))
    met = units.join(left, ["block", "tile"]).join(right, ["other", "other_tile"]).select(
        same.alias("same"), "words_a", "uses_a", "words_b", "uses_b")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return met.mapInArrow(_partners, PARTNERS).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each word's chain of forms. Each round doubles the steps taken; a form is at least twice
    as frequent as its word, so that a chain has at most 63 steps and six rounds end it."""
    current = settle(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not current.where("moved").isEmpty():
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        current = settle(current.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return current.select("word", "root")


def variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", times: int = TIMES,
             tile_letters: int = TILE_LETTERS, **settings) -> DataFrame:
    """One row per word of :func:`words`: ``word, n, n_near, form, form_n, root``.

    ``form`` is the most frequent word one edit apart (of equal ones the smallest) if it is at least ``times`` as frequent
    as the word, else NULL; ``root`` is the word that forms lead to, the word itself without a form. Texts without
    letters and empty tables give no words; other columns of ``docs`` are left out.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    vocabulary = settle(words(docs, key=key, text=text, **settings))
    near = settle(near_words(vocabulary, tile_letters))
    good = F.col("form_n") >= times * F.col("n")
    joined = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    roots = _roots(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
