"""Exact top-k search by BM25 over an inverted index per shard, many queries at a time.

Queries are documents of a stated set. A document is too long to be a query as it stands, so its query is made of its
``max_terms`` words with the largest (1 + ln tf) * idf, of those that at least ``min_docs`` documents have (rarer
words find little but the document itself); equal ones go by the word. Without ``max_terms`` and with ``min_docs`` 1
the query is the whole text. Words are lower-case runs of letters, digits and non-ASCII characters.

1. Shards (blocks of documents) send each distinct word's document count to ranges of words, which sum them: global
   statistics, the same in every shard.
2. Shards make the queries of their documents; ranges route every query word to the shards that have it.
3. A shard indexes the words that were asked for: postings in document order with their impacts. Whole batches of
   queries add up the impacts of all their postings in one array, where the largest scores of blocks of documents tell
   which blocks can hold the k best. (Bounds on lists and blocks of postings skip little in a shard, whose k-th best
   document is a weak one, and walking lists query by query took 26 times as long as adding them up.)
4. The k best of each shard go to ranges of queries, which merge them into the k best of all. Nothing is lost: a
   document outside its shard's k best is outside the k best of all.

Scores are rounded to 6 digits and equal ones go by the smaller key, in shards as in the merge; a block is passed over
only if it is below by more than the rounding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm import blocks, texts
from tunelake.llm.near_dedup import MESSAGE, SEPARATOR, _lowered, _messages

K = 10
K1 = 1.2
B = 0.75
MAX_TERMS = 16
MIN_DOCS = 5
UNITS = 1e6
"""Scores are rounded to whole ones of these, and held as such."""

SCORE_BLOCK = 64
CELLS = 1 << 17
"""Scores (documents times queries) of a batch of queries; documents alone may be more."""

POSTINGS = 1 << 17
"""Postings that are read at a time; one word's may be more."""

DENSE = 16
"""A word that one in so many documents of a shard has is kept with an impact for every document: adding up whole rows
takes less time than going by postings."""

DENSE_CELLS = 1 << 22
"""Impacts that are kept so, for the most frequent words."""

MERGED = 1 << 18
SHARDS_PER_PARTITION = 1


def _words(part: texts.Slice):
    """Hash, owner, start and end of every word of a slice."""
    starts, ends, bounds = part.words(SEPARATOR[part.data])
    hashes = texts.span_hashes(texts.prefix_hashes(part.data), starts, ends)
    return hashes, np.repeat(np.arange(part.size), np.diff(bounds)), starts, ends, np.diff(bounds)


def _counted(hashes: np.ndarray, owner: np.ndarray):
    """Distinct (owner, word) with their counts and the place of one of them. Owners are rows of a slice."""
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    h, o = hashes[order], owner[order]
    first = np.ones(len(order), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    return o[at], h[at], np.diff(np.append(at, len(order))), order[at]


@texts.releasing
def _ask(table: pa.Table, n: int) -> pa.Table:
    found, wanted = [], []
    asks = table["_query"].to_numpy(zero_copy_only=False).astype(bool)
    for part in _lowered(blocks.opened(table)):
        hashes, owner, *_ = _words(part)
        owners, words, *_ = _counted(hashes, owner)
        found.append(words)
        wanted.append(words[asks[part.first + owners]])
    words, counts = np.unique(np.concatenate(found), return_counts=True)
    asked = np.isin(words, np.concatenate(wanted))
    bounds = blocks.cut(blocks.ranges(words, n), n)
    block = table["_block"][0].as_py()
    return _messages([(p, block, blocks.pack(
        np.diff(words[bounds[p]: bounds[p + 1]], prepend=np.uint64(0)),
        counts[bounds[p]: bounds[p + 1]].astype(np.uint32), asked[bounds[p]: bounds[p + 1]]))
        for p in blocks.filled(bounds)])


def _asked(table: pa.Table):
    for block, value in zip(table["_block"].to_pylist(), table["payload"].to_pylist(), strict=True):
        gaps, counts, wanted = blocks.unpack(value, np.uint64, np.uint32, bool)
        yield block, np.cumsum(gaps, dtype=np.uint64), counts, wanted


@texts.releasing
def _answer(table: pa.Table, min_docs: int) -> pa.Table:
    """Document counts of the words that shards want for queries."""
    parts = list(_asked(table))
    words, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    total = np.bincount(place, np.concatenate([p[2] for p in parts]), len(words)).astype(np.int64)
    rows, at, p = [], 0, table["_range"][0].as_py()
    for block, own, _, wanted in parts:
        df = total[place[at: at + len(own)]]
        at += len(own)
        use = wanted & (df >= min_docs)
        if use.any():
            rows.append((p, block, blocks.pack(own[use], df[use])))
    return _messages(rows)


def idf(df: np.ndarray | int, n_docs: int):
    return np.log(1 + (n_docs - df + 0.5) / (df + 0.5))


@texts.releasing
def _make_queries(table: pa.Table, answers: pa.Table, n: int, n_docs: int, max_terms: int | None) -> pa.Table:
    """The queries of a shard's documents, by range of their words: key, word, idf."""
    if not table.num_rows or not answers.num_rows:
        return _messages([])
    parts = [blocks.unpack(v, np.uint64, np.int64) for v in answers["payload"].to_pylist()]
    known, df = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(known)
    known, df = known[order], df[order]
    block = table["_block"][0].as_py()
    table = blocks.opened(table.filter(table["_query"]))
    ids = table["_id"].to_numpy()
    keys, words, weights = [], [], []
    for part in _lowered(table):
        hashes, owner, starts, ends, _ = _words(part)
        owners, terms, counts, first = _counted(hashes, owner)
        at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        use = np.flatnonzero(known[at] == terms)
        rarity = idf(df[at[use]], n_docs)
        raw = part.data.tobytes()
        bounds = np.searchsorted(owners[use], np.arange(part.size + 1))
        for row in range(part.size):
            a, b = bounds[row], bounds[row + 1]
            best = heapq.nsmallest(b - a if max_terms is None else max_terms, [
                (-weight, raw[starts[f]: ends[f]], term, r) for weight, f, term, r in zip(
                    ((1 + np.log(counts[use[a:b]])) * rarity[a:b]).tolist(), first[use[a:b]].tolist(), terms[use[a:b]].tolist(),
                    rarity[a:b].tolist(), strict=True)])
            keys += [ids[part.first + row]] * len(best)
            words += [x[2] for x in best]
            weights += [x[3] for x in best]
    keys, words, weights = np.array(keys, np.int64), np.array(words, np.uint64), np.array(weights)
    order = np.argsort(words, kind="stable")
    keys, words, weights = keys[order], words[order], weights[order]
    bounds = blocks.cut(blocks.ranges(words, n), n)
    return _messages([(p, block, blocks.pack(*(x[bounds[p]: bounds[p + 1]] for x in (keys, words, weights))))
                      for p in blocks.filled(bounds)])


@texts.releasing
def _route(asked: pa.Table, queries: pa.Table) -> pa.Table:
    """Sends each query word to the shards that have it: words, idfs, numbers of queries, and the queries' keys."""
    if not asked.num_rows or not queries.num_rows:
        return _messages([])
    p = asked["_range"][0].as_py()
    parts = [blocks.unpack(v, np.int64, np.uint64, np.float64) for v in queries["payload"].to_pylist()]
    keys, words, weights = (np.concatenate([x[j] for x in parts]) for j in range(3))
    order = np.lexsort((keys, words))
    keys, words, weights = keys[order], words[order], weights[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (keys[1:] != keys[:-1])
    keys, words, weights = keys[new], words[new], weights[new]
    distinct, first, sizes = np.unique(words, return_index=True, return_counts=True)
    rows = []
    for block, own, _, _ in _asked(asked):
        here = np.flatnonzero(np.isin(distinct, own, assume_unique=True))
        if len(here):
            rows.append((p, block, blocks.pack(
                np.diff(distinct[here], prepend=np.uint64(0)), weights[first[here]], sizes[here].astype(np.uint32),
                np.diff(keys[_spans(first[here], sizes[here])], prepend=np.int64(0)))))
    return _messages(rows)


def _routed(table: pa.Table):
    """Words in order, their idfs, numbers of queries, and the queries' keys, as all ranges sent them to a shard."""
    parts = [[], [], [], []]
    for i in np.argsort(table["_range"].to_numpy(), kind="stable").tolist():
        words, weights, sizes, keys = blocks.unpack(table["payload"][i].as_py(), np.uint64, np.float64, np.uint32, np.int64)
        for part, x in zip(parts, (np.cumsum(words, dtype=np.uint64), weights, sizes.astype(np.int64), np.cumsum(keys)),
                           strict=True):
            part.append(x)
    return [np.concatenate(part) for part in parts]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i]`` to ``starts[i] + sizes[i] - 1`` of every i."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Postings:
    """One word's documents of a shard in order, and their impacts."""

    __slots__ = ("impacts", "rows")

    def __init__(self, rows: np.ndarray, impacts: np.ndarray):
        self.rows, self.impacts = rows, impacts


def best_rows(
    rows: np.ndarray, impacts: np.ndarray, bounds: np.ndarray, lists: np.ndarray, cuts: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score (in millionths) of the k best rows of each query, by query, score and row.

    List i has the postings ``bounds[i]`` to ``bounds[i + 1] - 1``, query q the lists ``lists[cuts[q]: cuts[q + 1]]``.
    A batch of queries is scored at once, and every posting of its lists counts.
    """
    n_blocks = -(-(int(rows.max(initial=0)) + 1) // SCORE_BLOCK)
    n_cells = n_blocks * SCORE_BLOCK
    starts, sizes = bounds[lists], bounds[lists + 1] - bounds[lists]
    frequent = np.argsort(-np.diff(bounds), kind="stable")[: DENSE_CELLS // n_cells]
    frequent = frequent[np.diff(bounds)[frequent] * DENSE >= n_cells]
    dense = np.zeros((len(frequent), n_cells))
    for i, (start, stop) in enumerate(zip(bounds[frequent].tolist(), bounds[frequent + 1].tolist(), strict=True)):
        dense[i, rows[start:stop]] = impacts[start:stop]
    number = np.full(len(bounds) - 1, -1)
    number[frequent] = np.arange(len(frequent))
    number = number[lists]
    sizes = np.where(number < 0, sizes, 0)
    read = np.append(0, np.cumsum(sizes))
    read_by = read[cuts]
    found = [(np.zeros(0, np.int64),) * 3]
    a = 0
    while a < len(cuts) - 1:
        b = int(np.searchsorted(read_by, read_by[a] + POSTINGS, "right")) - 1
        b = min(max(b, a + 1), a + max(1, CELLS // n_cells), len(cuts) - 1)
        query = np.repeat(np.arange(b - a), np.diff(cuts[a: b + 1]))
        scores, at = np.zeros((b - a, n_cells)), int(cuts[a])
        for i in np.flatnonzero(number[cuts[a]: cuts[b]] >= 0).tolist():
            scores[query[i]] += dense[number[at + i]]
        scores, first = scores.ravel(), query * n_cells
        while at < cuts[b]:
            # A query of very many postings is read in parts.
            to = min(max(int(np.searchsorted(read, read[at] + POSTINGS, "right")) - 1, at + 1), int(cuts[b]))
            place = _spans(starts[at:to], sizes[at:to])
            cells = rows[place] + np.repeat(first[at - cuts[a]: to - cuts[a]], sizes[at:to])
            scores += np.bincount(cells, impacts[place], len(scores))
            at = to
        query, row, score = _best_cells(scores.reshape(b - a, SCORE_BLOCK, n_blocks), k)
        found.append((query + a, row, score))
        a = b
    query, row, score = (np.concatenate([x[j] for x in found]) for j in range(3))
    return query, row, score


def _best_cells(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`best_rows`, of scores by query, place in a block, and block.

    Rows go round the blocks. The k-th largest of the blocks' maxima is a bar that k rows reach; only blocks that
    reach it are looked at.
    """
    n_queries, _, n_blocks = scores.shape
    most = scores.max(axis=1)
    bar = np.full(n_queries, np.finfo(float).tiny)
    if n_blocks >= k:
        np.maximum(bar, np.partition(most, n_blocks - k, axis=1)[:, n_blocks - k] - 2 / UNITS, out=bar)
    query, block = np.nonzero(most >= bar[:, None])
    inside = scores[query, :, block]
    at, place = np.nonzero(inside >= bar[query][:, None])
    return _k_best(query[at], place * n_blocks + block[at], _units(inside[at, place]), k)


def _units(scores: np.ndarray) -> np.ndarray:
    return np.rint(scores * UNITS).astype(np.int64)


def _k_best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query by score and then row, sorted so."""
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], row[keep], score[keep]


def block_max_wand(lists: list[Postings], k: int) -> list[tuple[float, int]]:
    """The k best documents of one query as (score, row), by score (rounded) and then row."""
    bounds = np.cumsum([0] + [len(x.rows) for x in lists])
    if not bounds[-1]:
        return []
    _, rows, scores = best_rows(
        np.concatenate([x.rows for x in lists]), np.concatenate([x.impacts for x in lists]), bounds,
        np.arange(len(lists)), np.array([0, len(lists)]), k)
    return list(zip((scores / UNITS).tolist(), rows.tolist(), strict=True))


@texts.releasing
def _search(table: pa.Table, routed: pa.Table, n: int, n_docs: int, mean_length: float, k: int) -> pa.Table:
    """By range of queries, the k best documents of a shard for each query that reaches it: keys, documents, scores."""
    if not table.num_rows or not routed.num_rows:
        return _messages([])
    block = table["_block"][0].as_py()
    table = blocks.in_order(table)
    ids = table["_id"].to_numpy()
    wanted, rarity, asked_by, keys = _routed(routed)
    rows, terms, counts, lengths = [], [], [], []
    for part in _lowered(table):
        hashes, owner, _, _, sizes = _words(part)
        owners, words, numbers, _ = _counted(hashes, owner)
        at = np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)
        hit = wanted[at] == words
        rows.append(part.first + owners[hit])
        terms.append(at[hit])
        counts.append(numbers[hit])
        lengths.append(sizes)
    rows, terms, counts, lengths = (np.concatenate(x) for x in (rows, terms, counts, lengths))
    impacts = rarity[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[rows] / mean_length))
    order = np.argsort(terms, kind="stable")
    bounds = np.searchsorted(terms[order], np.arange(len(wanted) + 1))
    places = np.repeat(np.arange(len(wanted)), asked_by)
    by_key = np.argsort(keys, kind="stable")
    keys = keys[by_key]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    query, row, score = best_rows(rows[order], impacts[order], bounds, places[by_key], cuts, k)
    keys, docs = keys[cuts[query]], ids[row]
    to = blocks.ranges(texts.mix(keys.view(np.uint64)), n)
    order = np.argsort(to, kind="stable")
    keys, docs, score = keys[order], docs[order], score[order]
    bounds = blocks.cut(to[order], n)
    return _messages([(p, block, blocks.pack(np.diff(keys[a:b], prepend=np.int64(0)), docs[a:b], score[a:b]))
                      for p in blocks.filled(bounds) for a, b in [bounds[p: p + 2]]])


@texts.releasing
def _merge(table: pa.Table, k: int) -> pa.Table:
    """The k best of all shards for the queries of a range."""
    parts, size, limit = [(np.zeros(0, np.int64),) * 3], 0, MERGED

    def merged():
        return _k_best(*(np.concatenate([x[j] for x in parts]) for j in range(3)), k)

    for value in table["payload"]:
        keys, docs, scores = blocks.unpack(value.as_py(), np.int64, np.int64, np.int64)
        parts.append((np.cumsum(keys), docs, scores))
        size += len(keys)
        if size > limit:
            parts = [merged()]
            size = len(parts[0][0])
            limit = 2 * size + MERGED
    keys, docs, scores = merged()
    return pa.table({
        "query_id": keys, "rank": pa.array(np.arange(len(keys)) - np.searchsorted(keys, keys) + 1, pa.int32()),
        "_id": docs, "score": scores / UNITS})


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = words = 0
    for batch in batches:
        docs += batch.num_rows
        words += sum(len(part.words(SEPARATOR[part.data])[0]) for part in texts.slices(batch.column(0)))
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([words])], names=["docs", "words"])


def top_k(
    docs: DataFrame, is_query: Column, *, key: str = "doc_id", text: str = "text", k: int = K,
    max_terms: int | None = MAX_TERMS, min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``query_id, rank, <key>, score`` of the k best documents of each query document, itself included. Queries have
    ``max_terms`` words, or all if it is None.

    Keys are integers and should be unique; NULL keys come last among equals and are no queries. A query without a
    word that ``min_docs`` documents have finds nothing. NULL texts are empty; other columns are left out.
    """
    given = docs.select(F.col(key).alias("_key"), F.col(text).alias("_given"),
                        (F.coalesce(is_query, F.lit(False)) & F.col(key).isNotNull()).alias("_query"))
    n_docs, n_words = given.select("_given").mapInArrow(_sizes, "docs long, words long").agg(
        F.sum("docs"), F.sum("words")).first()
    n_docs, mean = int(n_docs or 0), (n_words or 0) / max(1, n_docs or 0) or 1.0
    blocked = blocks.in_blocks(given, "_key", F.col("_given"), ["_query"], SHARDS_PER_PARTITION)
    n = blocks.n_ranges(docs)
    asked = blocked.groupBy("_block").applyInArrow(lambda t: _ask(t, n), MESSAGE)
    answers = asked.groupBy("_range").applyInArrow(lambda t: _answer(t, min_docs), MESSAGE)
    made = blocked.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(
        lambda t, a: _make_queries(t, a, n, n_docs, max_terms), MESSAGE)
    routed = asked.groupBy("_range").cogroup(made.groupBy("_range")).applyInArrow(lambda a, q: _route(a, q), MESSAGE)
    found = blocked.groupBy("_block").cogroup(routed.groupBy("_block")).applyInArrow(
        lambda t, q: _search(t, q, n, n_docs, mean, k), MESSAGE)
    merged = found.groupBy("_range").applyInArrow(
        lambda t: _merge(t, k), "query_id long, rank int, _id long, score double")
    return merged.select("query_id", "rank", F.when(F.col("_id") != F.lit(int(blocks.NO_ID)), F.col("_id")).alias(key),
                         "score")
