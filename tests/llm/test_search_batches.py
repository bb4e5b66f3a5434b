"""Search with many queries at a time, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tunelake.llm import blocks, search, texts


def made(draw, n_rows, n_words):
    """Postings of words, and queries of them, with many equal scores."""
    lists = [np.array(sorted(draw.sample(range(n_rows), draw.randint(1, n_rows))), np.int64) for _ in range(n_words)]
    impacts = [np.array([draw.choice([0.5, 1.0, 1.25, 0.1 + draw.random()]) for _ in rows]) for rows in lists]
    queries = [sorted(draw.sample(range(n_words), draw.randint(1, n_words))) for _ in range(40)]
    return lists, impacts, queries


@pytest.mark.parametrize("n_rows", [3, 60, 900])
@pytest.mark.parametrize("limit", [1, 300, 1 << 17])
@pytest.mark.parametrize("dense", [0, 2_000, 1 << 22])
def test_best_rows(monkeypatch, n_rows, limit, dense):
    monkeypatch.setattr(search, "CELLS", limit)
    monkeypatch.setattr(search, "POSTINGS", limit)
    monkeypatch.setattr(search, "DENSE_CELLS", dense)
    lists, impacts, queries = made(random.Random(n_rows), n_rows, 7)
    for k in (1, 3, 10):
        found = search.best_rows(
            np.concatenate(lists), np.concatenate(impacts), np.cumsum([0] + [len(x) for x in lists]),
            np.concatenate(queries), np.cumsum([0] + [len(x) for x in queries]), k)
        expected = []
        for number, words in enumerate(queries):
            scores = Counter()
            for word in words:
                scores.update(dict(zip(lists[word].tolist(), impacts[word].tolist(), strict=True)))
            best = sorted(((round(s * 1e6), row) for row, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
            expected += [(number, row, score) for score, row in best]
        assert list(zip(*(x.tolist() for x in found), strict=True)) == expected


def test_a_shard_answers_ranges_of_queries_not_each_query():
    given = [f"alpha beta w{i}" for i in range(30)]
    table = pa.table({"_text": pa.array([t.encode() for t in given], pa.binary()), "_block": pa.array([5] * 30, pa.int32()),
                      "_id": pa.array(range(30), pa.int64()), "_query": [True] * 30})
    table = pa.Table.from_batches(blocks._compressed(iter(table.to_batches())))
    n, many = 4, 500
    asked = search._ask(table, n)
    words = [np.cumsum(blocks.unpack(v, np.uint64, np.uint32, bool)[0], dtype=np.uint64) for v in asked["payload"].to_pylist()]
    routed = []
    for p, own in zip(asked["_range"].to_pylist(), words, strict=True):
        part = asked.filter(pa.compute.equal(asked["_range"], p))
        keys = np.arange(many).repeat(len(own))
        sent = search._messages([(p, 0, blocks.pack(keys, np.tile(own, many), np.ones(len(keys))))])
        routed.append(search._route(part, sent))
    found = search._search(table, pa.concat_tables(routed), n, 30, 3.0, 10)
    assert found.num_rows == n and set(found["_block"].to_pylist()) == {5}
    merged = pa.concat_tables([search._merge(found.filter(pa.compute.equal(found["_range"], p)), 10) for p in range(n)])
    assert sorted(merged["query_id"].to_pylist()) == sorted(list(range(many)) * 10)
    assert set(zip(merged["rank"].to_pylist(), merged["_id"].to_pylist(), strict=True)) == {(i + 1, i) for i in range(10)}


def test_top_k_of_every_document(spark):
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(draw.choices(vocabulary, range(60, 0, -1), k=draw.randint(1, 40)))) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(25)] + [(None, rows[3][1]), (7, "w1 w2 w3"), (2000, None), (2001, "")]
    counts = [Counter(re.findall(r"\w+", text or "")) for _, text in rows]
    df = Counter(word for c in counts for word in c)
    mean = sum(sum(c.values()) for c in counts) / len(rows)
    idf = {word: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for word, n in df.items()}
    expected = {}
    for query in {key for key, _ in rows if key is not None}:
        words = {word for (key, _), c in zip(rows, counts, strict=True) if key == query for word in c}
        scored = [(-round(sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                              for w in words & c.keys()), 6), math.inf if key is None else key)
                  for (key, _), c in zip(rows, counts, strict=True) if words & c.keys()]
        if scored:
            expected[query] = [(rank, None if key == math.inf else key, -score)
                               for rank, (score, key) in enumerate(sorted(scored)[:10], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {}
    for r in search.top_k(docs, F.lit(True), max_terms=None, min_docs=1).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert found == expected


def test_hashes_across_pieces():
    data = np.random.default_rng(3).integers(0, 256, 3 * texts.HASH_BYTES + 5).astype(np.uint8)
    data[: texts.HASH_BYTES + 9] = 255
    powers, _, codes = texts._power_tables(len(data))
    total, expected = 0, [0]
    for byte, power in zip(data.tolist(), powers.tolist()):
        total = (total + int(codes[byte]) * power) % texts.PRIME
        expected.append(total)
    assert texts.prefix_hashes(data)[0].tolist() == expected
    assert texts.prefix_hashes(data[:0])[0].tolist() == [0]


def test_counted_keeps_owners_apart():
    hashes = np.array([5, 9, 5, 5, 2, 9, 1 << 60, 5], np.uint64)
    owner = np.array([0, 0, 0, 1, 1, 59_999, 59_999, 59_999])
    owners, words, counts, place = search._counted(hashes, owner)
    assert list(zip(owners.tolist(), words.tolist(), counts.tolist(), strict=True)) == [
        (0, 5, 2), (0, 9, 1), (1, 2, 1), (1, 5, 1), (59_999, 5, 1), (59_999, 9, 1), (59_999, 1 << 60, 1)]
    assert hashes[place].tolist() == words.tolist()
