"""Near copies when candidate components and buckets hold more than a group: as brute force says."""

import math
import random
from collections import Counter

import pytest

from tunelake.llm import components, near_dedup

WORDS = [f"w{i}" for i in range(3000)]


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP", 8)
    monkeypatch.setattr(near_dedup, "CENTRAL", 2)
    monkeypatch.setattr(near_dedup, "PART_NODES", 24)


def brute_force(texts):
    """The classes of all pairs whose weighted Jaccard is 0.8 or more."""
    vectors = [Counter(tuple(words[i: i + 5]) for i in range(len(words) - 4)) for words in (t.split() for t in texts)]
    df = Counter(shingle for v in vectors for shingle in v)
    weights = [{s: (1 + math.log(c)) * (1 + 0.1 * (1 - round(8 * math.log2(df[s])) / 8 * math.log(2) / math.log(len(texts))))
                for s, c in v.items()} for v in vectors]
    label = list(range(len(texts)))
    for i, a in enumerate(weights):
        for j in range(i):
            b = weights[j]
            shared = sum(min(w, b[s]) for s, w in a.items() if s in b)
            if label[i] != label[j] and shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared):
                label = [label[i] if x == label[j] else x for x in label]
    return {i: label.index(x) for i, x in enumerate(label)}


def edited(words, places, mark):
    out = list(words)
    for place in places:
        out[place % len(out)] = f"{mark}{place}"
    return out


def chains(n):
    """Two runs of texts, each an edit of the one before; the runs start 0.7 alike."""
    draw = random.Random(5)
    base = [draw.choice(WORDS) for _ in range(200)]
    texts = []
    for start, mark in ((base, "a"), (edited(base, range(10, 200, 27), "x"), "b")):
        words = start
        for k in range(n):
            words = edited(words, (17 * k, 17 * k + 100), f"{mark}{k}")
            texts.append(" ".join(words))
    draw.shuffle(texts)
    return texts


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}


def test_components_of_more_than_a_group(spark, small_groups):
    texts = chains(40)
    assert found(spark, texts) == brute_force(texts)


def test_buckets_of_more_than_a_group(spark, small_groups):
    """A hot group and its far relatives: buckets of 60 texts and more, cut into parts by id."""
    draw = random.Random(11)
    base = [draw.choice(WORDS) for _ in range(200)]
    texts = [" ".join(edited(base, range(3 * k, 3 * k + 5), f"c{k}")) for k in range(60)]
    texts += [" ".join(edited(base, range(13 * k, 13 * k + 26), f"d{k}")) for k in range(14)]
    words = edited(base, range(0, 200, 24), "e")
    texts += [" ".join(edited(words, range(7 * k, 7 * k + 9), f"f{k}")) for k in range(20)]
    draw.shuffle(texts)
    assert found(spark, texts) == brute_force(texts)


def test_cut_of_large_buckets_loses_no_candidates(spark, small_groups, monkeypatch):
    """Copies with one word changed, each elsewhere: their only buckets have 21 to 32 nodes and are cut in two by id."""
    monkeypatch.setattr(near_dedup, "PART_NODES", 20)
    draw = random.Random(3)
    base = [draw.choice(WORDS) for _ in range(200)]
    texts = [" ".join(edited(base, (6 * k,), f"c{k}")) for k in range(32)]
    assert set(brute_force(texts).values()) == {0}
    assert found(spark, texts) == brute_force(texts)


def test_stored_tables_have_few_files(spark):
    many = spark.range(0, 4000, 1, 400)
    kept = components.stored(many)
    assert len(kept.inputFiles()) <= components.WAVES * spark.sparkContext.defaultParallelism < 400
    assert sorted(r.id for r in kept.collect()) == list(range(4000))
    assert components.stored(many.limit(0)).count() == 0
