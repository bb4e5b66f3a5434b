import re

import pytest
from pyspark.sql import functions as F

from tunelake.operators import sequences as ops

MASKS = [  # prefix length, ids, input ids, attention, labels, fully masked
    (2, [1, 2, 3, 0], [1, 2, 3, 0, 0, 0], [1, 1, 1, 1, 0, 0], [-100, -100, 3, 0, -100, -100], False),
    (2, [1, 2, 3, 4, 5, 6, 7, 0], [1, 2, 3, 4, 5, 6], [1] * 6, [-100, -100, 3, 4, 5, 6], False),
    (7, [1, 2, 3, 4, 5, 6, 7, 8, 0], [1, 2, 3, 4, 5, 6], [1] * 6, [-100] * 6, True),
    (6, [1, 2, 3, 4, 5, 6, 0], [1, 2, 3, 4, 5, 6], [1] * 6, [-100] * 6, True),
    (5, [1, 2, 3, 4, 5, 0], [1, 2, 3, 4, 5, 0], [1] * 6, [-100] * 5 + [0], False),
]


def test_label_mask(spark):
    rows = spark.createDataFrame([(i, m[0], m[1]) for i, m in enumerate(MASKS)], "i int, n_prompt int, ids array<int>")
    got = {r["i"]: r for r in ops.label_mask(rows, length=6, pad=0).collect()}
    for i, (n_prompt, ids, inputs, attention, labels, masked) in enumerate(MASKS):
        row = got[i]
        assert (row["input_ids"], row["attention_mask"], row["labels"]) == (inputs, attention, labels)
        assert (row["fully_masked"], row["truncated"], row["n_tokens"]) == (masked, len(ids) > 6, len(ids))
        assert sum(v != -100 for v in row["labels"]) == max(0, min(len(ids), 6) - n_prompt)
    budget = ops.token_budget(rows, length=6).first()
    assert (budget["truncated_rows"], budget["fully_masked_rows"], budget["trained_tokens"]) == (3, 2, 2 + 4 + 1)


@pytest.fixture(scope="module")
def texts(spark):
    return ops.training_text(spark.createDataFrame(
        [("what is it", "it is it"), ("x<y é", "b\ta"), ("", "")], "prompt string, response string"
    ))


def test_vocabulary_and_ids(texts):
    words = {r["token"]: (r["uses"], r["token_id"]) for r in ops.vocabulary(texts).collect()}
    assert words["<|assistant|>"] == (3, 2) and words["<|user|>"] == (3, 3) and words["it"] == (3, 4)
    assert words["is"] == (2, 5) and "<|endoftext|>" not in words
    encode = ops.vocabulary_encoder(ops.vocabulary(texts, size=4))
    rows = ops.tokenize(texts, encode).collect()
    assert rows[0]["ids"] == [3, 1, 5, 4, 0, 2, 4, 5, 4, 0] and rows[0]["n_prompt"] == 6
    assert rows[2]["ids"] == [3, 0, 2, 0]
    same = ops.tokenize_by_words(texts, encode).collect()
    assert [(r["ids"], r["n_prompt"]) for r in same] == [(r["ids"], r["n_prompt"]) for r in rows]


def test_every_token_has_its_id(texts):
    words = ops.vocabulary(texts)
    known = {r["token"]: r["token_id"] for r in words.collect()} | {"<|endoftext|>": ops.END_ID}
    assert sorted(known.values()) == [0, *range(2, len(known) + 1)]
    for r in ops.tokenize_once(texts, ["prompt"]).collect():
        pieces = re.findall(r"<\|[a-z]+\|>|[^ \t\n\r\f<]+|<", r["full_text"])
        assert r["ids"] == [known[p] for p in pieces] and ops.UNKNOWN_ID not in r["ids"]
        assert r["n_prompt"] == len(re.findall(r"<\|[a-z]+\|>|[^ \t\n\r\f<]+|<", r["prefix"]))


def test_blocks_encode_with_any_dictionary(spark, texts):
    blocks = ops.in_token_blocks(texts, ["prompt"])
    words, answers = ops.block_dictionary(blocks)
    assert {tuple(r) for r in words.collect()} == {tuple(r) for r in ops.vocabulary(texts).collect()}
    few = ops.encode_blocks(blocks, answers.where("token_id < 4")).collect()
    assert {i for r in few for i in r["ids"]} == {ops.END_ID, ops.UNKNOWN_ID, 2, 3}
    none = spark.createDataFrame([], answers.schema)
    assert {i for r in ops.encode_blocks(blocks, none).collect() for i in r["ids"]} == {ops.END_ID, ops.UNKNOWN_ID}


def test_empty_and_null_texts_and_hot_keys(spark):
    empty = ops.training_text(spark.createDataFrame([], "prompt string, response string"))
    assert ops.tokenize_once(empty, ["prompt"]).collect() == []
    rows = spark.createDataFrame([("k", i, None if i % 3 == 0 else f"w{i} same", "same") for i in range(300)],
                                 "k string, i int, full_text string, prefix string")
    found = ops.tokenize_once(rows, ["k"]).collect()
    assert len(found) == 300 and all((r["ids"] == []) == (r["i"] % 3 == 0) for r in found)


def test_callable_tokenizer(texts):
    encode = ops.callable_encoder(lambda: lambda batch: [[len(t)] for t in batch])
    rows = ops.tokenize(texts, encode).collect()
    assert [r["ids"] for r in rows] == [[len(r["full_text"])] for r in rows] and rows[0]["n_prompt"] == 1


@pytest.mark.parametrize("digits", [1, 3])
def test_manifest(spark, digits):
    examples = spark.range(103).select(F.col("id").cast("string").alias("example_id"))
    plan = ops.batch_manifest(examples, epochs=2, batch_size=2, accumulation=4, seed=5, hex_digits=digits).collect()
    orders = []
    for epoch in (0, 1):
        rows = sorted((r for r in plan if r["epoch"] == epoch), key=lambda r: r["position"])
        assert [r["position"] for r in rows] == list(range(103))
        assert all(r["batch"] == r["position"] // 2 and r["step"] == r["batch"] // 4 for r in rows)
        assert len({r["step"] for r in rows}) == -(-103 // 8)
        orders.append([r["example_id"] for r in rows])
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]
