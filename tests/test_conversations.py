from functools import partial

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.operators import conversations as ops
from tunelake.operators import ordered
from tunelake.plans.inputs import messages


@pytest.fixture(scope="module")
def talk(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "u1"), (1, 2, "assistant", "<think>t</think>a1"),
        (1, 4, "user", "u2"), (1, 7, "assistant", "<think>only"), (1, 9, "user", "u3"), (1, 10, "assistant", "a3"),
        (2, 0, "assistant", "hello"), (2, 1, "user", "q"), (3, 5, "user", ""), (3, 6, "assistant", "r"),
    ]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string")


WHOLE = {(1, 1): [], (1, 4): ["u1", "a1"], (1, 9): ["u1", "a1", "u2"], (2, 1): ["hello"], (3, 5): []}


def test_history_is_whole(spark, talk):
    def by_turn(rows):
        return {(r["conv_id"], r["turn"]): (r["message"], [t["content"] for t in r["history"]]) for r in rows.collect()}

    found = by_turn(ops.chat_history(talk))
    assert {k: v for k, (_, v) in found.items()} == WHOLE and found[3, 5][0] == ""
    asked = spark.createDataFrame([(1, 9), (1, 9), (3, 5), (1, 2), (9, 1)], "conv_id bigint, turn bigint")
    assert by_turn(ops.chat_history(talk, asked)) == {k: found[k] for k in ((1, 9), (3, 5))}


def test_bounds_name_the_history(talk):
    turns = {(r["conv_id"], r["turn"]): r for r in ops.rendered_turns(talk).collect()}
    for r in ops.history_bounds(talk).collect():
        before = "".join(turns[k]["piece"] for k in sorted(turns) if k[0] == r["conv_id"] and k[1] < r["turn"])
        assert (r["history_chars"], r["n_history"]) == (len(before), len(WHOLE[r["conv_id"], r["turn"]]))


def test_digests_are_those_of_whole_prompts(talk):
    system, thinking = F.concat(F.lit("sys "), "conv_id"), F.col("conv_id") != 2
    whole = ops.render_prompts(ops.chat_history(talk).withColumns({
        "system": system, "enable_thinking": thinking, "adapter_loaded": F.lit(False), "template": F.lit(True)}))
    expected = sorted(tuple(r) for r in whole.select("conv_id", "turn", F.md5("prompt"), F.char_length("prompt")).collect())
    assert sorted(tuple(r) for r in ops.prompt_digests(talk, system, thinking).collect()) == expected


def shuffled_rows(df) -> int:
    """Rows that the shuffles of a run have written."""
    total, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    df._jdf.queryExecution().executedPlan().execute().count()
    while open_:
        node = open_.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return total


def test_a_conversation_of_a_million_turns_is_shuffled_once(spark):
    n = 1_000_000
    turns = spark.range(n).selectExpr(
        "1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('said ', id) AS content")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        digests = ops.prompt_digests(turns, F.lit("s"), F.lit(False))
        assert n <= shuffled_rows(digests) <= 1.01 * n
        bounds = ops.history_bounds(turns)
        assert n <= shuffled_rows(bounds) <= 1.01 * n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    last = bounds.where(F.col("turn") == n - 2).first()
    assert last["n_history"] == n - 2


def test_pairs_and_regenerate(talk):
    pairs = [(r["conv_id"], r["prompt"], r["response"]) for r in ops.conversation_pairs(talk).orderBy("conv_id", "turn").collect()]
    assert pairs == [(1, "u1", "<think>t</think>a1"), (1, "u2", "<think>only"), (1, "u3", "a3"), (3, "", "r")]
    again = [tuple(r) for r in ops.regenerate_requests(talk).collect()]
    assert again == [(1, 9, "u3", 3)]


def test_bounds_do_not_depend_on_chunks(spark, sf_dir, monkeypatch):
    rows = messages(spark, sf_dir).withColumn("conv_id", F.lit(1)).withColumn("turn", F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy("conv_id", "turn")))
    whole = sorted(map(tuple, ops.history_bounds(rows).collect()))
    monkeypatch.setattr(ops, "ordered_scan", partial(ordered.ordered_scan, hot_rows=10))
    monkeypatch.setattr(ops, "position_chunk", partial(ordered.position_chunk, length=16))
    assert sorted(map(tuple, ops.history_bounds(rows).collect())) == whole and len(whole) > 20


def test_batch_inference(spark):
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(20)], "id int, prompt string")

    def load():
        def generate(batch):
            if (batch["id"] == 7).any():
                raise ValueError("seven")
            return [p + f" -> {i}" for p, i in zip(batch["prompt"], batch["id"])]
        return generate

    rows = {r["id"]: r for r in ops.batch_inference(prompts, load).collect()}
    assert rows[3]["content"] == " -> 3" and rows[3]["role"] == "assistant"
    assert rows[7]["content"] == "Error during inference: seven"
    assert len({r["reply_id"] for r in rows.values()}) == 20
    unloaded = ops.batch_inference(prompts, None)
    assert {r["content"] for r in unloaded.collect()} == {fixed.NO_MODEL_REPLY}
    assert ops.reply_roles(unloaded).where("role = 'error'").count() == 20


def test_personas(spark):
    personas = ops.persona_table(spark)
    rows = spark.createDataFrame([("Tutor", " " + fixed.PERSONAS["Coder"] + "\n"), ("None", "x")], "persona string, system string")
    got = [(r["prompt"], r["active"]) for r in ops.active_persona(ops.persona_lookup(rows, personas), personas).collect()]
    assert sorted(got, key=str) == sorted([(fixed.PERSONAS["Tutor"], "Coder"), (None, None)], key=str)
