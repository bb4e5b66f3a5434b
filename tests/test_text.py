import pytest
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.functions import chat, params, text
from tunelake.operators import catalog, conversations

SPLITS = [
    ("<think>a</think> hi <think>b</think> yo", "a", "hi <think>b</think> yo"),
    ("<think>open\n", "open", ""),
    ("no tags", "", "no tags"),
    ("pre <think>x\ny</think>\npost\n", "x\ny", "pre \npost"),
    ("</think>z", "", "</think>z"),
    ("\t  lead\n", "", "lead"),
    ("</think><think>é</think>ü", "é", "</think>ü"),
    ("", "", ""),
]


def test_think_split(spark):
    rows = spark.createDataFrame([(c,) for c, _, _ in SPLITS], "content string")
    got = {r["content"]: (r["thought"], r["answer"]) for r in conversations.split_thinking(rows).collect()}
    assert got == {c: (t, a) for c, t, a in SPLITS}


@pytest.mark.parametrize("value", ["", " ", "a", " a ", "  a b\x1f", "\x85　", "é "])
def test_strip_is_pythons(spark, value):
    assert spark.createDataFrame([(value,)], "v string").select(text.strip(F.col("v"))).first()[0] == value.strip()


def test_names(spark):
    folders = ["models--org--repo", "models--org--re--po", "models--x", "other", "models--"]
    rows = spark.createDataFrame([(f"/c/{f}",) for f in folders], "path string")
    got = {(r["model"], r["truncated"]) for r in catalog.model_catalog(rows).collect()}
    assert got == {("org/repo", False), ("org/re", True)}
    names = spark.createDataFrame([("my_adapter-1",), ("a/b",), ("",), ("a\n",), (None,)], "name string")
    checked = {r["name"]: r for r in catalog.adapter_names(names, "given").collect()}
    assert [checked[n]["valid"] for n in ("my_adapter-1", "a/b", "", "a\n", None)] == [True, False, False, False, False]
    assert (checked[""]["training_name"], checked[""]["loaded_name"]) == ("given", fixed.LEGACY_ADAPTER)


def test_reply_roles(spark):
    rows = spark.createDataFrame([
        ("assistant", "System: No model loaded. x"), ("assistant", "Error during inference: y"),
        ("assistant", "System: fine"), ("assistant", "ok"),
    ], "role string, content string")
    assert [tuple(r) for r in conversations.reply_roles(rows).collect()] == [
        ("error", "No model loaded. x"), ("error", "Error during inference: y"), ("assistant", "System: fine"),
        ("assistant", "ok"),
    ]


def test_message_list(spark):
    history = [("user", "q"), ("assistant", " "), ("system", "s"), ("assistant", "r")]
    rows = spark.createDataFrame(
        [(True, False, True), (True, True, True), (False, False, False)],
        "enable_thinking boolean, adapter_loaded boolean, template boolean",
    ).withColumns({
        "history": F.array(*[chat.turn(role, F.lit(content)) for role, content in history]),
        "system": F.lit("S"), "message": F.lit("m"),
    })
    built = conversations.render_prompts(rows).collect()
    thinking, with_adapter, bare = built
    assert [m["role"] for m in thinking["messages"]] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert thinking["messages"][0]["content"] == "S" + fixed.THINKING_SUFFIX
    assert [m["content"] for m in with_adapter["messages"]] == ["S" + fixed.DIRECT_SUFFIX, "q", "r", "m"]
    assert with_adapter["prompt"].endswith("<|user|>\nm<|endoftext|>\n<|assistant|>\n") and bare["prompt"] == "m"


def test_params(spark):
    typed = {"12": 12, "0": 1, "": 1, "x": 1, "99999": 8192, " 7 tokens": 7, "-3": 1}
    rows = spark.createDataFrame([(t,) for t in typed], "t string")
    got = dict(rows.select("t", params.parsed_integer("max_new_tokens", F.col("t"))).collect())
    assert got == typed
    row = spark.range(1).select(
        params.overlay("top_k", F.lit(None), F.lit(3)).alias("a"), params.overlay("top_k", F.lit(None)).alias("b"),
        params.sent_top_k(F.lit(0)).alias("c"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == (3, 50, None)
