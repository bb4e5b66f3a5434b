"""Pairing replies with prompts, histories, requests, and running a generator over a request table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tunelake import fixed_values as fixed
from tunelake.functions import chat
from tunelake.functions.text import answer, is_error_reply, strip, thought, without_system_prefix
from tunelake.operators.ordered import ordered_scan, position_chunk

HISTORY_BLOCK = 512
"""Turns per history block, the unit in which turns meet."""


def conversation_pairs(messages: DataFrame) -> DataFrame:
    """Each assistant reply with the user message right before it."""
    before = ordered_scan(
        messages.select("conv_id", "turn", "role", "content"), ["conv_id"], ["turn"], position_chunk("turn"),
        previous={"prompt": F.col("content"), "prompt_role": F.col("role")},
    )
    return before.where("role = 'assistant' AND prompt_role = 'user'").select(
        "conv_id", "turn", "prompt", F.col("content").alias("response")
    )


def answered_pairs(messages: DataFrame) -> DataFrame:
    """Pairs whose response is what the speaker was shown: the reply without its first think block."""
    return conversation_pairs(messages).withColumn("response", answer(F.col("response")))


def split_thinking(messages: DataFrame) -> DataFrame:
    return messages.withColumns({"thought": thought(F.col("content")), "answer": answer(F.col("content"))})


def history_blocks(messages: DataFrame, block: int = HISTORY_BLOCK) -> DataFrame:
    """Kept history of each conversation as consecutive blocks of turns, oldest first.

    A block covers a fixed range of turn numbers, so its array is bounded however long the
    conversation is. ``n_before`` counts the kept turns of all earlier blocks.
    """
    kept = F.when(F.col("kept"), F.struct("turn", "role", "content"))
    return _with_counts_before(_blocks(messages, block)).groupBy("conv_id", "block").agg(
        F.max("n_before").alias("n_before"),
        F.count_if("kept").alias("n"),
        F.array_sort(F.collect_list(kept)).alias("turns"),
    )


def chat_history(messages: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The request behind each user turn, with all turns kept before it in ``history``: one reading, one shuffle.

    The output of a conversation of n turns is of size n^2. Where conversations are long, name the requests (``asked``:
    ``conv_id, turn``) whose whole history is wanted, which costs what these hold; :func:`history_bounds` and
    :func:`prompt_digests` serve all requests of any conversation without putting histories together.
    """
    rows = _spoken(messages)
    said = F.when(F.col("kept"), F.struct("role", "content"))
    if asked is None:
        before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        found = rows.withColumn("history", F.collect_list(said).over(before)).where("role = 'user'")
        return found.select("conv_id", "turn", F.col("text").alias("message"), "history")
    wanted = asked.select("conv_id", F.col("turn").alias("_asked")).distinct()
    met = rows.join(wanted, "conv_id").where(
        (F.col("kept") & (F.col("turn") < F.col("_asked"))) | ((F.col("turn") == F.col("_asked")) & (F.col("role") == "user")))
    own = F.col("turn") == F.col("_asked")
    return met.groupBy("conv_id", F.col("_asked").alias("turn")).agg(
        F.max(F.when(own, F.col("text"))).alias("message"), F.bool_or(own).alias("_found"),
        F.array_sort(F.collect_list(F.when(~own, F.struct("turn", "role", "content")))).alias("_turns")).where(
        "_found").select("conv_id", "turn", "message", F.transform(
            "_turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("history"))


def rendered_turns(messages: DataFrame) -> DataFrame:
    """Each message once, as the ``piece`` of text that it adds to the prompts after it ('' if history leaves it out), with
    the characters and kept turns before it (``start``, ``n_before``). A history is the pieces before a bound."""
    rows = _spoken(messages).withColumn("piece", F.when(F.col("kept"), chat.rendered_turn(
        F.col("role"), F.col("content"))).otherwise(F.lit("")))
    size, one = F.char_length("piece").cast("bigint"), F.col("kept").cast("bigint")
    scanned = ordered_scan(
        rows.select("conv_id", "turn", "role", "text", "piece", one.alias("_one"), size.alias("_size")), ["conv_id"], ["turn"],
        position_chunk("turn"), running={"_upto": F.col("_size"), "_count": F.col("_one")})
    return scanned.select("conv_id", "turn", "role", "text", "piece", (F.col("_upto") - F.col("_size")).alias("start"),
                          (F.col("_count") - F.col("_one")).alias("n_before"))


def history_bounds(messages: DataFrame) -> DataFrame:
    """The request behind each user turn, its history as a bound: the first ``history_chars`` characters of the
    conversation's rendered turns, ``n_history`` of them kept. Linear in the messages, however long a conversation is."""
    return rendered_turns(messages).where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("message"), F.col("n_before").alias("n_history"),
        F.col("start").alias("history_chars"))


def prompt_digests(messages: DataFrame, system: Column, thinking: Column) -> DataFrame:
    """``prompt_md5`` and ``prompt_chars`` of the whole rendered prompt of every user turn: what :func:`render_prompts`
    makes of :func:`chat_history`, without making it.

    ``system`` and ``thinking`` are columns of ``messages`` that do not change within a conversation. A conversation passes
    through one task as a stream of its pieces, each shuffled and hashed once; a digest is a copy of the running one
    that ends with its own message. Memory does not grow with the conversation.
    """
    rows = _spoken(messages.withColumns({"_system": system, "_thinking": thinking}))
    piece = F.when(F.col("kept"), chat.rendered_turn(F.col("role"), F.col("content"))).otherwise(F.lit(""))
    tail = F.concat(chat.rendered_turn(F.lit("user"), F.col("text")), F.lit(fixed.ASSISTANT_MARK))
    head = chat.rendered_head(F.col("_system"), F.col("_thinking"))
    dealt = rows.select("conv_id", "turn", piece.alias("piece"), F.when(F.col("role") == "user", tail).alias("tail"),
                        head.alias("head")).repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    kind = dealt.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, size = None, None, 0
        for batch in batches:
            found = []
            for conv, turn, piece, tail, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != current:
                    current, state, size = conv, hashlib.md5(head.encode()), len(head)
                if tail is not None:
                    whole = state.copy()
                    whole.update(tail.encode())
                    found.append((conv, turn, whole.hexdigest(), size + len(tail)))
                state.update(piece.encode())
                size += len(piece)
            yield pa.RecordBatch.from_pylist(
                [dict(zip(schema.names, row, strict=True)) for row in found], schema)

    schema = pa.schema([("conv_id", to_arrow_type(dealt.schema["conv_id"].dataType)), ("turn", to_arrow_type(
        dealt.schema["turn"].dataType)), ("prompt_md5", pa.string()), ("prompt_chars", pa.int64())])
    turn_kind = dealt.schema["turn"].dataType.simpleString()
    return dealt.mapInArrow(run, f"conv_id {kind}, turn {turn_kind}, prompt_md5 string, prompt_chars long")


def _spoken(messages: DataFrame) -> DataFrame:
    """Messages with the text history keeps of them: replies lose their first think block."""
    spoken = F.when(F.col("role") == "assistant", answer(F.col("content"))).otherwise(F.col("content"))
    return messages.withColumns({"text": F.col("content"), "content": spoken}).withColumn(
        "kept", chat.kept_turn(F.col("role"), F.col("content")))


def _blocks(messages: DataFrame, block: int) -> DataFrame:
    return _spoken(messages).select(
        "conv_id", "turn", "role", "text", "content", position_chunk("turn", block).alias("block"), "kept")


def _with_counts_before(blocks: DataFrame) -> DataFrame:
    """Adds a row per block that holds the kept turns of all earlier blocks, to be grouped with the rest.

    Only the counts are scanned in order; the texts are shuffled once, when their block is put together.
    """
    counts = blocks.groupBy("conv_id", "block").agg(F.count_if("kept").alias("n"))
    scanned = ordered_scan(
        counts, ["conv_id"], ["block"], position_chunk("block", 4_096), running={"upto": F.col("n")}
    )
    before = scanned.select("conv_id", "block", (F.col("upto") - F.col("n")).alias("n_before"))
    return blocks.unionByName(before, allowMissingColumns=True)


def regenerate_requests(messages: DataFrame) -> DataFrame:
    """Requests to answer a conversation's last prompt again.

    Only where the last message is a reply to a user message. The prompt is resent with the last two
    messages dropped; ``n_history`` counts the kept turns that stay.
    """
    spoken = F.when(F.col("role") == "assistant", answer(F.col("content"))).otherwise(F.col("content"))
    kept = chat.kept_turn(F.col("role"), spoken).cast("bigint")
    scanned = ordered_scan(
        messages.select("conv_id", "turn", "role", "content", kept.alias("_kept")), ["conv_id"], ["turn"],
        position_chunk("turn"),
        running={"upto": F.col("_kept")},
        previous={"message": F.col("content"), "asked_role": F.col("role"), "asked_turn": F.col("turn"),
                  "asked_kept": F.col("_kept")},
    )
    last = scanned.groupBy("conv_id").agg(
        F.max_by(
            F.struct("role", "message", "asked_role", "asked_turn",
                     (F.col("upto") - F.col("_kept") - F.col("asked_kept")).alias("n_history")),
            "turn",
        ).alias("last")
    )
    return last.where("last.role = 'assistant' AND last.asked_role = 'user' AND last.message <> ''").select(
        "conv_id", F.col("last.asked_turn").alias("turn"), F.col("last.message").alias("message"),
        F.col("last.n_history").alias("n_history"),
    )


def reply_roles(replies: DataFrame) -> DataFrame:
    """Replies that report a failure become role ``error``, without their ``System: `` prefix."""
    failed = is_error_reply(F.col("content"))
    return replies.withColumns({
        "role": F.when(failed, F.lit("error")).otherwise(F.col("role")),
        "content": F.when(failed, without_system_prefix(F.col("content"))).otherwise(F.col("content")),
    })


def persona_table(spark) -> DataFrame:
    return spark.createDataFrame(list(fixed.PERSONAS.items()), "persona string, prompt string")


def persona_lookup(requests: DataFrame, personas: DataFrame) -> DataFrame:
    """The persona's prompt by name; Spark broadcasts the personas when it sees that they are few."""
    return requests.join(personas, "persona", "left")


def active_persona(requests: DataFrame, personas: DataFrame) -> DataFrame:
    """Which persona a trimmed system prompt belongs to, if any."""
    known = personas.select(F.col("persona").alias("active"), F.col("prompt").alias("_prompt"))
    return requests.join(known, strip(F.col("system")) == F.col("_prompt"), "left").drop("_prompt")


def build_messages(requests: DataFrame) -> DataFrame:
    """Adds the message list. Needs message, history, system, enable_thinking, adapter_loaded."""
    thinking = chat.uses_thinking(F.col("enable_thinking"), F.col("adapter_loaded"))
    return requests.withColumn("thinking", thinking).withColumn(
        "messages",
        chat.message_list(F.col("system"), F.col("thinking"), F.col("history"), F.col("message")),
    )


def render_prompts(requests: DataFrame) -> DataFrame:
    """Adds the text given to the generator; ``template`` false means the bare message."""
    return build_messages(requests).withColumn(
        "prompt", chat.rendered_request(F.col("template"), F.col("messages"), F.col("message"))
    )


REPLY_FIELDS = "reply_id string, role string, content string"


def batch_inference(
    requests: DataFrame, load_generator: Callable[[], Callable[[pd.DataFrame], list[str]]] | None
) -> DataFrame:
    """Answers every request with a caller's generator, loaded once per task.

    The generator takes a batch of requests and returns one output per row, prompt included. A batch it
    fails on is halved until the failing rows are alone, so only these get an error reply. Without a generator
    every request gets the fixed reply that says so.
    """
    names = requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = load_generator() if load_generator else None
        for batch in batches:
            if generate is None:
                replies = [fixed.NO_MODEL_REPLY] * len(batch)
            else:
                replies = _replies(batch, generate)
            yield batch[names].assign(
                reply_id=[str(uuid.uuid4()) for _ in replies], role="assistant", content=replies
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInPandas(run, f"{schema}, {REPLY_FIELDS}")


def _continuations(batch: pd.DataFrame, outputs: list[str]) -> list[str]:
    if len(outputs) != len(batch):
        raise ValueError("the generator must return one output per request")
    return [output[len(prompt):] for output, prompt in zip(outputs, batch["prompt"], strict=True)]


def _replies(batch: pd.DataFrame, generate: Callable[[pd.DataFrame], list[str]]) -> list[str]:
    try:
        return _continuations(batch, generate(batch)) if len(batch) else []
    except Exception as error:
        if len(batch) == 1:
            return [f"{fixed.INFERENCE_ERROR_PREFIX}: {error}"]
        half = len(batch) // 2
        return _replies(batch.iloc[:half], generate) + _replies(batch.iloc[half:], generate)
