"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all preceding turns are its context and only its reply is
trainable. :func:`format_turns` gives every formatted turn once, as a piece of its conversation's text, and
:func:`examples` expands these: an example's text is the whole prefix up to its reply. The examples of a conversation of
n turns hold about n^2 / 4 turns. They are written by tasks that have a share of a conversation's replies each, and what
is shuffled is pieces, not examples.

Texts cannot forge the template: every control string inside a text or role gets one backslash after its first
character (and one more if backslashes are there already), which :func:`unescape` takes away again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])"
TRAINED_ROLE = "assistant"

PIECES = ("conv_id {kind}, seq long, example long, trainable boolean, piece string, start long, loss_start long, "
          "loss_end long")
EXAMPLES = ("conv_id {kind}, example long, context_turns long, context_chars long, text string, loss_start long, "
            "loss_end long")

REPLIES = 64
"""Examples of a conversation that a task writes out at a time."""

BATCH_CHARS = 4 << 20


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role is one line: backslashes are doubled and line feeds written as ``\\n`` before control strings."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Backslash pairs are read from the left, so that an escaped backslash before an n stays apart from a line feed."""
    # Every match is a whole escape: pairs keep their second half, and an n after an odd backslash is a line feed.
    pieces = F.regexp_extract_all(unescape(role), F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    read = F.transform(pieces, lambda p: F.when(p == "\\n", F.lit("\n")).when(p == "\\\\", F.lit("\\")).otherwise(p))
    return F.array_join(read, "")


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the turns of each conversation and adds their offsets; rows come sorted by conversation and turn."""
    current, seq, example, at, begun = None, 0, 0, 0, False
    for batch in batches:
        convs = batch.column(0).to_pylist()
        lengths, heads, bodies = (batch.column(i).to_pylist() for i in (2, 3, 4))
        trained = batch.column(5).to_pylist()
        seqs, examples, starts, lows, highs = [], [], [], [], []
        for conv, length, head, body, train in zip(convs, lengths, heads, bodies, trained, strict=True):
            if not begun or conv != current:
                current, seq, example, at, begun = conv, 0, 0, 0, True
            seqs.append(seq)
            examples.append(example)
            starts.append(at)
            lows.append(at + head if train else None)
            highs.append(at + head + body if train else None)
            seq, example, at = seq + 1, example + train, at + length
        columns = [batch.column(0), pa.array(seqs, pa.int64()), pa.array(examples, pa.int64()), batch.column(5),
                   batch.column(1), *(pa.array(x, pa.int64()) for x in (starts, lows, highs))]
        yield pa.RecordBatch.from_arrays(
            columns, names=["conv_id", "seq", "example", "trainable", "piece", "start", "loss_start", "loss_end"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """One piece per turn: its place ``seq``, the ``example`` that first holds it (the number of replies before),
    the formatted text ``piece``, its offset ``start`` in the conversation's text, and for replies the trainable
    span there. Offsets count code points.

    Needs ``conv_id, turn, role, text``; other columns are left out. Turns sort by turn (NULL first), equal ones by
    role and text. A NULL text or role is empty, rows with a NULL conversation are one conversation, repeated rows
    are turns of their own, an empty table gives no rows. A conversation is placed by one task as a stream: memory
    does not grow with it.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(TURN_START), escape_role(role), F.lit("\n"))
    turns = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    piece = F.concat("head", "body", F.lit(TURN_END + "\n"))
    rows = ordered.select(
        "conv_id", piece.alias("piece"), F.char_length(piece).alias("length"), F.char_length("head").alias("head"),
        F.char_length("body").alias("body"), (F.col("role") == TRAINED_ROLE).alias("trained"))
    return rows.mapInArrow(_place, PIECES.format(kind=conversations.schema["conv_id"].dataType.simpleString()))


def _expand(batches: Iterator[pa.RecordBatch], replies: int) -> Iterator[pa.RecordBatch]:
    """The examples of each part of a conversation, written out; rows come sorted by conversation, part and turn."""
    current, text, rows, size = None, [], [], 0
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, part, seq, example, train, piece, start, low, high in zip(
                *(c.to_pylist() for c in batch.columns), strict=True):
            if current != (conv, part):
                current, text = (conv, part), []
            text.append(piece)
            if train and example // replies == part:
                text = ["".join(text)]
                rows.append((conv, example, seq, start, text[0], low, high))
                size += len(text[0])
            if size >= BATCH_CHARS:
                yield _written(rows, kind)
                rows, size = [], 0
    if rows:
        yield _written(rows, kind)


def _written(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "example", "context_turns", "context_chars", "text", "loss_start", "loss_end"]
    kinds = (kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def examples(pieces: DataFrame, replies: int = REPLIES) -> DataFrame:
    """One row per reply, by prefix-target expansion: ``text`` is the example written out whole, the formatted
    ``context_turns`` turns (``context_chars`` code points) before the reply and the reply; its code points from
    ``loss_start`` to ``loss_end`` are trainable. No reply, no example; an empty table gives no rows.

    A task writes ``replies`` examples of a conversation at a time and is sent the pieces up to the last of these, so
    that a long conversation is spread; it holds the text of one example and a batch of ``BATCH_CHARS``.
    """
    last = F.max(F.when(F.col("trainable"), F.col("example"))).over(Window.partitionBy("conv_id"))
    parts = pieces.withColumn("_last", last).where("example <= _last").withColumn(
        "_part", F.explode(F.expr(f"sequence(example div {replies}, _last div {replies})")))
    rows = parts.repartition("conv_id", "_part").sortWithinPartitions("conv_id", "_part", "seq").select(
        "conv_id", "_part", "seq", "example", "trainable", "piece", "start", "loss_start", "loss_end")
    return rows.mapInArrow(
        lambda batches: _expand(batches, replies), EXAMPLES.format(kind=pieces.schema["conv_id"].dataType.simpleString()))


def trained_texts(found: DataFrame) -> DataFrame:
    """``conv_id, example, context_turns`` and ``loss_text`` of :func:`examples`: what the loss mask of each example shows
    of its text, unescaped."""
    span = F.expr("substring(text, int(loss_start + 1), int(loss_end - loss_start))")
    return found.select("conv_id", "example", "context_turns", unescape(span).alias("loss_text"))


def example_texts(pieces: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end`` of :func:`examples`."""
    return examples(pieces).select("conv_id", "example", "text", "loss_start", "loss_end")


def read_back(pieces: DataFrame) -> DataFrame:
    """Role and text of every piece, as read from the formatted text."""
    body = F.expr(f"substring(piece, {len(TURN_START) + 1}, char_length(piece) - {len(TURN_START + TURN_END) + 1})")
    parts = pieces.withColumn("_body", body).withColumn("_head", F.instr("_body", "\n"))
    return parts.select(
        "conv_id", "seq", unescape_role(F.expr("substring(_body, 1, _head - 1)")).alias("role"),
        unescape(F.expr("substring(_body, _head + 1)")).alias("text"), F.char_length("piece").alias("chars"))
