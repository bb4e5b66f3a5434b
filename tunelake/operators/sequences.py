"""Training text to fixed-length sequences, token budgets and the batch plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.functions import chat, sequence
from tunelake.operators.ordered import number_rows
from tunelake.session import settle

END_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2
COMMON_TOKENS = 32_000
"""Tokens that :func:`vocabulary_encoder` knows; :func:`tokenize_once` knows all."""

BLOCKS_PER_PARTITION = 4
"""Blocks of texts that share a dictionary: more of them are smaller in memory and ask for common tokens again."""


def training_text(pairs: DataFrame) -> DataFrame:
    """Adds ``prefix`` and ``full_text`` to prompt/response rows."""
    return pairs.withColumns({
        "prefix": chat.training_prefix(F.col("prompt")),
        "full_text": chat.training_text(F.col("prompt"), F.col("response")),
    })


def vocabulary(texts: DataFrame, column: str = "full_text", size: int | None = None) -> DataFrame:
    """All tokens, or the ``size`` most frequent, with their ids by frequency (ties by token).

    Token counts are folded before the shuffle. Ranks are taken inside chunks of equal count and first letters, to
    which the chunk sizes give their offsets, so no task ranks the whole vocabulary.
    """
    counts = (
        texts.select(F.explode(sequence.tokens(F.col(column))).alias("token"))
        .where(F.col("token") != fixed.END_TOKEN)
        .groupBy("token")
        .agg(F.count("*").alias("uses"))
    )
    return ranked_vocabulary(counts, size)


def ranked_vocabulary(counts: DataFrame, size: int | None = None) -> DataFrame:
    """Ids of counted tokens (``token, uses``), the most used first."""
    keyed = counts.select("token", "uses", (-F.col("uses")).alias("_less"), F.substring("token", 1, 2).alias("_first"))
    ranked = number_rows(keyed, ["_less", "token"], ["_less", "_first"], "_rank")
    best = ranked if size is None else ranked.where(F.col("_rank") <= size)
    return best.select("token", "uses", (F.col("_rank") + (FIRST_ID - 1)).cast("int").alias("token_id"))


def vocabulary_encoder(vocabulary_rows: DataFrame, size: int = COMMON_TOKENS) -> Callable[[Column], Column]:
    """Text to ids by the ``size`` most frequent tokens, without shuffling a token; others are unknown.

    The size bounds what is sent to every task. Each Arrow batch is looked up as one flat array.
    """
    ranked = vocabulary_rows.where(F.col("token_id") < FIRST_ID + size).orderBy("token_id").toPandas()
    known = pa.array(ranked["token"], pa.string())
    ids = pa.array(np.append(ranked["token_id"].to_numpy(np.int32), [END_ID, UNKNOWN_ID]), pa.int32())
    known = pa.concat_arrays([known, pa.array([fixed.END_TOKEN], pa.string())])
    unknown_slot = len(known)

    @F.arrow_udf("array<int>")
    def encode(batch: pa.Array) -> pa.Array:
        if isinstance(batch, pa.ChunkedArray):
            batch = batch.combine_chunks()
        flat = batch.flatten()
        slots = pc.fill_null(pc.index_in(flat.cast(pa.string()), value_set=known), unknown_slot)
        lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.take(slots))

    return lambda text: encode(sequence.tokens(text))


def callable_encoder(load_tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Callable[[Column], Column]:
    """Text to ids by a caller's batch tokenizer, loaded once per task."""
    loaded: list[Callable[[list[str]], list[list[int]]]] = []

    @F.arrow_udf("array<int>")
    def encode(batch: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(load_tokenizer())
        return pa.array(loaded[0](batch.to_pylist()), pa.list_(pa.int32()))

    return lambda text: encode(text)


def tokenize(texts: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """Adds ``ids`` of the full text and ``n_prompt``, the tokens of its prefix. No shuffle.

    Keep these unpadded ids in storage; pad on the way to the trainer.
    """
    return texts.withColumn("ids", encode(F.col("full_text"))).withColumn(
        "n_prompt", F.size(encode(F.col("prefix")))
    )


def tokenize_by_words(texts: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """As :func:`tokenize` for the vocabulary encoder, whose prefix length needs no lookup."""
    return texts.withColumn("ids", encode(F.col("full_text"))).withColumn(
        "n_prompt", F.size(sequence.tokens(F.col("prefix")))
    )


def in_token_blocks(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``texts`` dealt to ``_block`` by ``keys`` with their tokens, for :func:`block_dictionary` and :func:`encode_blocks`.

    Stored in the shared folder, so that the counts and the encoding read the tokens of one cut.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64(*keys), F.lit(n * BLOCKS_PER_PARTITION)).cast("int")
    return settle(texts.withColumns({
        "_block": block,
        "_tokens": sequence.tokens(F.col("full_text")),
        "n_prompt": F.size(sequence.tokens(F.col("prefix"))),
    }).repartition(n, "_block"))


def block_dictionary(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vocabulary of :func:`vocabulary` (``token, uses, token_id``), and what each block needs of it (``_home``, its
    block, ``token, token_id``).

    A block asks once for each of its distinct tokens, with its own count, and gets the id back. A token that every
    block has is a row per block, whatever its uses.
    """
    asked = settle(blocks.select("_block", F.explode("_tokens").alias("token")).where(
        F.col("token") != fixed.END_TOKEN).groupBy("_block", "token").agg(F.count("*").alias("uses")))
    counts = asked.groupBy("token").agg(F.sum("uses").alias("uses"))
    words = settle(ranked_vocabulary(counts))
    return words, asked.select(F.col("_block").alias("_home"), "token").join(words.select("token", "token_id"), "token")


def encode_blocks(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """The texts of ``blocks`` with ``ids`` and ``n_prompt``; a token without an answer is unknown. Each block meets its
    own dictionary only, and its tokens are looked up as one flat array."""
    names = [name for name in blocks.columns if name not in ("_block", "_tokens")]
    kinds = dict(blocks.dtypes)

    def encode(rows: pa.Table, known: pa.Table) -> pa.Table:
        tokens = rows["_tokens"].combine_chunks()
        if isinstance(tokens, pa.ChunkedArray):
            tokens = pa.concat_arrays(tokens.chunks) if tokens.num_chunks else pa.array([], pa.list_(pa.string()))
        words = pa.concat_arrays([pa.array([fixed.END_TOKEN]), *(c.cast(pa.string()) for c in known["token"].chunks)])
        ids = pa.concat_arrays([pa.array([END_ID], pa.int32()), *known["token_id"].chunks, pa.array([UNKNOWN_ID], pa.int32())])
        slots = pc.fill_null(pc.index_in(tokens.flatten().cast(pa.string()), value_set=words), len(words))
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
        found = pa.ListArray.from_arrays(offsets, ids.take(slots))
        return rows.select(names).append_column("ids", found)

    schema = ", ".join(f"`{name}` {kinds[name]}" for name in names) + ", ids array<int>"
    return blocks.groupBy("_block").cogroup(answers.groupBy("_home")).applyInArrow(
        lambda rows, known: encode(rows, known), schema)


def tokenize_once(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As :func:`tokenize_by_words` with the vocabulary of the texts themselves, an id for every token of it.

    Texts are read, cut and dealt once: their blocks send distinct tokens, get ids back and encode in place. No token's
    place is shuffled and nothing is collected. ``keys`` deal the rows; they should name few rows each.
    """
    blocks = in_token_blocks(texts, keys)
    return encode_blocks(blocks, block_dictionary(blocks)[1])


def pad_truncate(tokenized: DataFrame, length: int = fixed.MAX_LENGTH, pad: int = END_ID) -> DataFrame:
    return tokenized.withColumns({
        "input_ids": sequence.input_ids(F.col("ids"), pad, length),
        "attention_mask": sequence.attention_mask(F.size("ids"), length),
    })


def label_mask(tokenized: DataFrame, length: int = fixed.MAX_LENGTH, pad: int = END_ID) -> DataFrame:
    """The training sequence of each row. A prompt that fills the length leaves nothing to learn from;
    such a row stays and is flagged."""
    n_tokens = F.size("ids")
    return pad_truncate(tokenized, length, pad).withColumns({
        "labels": sequence.labels(F.col("ids"), F.col("n_prompt"), length),
        "n_tokens": n_tokens,
        "truncated": n_tokens > length,
        "fully_masked": F.col("n_prompt") >= F.least(n_tokens, F.lit(length)),
    })


def token_budget(tokenized: DataFrame, length: int = fixed.MAX_LENGTH) -> DataFrame:
    """What the sequence limit costs: tokens trained on, rows cut, rows without a target, padding share."""
    n_tokens = F.size("ids")
    kept = F.least(n_tokens, F.lit(length))
    trained = F.greatest(kept - F.col("n_prompt"), F.lit(0))
    return tokenized.agg(
        F.count("*").alias("n_rows"),
        F.sum("n_prompt").alias("prompt_tokens"),
        F.sum(n_tokens - F.col("n_prompt")).alias("response_tokens"),
        F.count_if(n_tokens > length).alias("truncated_rows"),
        F.count_if(trained == 0).alias("fully_masked_rows"),
        F.sum(trained).alias("trained_tokens"),
        F.round(1 - F.sum(kept) / (F.count("*") * length), 6).alias("padding_share"),
    )


def batch_manifest(
    examples: DataFrame, epochs: int = fixed.EPOCHS, batch_size: int = fixed.BATCH_SIZE,
    accumulation: int = fixed.ACCUMULATION, seed: int = 0, id_column: str = "example_id",
    hex_digits: int = 3,
) -> DataFrame:
    """Which example goes into which batch and optimizer step, shuffled anew in each epoch.

    The order is the md5 of seed, epoch and id. Its leading hex digits cut an epoch into even buckets;
    rows are ranked per bucket, and the bucket sizes (``16 ** hex_digits * epochs`` rows, whatever the
    data) give each bucket its offset.
    """
    ids = examples.select(F.col(id_column).cast("string").alias("example_id"))
    epoch_rows = ids.select("example_id", F.explode(F.array(*[F.lit(e) for e in range(epochs)])).alias("epoch"))
    draws = epoch_rows.withColumn(
        "_draw", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("epoch").cast("string"), "example_id"))
    ).withColumn("_bucket", F.substring("_draw", 1, hex_digits))
    sizes = draws.groupBy("epoch", "_bucket").agg(F.count("*").alias("_size"))
    ahead = Window.partitionBy("epoch").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "epoch", "_bucket", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_offset")
    )
    rank = F.row_number().over(Window.partitionBy("epoch", "_bucket").orderBy("_draw", "example_id"))
    ranked = draws.withColumn("_rank", rank).join(F.broadcast(offsets), ["epoch", "_bucket"])
    position = (F.col("_offset") + F.col("_rank") - 1).cast("bigint")
    batch = F.floor(position / batch_size)
    return ranked.select(
        "epoch", "example_id", position.alias("position"), batch.alias("batch"),
        F.floor(batch / accumulation).alias("step"),
    )
