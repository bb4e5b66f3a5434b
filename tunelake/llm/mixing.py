"""Mixing of sources to target weights by repeating documents.

A source's size is its words. All sources together keep the total size, shared by weight; no target exceeds
``MAX_REPEATS`` times its source's size, and what a capped source cannot take is shared again by weight among the
others, which is a level L with target = min(cap, L * weight). A document is then taken floor(rate) times,
rate = target / source size, and once more if a hash of its key falls below the rate's fraction: a Bernoulli draw
that a rerun repeats.

Only sums per source are shuffled, pre-aggregated by each task, so a source with a third of all documents costs no
task more than another. Ranks and the level are windows over one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-1"
HASH_DIGITS = 12


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, source: str = "source", size: str = "size", weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """``_source``, ``source_size`` and ``target`` of each source; sources rank by code point, NULL last, and take
    the weights in turn. A source without words has target 0."""
    ranked = sizes.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size")).select(
        "*", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())).alias("_rank"),
    )
    turn = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                                                     ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    capped_order = Window.orderBy(F.col("source_size") / F.col("_weight"), "_rank")
    before = capped_order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = max_repeats * F.col("source_size")
    left = turn.select(
        "*", F.sum("source_size").over(everything).alias("_total"), F.sum("_weight").over(everything).alias("_weights"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("_cap_before"),
        F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_weight_before"),
    )
    fits = cap * (F.col("_weights") - F.col("_weight_before")) <= (
        (F.col("_total") - F.col("_cap_before")) * F.col("_weight"))
    capped = left.withColumn("_capped", fits)
    level = capped.select(
        "*",
        F.sum(F.when(F.col("_capped"), cap).otherwise(0)).over(everything).alias("_cap_sum"),
        F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("_weight"))).over(everything).alias("_free_weight"),
    )
    free = (F.col("_total") - F.col("_cap_sum")).cast("double") / F.col("_free_weight") * F.col("_weight")
    return level.select("_source", "source_size",
                        F.when(F.col("_capped"), cap.cast("double")).otherwise(free).alias("target"))


def uniform(key: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the hash of seed and key; NULL keys share one."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** HASH_DIGITS))


def mix(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size).

    Input columns of these names are replaced. A NULL text has size 0, a NULL source is a source of its own (the
    last), rows with equal keys are drawn alike, an empty table gives no rows.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    sized = docs.drop(*added).withColumn("size", n_words(text))
    targets = source_targets(sized.select(source, "size"), source, "size", weights, max_repeats)
    joined = sized.join(targets, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (uniform(key, seed) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("copies", (F.floor(rate) + extra).cast("int")).withColumn(
        "taken", F.col("copies").cast("long") * F.col("size"))


def repeat_documents(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per taken copy, with ``columns`` only."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop(
        "_copy")
