"""Ratings: the log of all of them, the examples captured from good ones, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.functions.json_lines import example_id
from tunelake.operators.conversations import answered_pairs


def thumb_score(direction: Column) -> Column:
    return F.when(direction == "up", F.lit(fixed.THUMB_UP_SCORE)).otherwise(F.lit(fixed.THUMB_DOWN_SCORE))


def feedback_log(ratings: DataFrame) -> DataFrame:
    """Every rating, whatever its score."""
    return ratings.select(F.col("message_id").alias("id"), "score", "ts")


def captured(ratings: DataFrame) -> DataFrame:
    """Ratings good enough to become an example, with both texts present."""
    return ratings.where(
        (F.col("score") >= fixed.USABLE_SCORE) & (F.col("prompt") != "") & (F.col("response") != "")
    )


def rating_capture(ratings: DataFrame, batch_id: int) -> DataFrame:
    """Examples from good ratings, one per message: a rating sent again adds nothing.

    The earliest good rating of a message is kept. ``min_by`` is folded before the shuffle, so a
    message rated very often costs one row per task.
    """
    first = captured(ratings).groupBy("message_id").agg(
        F.min_by(F.struct("prompt", "response", "score"), F.struct("ts", "score")).alias("kept")
    )
    return first.select(
        example_id(F.lit(batch_id), F.col("message_id"), F.col("kept.prompt"), F.col("kept.response"))
        .alias("example_id"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        "message_id",
        F.col("kept.prompt").alias("prompt"),
        F.col("kept.response").alias("response"),
        F.col("kept.score").cast("double").alias("score"),
        F.lit(fixed.RATING_SOURCE).alias("source"),
    )


def capture_replies(messages: DataFrame, thumbs: DataFrame, batch_id: int) -> DataFrame:
    """From what was said and rated to examples: a reply without its first think block, its prompt, the score of its
    thumb. ``thumbs`` has conv_id, turn, direction and ts."""
    pairs = answered_pairs(messages)
    rated = thumbs.join(pairs, ["conv_id", "turn"]).select(
        F.to_json(F.array("conv_id", "turn")).alias("message_id"), thumb_score(F.col("direction")).alias("score"),
        "prompt", "response", "ts")
    return rating_capture(rated, batch_id)


def latest_rating(ratings: DataFrame) -> DataFrame:
    """The rating that counts for each message: the last one sent."""
    return ratings.groupBy("message_id").agg(
        F.max_by("score", F.struct("ts", "score")).alias("score"), F.max("ts").alias("ts")
    )


def rated_messages(messages: DataFrame, ratings: DataFrame) -> DataFrame:
    """Messages with their latest rating; unrated messages stay.

    Both sides have one row per message when they meet, so no key is hot.
    """
    latest = latest_rating(ratings).select("message_id", F.col("score").alias("rating"))
    return messages.join(latest, "message_id", "left")


def feedback_summary(log: DataFrame) -> DataFrame:
    """Per day: ratings, mean score, share good enough to train on."""
    return log.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("ratings"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.avg((F.col("score") >= fixed.USABLE_SCORE).cast("double")), 6).alias("good_share"),
    )


def feedback_rollup(log: DataFrame) -> DataFrame:
    """Histogram of scores by day, with day totals and a grand total."""
    return (
        log.withColumn("day", F.to_date("ts"))
        .rollup("day", "score")
        .agg(F.grouping_id().alias("level"), F.count("*").alias("ratings"))
    )


def compare_variants(scored: DataFrame) -> DataFrame:
    """Adapter against base on the same prompts: mean scores, wins, ties and losses.

    ``scored`` has one row per (prompt_id, variant), variant ``adapter`` or ``base``. The two scores of
    a prompt meet in one aggregate instead of a self-join.
    """
    pairs = scored.groupBy("prompt_id").agg(
        F.max(F.when(F.col("variant") == "adapter", F.col("score"))).alias("adapter"),
        F.max(F.when(F.col("variant") == "base", F.col("score"))).alias("base"),
    ).where("adapter IS NOT NULL AND base IS NOT NULL")
    return pairs.agg(
        F.count("*").alias("prompts"),
        F.round(F.avg("adapter"), 6).alias("adapter_mean"),
        F.round(F.avg("base"), 6).alias("base_mean"),
        F.count_if(F.col("adapter") > F.col("base")).alias("wins"),
        F.count_if(F.col("adapter") == F.col("base")).alias("ties"),
        F.count_if(F.col("adapter") < F.col("base")).alias("losses"),
    )
