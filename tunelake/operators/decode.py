"""Sampling policies over tables of scored candidates, and the requests that carry the parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.functions import params
from tunelake.operators.ordered import HOT_ROWS, mark_hot, with_totals
from tunelake.session import settle

RANKED_LIMIT = fixed.DECODE_PARAMS["top_k"][2]
"""Largest top-k that is cut by rank before the shuffle: the upper bound of the parameter."""

BANDS = 64
"""Bands per unit of scaled score where a request's candidates are not cut by rank."""


def decode_params(updates: DataFrame) -> DataFrame:
    """Parameters after an update that may leave some out, kept inside their bounds."""
    return updates.withColumns({
        name: params.bounded(name, params.overlay(name, F.col(name))) for name in fixed.DECODE_PARAMS
    })


def inference_requests(prompts: DataFrame) -> DataFrame:
    """Rendered prompts with the parameters a generator is given. Sampling is always on."""
    return prompts.withColumns({"top_k": params.sent_top_k(F.col("top_k")), "do_sample": F.lit(True)})


def adjusted_scores(candidates: DataFrame) -> DataFrame:
    """Scores after the repetition penalty, the minimum length and the temperature, in that order.

    A used candidate's positive score is divided by the penalty, a negative one multiplied. Below the
    minimum length a request's end candidate is not eligible, and neither is a masked one (minus infinity), which
    has no probability.
    """
    penalized = F.when(F.col("logit") > 0, F.col("logit") / F.col("repetition_penalty")).otherwise(
        F.col("logit") * F.col("repetition_penalty")
    )
    barred = F.col("is_end") & (F.col("n_generated") < F.col("min_new_tokens"))
    masked = F.col("logit") == F.lit(float("-inf"))
    return candidates.where(~barred & ~masked).select(
        "request_id", "candidate", "top_k", "top_p",
        (F.when(F.col("used"), penalized).otherwise(F.col("logit")) / F.col("temperature")).alias("score"),
    )


def decode_policy(candidates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The candidates each request may draw from, with their probabilities.

    Needs request_id, candidate (unique per request), logit, used, is_end, n_generated and the decode
    parameters. After the score adjustments come the top-k cut (0 is off) and the nucleus: the smallest
    set of best candidates whose mass reaches ``top_p``. Requests with a moderate top-k are cut by
    rank before the shuffle and are small from there on; the others are
    weighed in score bands, where they have more than ``hot_rows`` candidates.
    """
    scores = adjusted_scores(candidates)
    ranked_early = F.col("top_k").between(1, RANKED_LIMIT)
    small = _small_requests(scores.where(ranked_early))
    ranked_late = _weighed(scores.where(F.col("top_k") > RANKED_LIMIT), hot_rows).where("rank <= top_k")
    uncut = scores.where("top_k <= 0").unionByName(ranked_late.select(*scores.columns))
    columns = ["request_id", "candidate", "rank", "probability", "cumulative"]
    return small.select(*columns).unionByName(_large_requests(uncut, hot_rows).select(*columns))


def _in_nucleus(mass_before: Column) -> Column:
    """Rounded, so that both sides of a tie at the boundary agree."""
    return F.round(mass_before, 9) < F.col("top_p")


def _small_requests(scores: DataFrame) -> DataFrame:
    best_first = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "candidate")
    upto = best_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("request_id")
    top = scores.withColumn("rank", F.row_number().over(best_first)).where(
        (F.col("rank") <= RANKED_LIMIT) & (F.col("rank") <= F.col("top_k"))
    )
    weighed = top.withColumn("_weight", F.exp(F.col("score") - F.max("score").over(whole)))
    massed = weighed.withColumns({
        "_upto": F.sum("_weight").over(upto), "_total": F.sum("_weight").over(whole),
    })
    kept = massed.where(_in_nucleus((F.col("_upto") - F.col("_weight")) / F.col("_total")))
    return _shares(kept.withColumn("_kept", F.sum("_weight").over(whole)))


def _large_requests(scores: DataFrame, hot_rows: int) -> DataFrame:
    """The nucleus is stored before its mass is summed: both the sums and the rows need it."""
    kept = _weighed(scores, hot_rows).where(_in_nucleus((F.col("_upto") - F.col("_weight")) / F.col("_total")))
    kept = settle(kept.drop("score", "top_k", "top_p", "_total"))
    return _shares(with_totals(kept, ["request_id"], ["candidate"], {"_kept": ("sum", F.col("_weight"))}, hot_rows=hot_rows))


def _weighed(scores: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank, softmax weight, mass up to each candidate and total mass, for requests of any size.

    A request with very many candidates is cut into narrow bands of score. Inside a band weights are
    taken relative to the band's upper edge, so they cannot overflow; over the bands' sums they are
    brought to the edge of the best band, and what precedes a band joins it as its first row.
    """
    marked = mark_hot(scores, ["request_id"], hot_rows)
    banded = marked.withColumn("_band", F.when(F.col("_hot"), F.floor(-F.col("score") * BANDS).cast("bigint")))
    edge = -F.col("_band") / BANDS
    sums = banded.where("_hot").groupBy("request_id", "_band").agg(
        F.count("*").alias("_n"), F.sum(F.exp(F.col("score") - edge)).alias("_mass")
    )
    whole = Window.partitionBy("request_id")
    before = whole.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    scaled = sums.withColumn("_best", F.min("_band").over(whole)).withColumn(
        "_mass", F.col("_mass") * F.exp((F.col("_best") - F.col("_band")) / BANDS)
    )
    carries = scaled.select(
        "request_id", "_band", F.lit(False).alias("_is_row"), (-F.col("_best") / BANDS).alias("_top"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_count"),
        F.coalesce(F.sum("_mass").over(before), F.lit(0.0)).alias("_mass"),
        F.sum("_mass").over(whole).alias("_total"),
    )
    band = Window.partitionBy("request_id", "_band")
    local = band.orderBy("_is_row", F.col("score").desc(), "candidate")
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = banded.withColumns({"_is_row": F.lit(True), "_count": F.lit(1)})
    placed = rows.unionByName(carries, allowMissingColumns=True).withColumns({
        # A request of one band has no carried row: its best score and its mass are those of the band.
        "_top": F.coalesce(F.first("_top").over(upto), F.max("score").over(band)),
        "_total": F.first("_total").over(upto),
        "rank": F.sum("_count").over(upto),
    })
    weight = F.when(F.col("_is_row"), F.exp(F.col("score") - F.col("_top"))).otherwise(F.col("_mass"))
    weighed = placed.withColumn("_weight", weight).withColumns({
        "_upto": F.sum("_weight").over(upto),
        "_total": F.coalesce("_total", F.sum("_weight").over(band)),
    })
    return weighed.where("_is_row").select(*scores.columns, "rank", "_weight", "_upto", "_total")


def _shares(kept: DataFrame) -> DataFrame:
    return kept.withColumns({
        "rank": F.col("rank").cast("bigint"),
        "probability": F.col("_weight") / F.col("_kept"),
        "cumulative": F.col("_upto") / F.col("_kept"),
    })


def uniform_draw(request_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends only on the seed and the request."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), request_id.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(16**8)


def decode_sample(policy: DataFrame, seed: int = 0) -> DataFrame:
    """One candidate per request, drawn by its probability; the same seed draws the same again."""
    reached = policy.where(F.round("cumulative", 9) > uniform_draw(F.col("request_id"), seed))
    return reached.groupBy("request_id").agg(F.min_by("candidate", "rank").alias("candidate"))
