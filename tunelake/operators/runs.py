"""Training logs folded to run metrics, loss curves, final status and start checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.functions.json_lines import number, with_json
from tunelake.functions.text import blank_to_null, strip, valid_adapter_name
from tunelake.operators.ordered import ordered_scan, position_chunk

CURVE_BLOCK = 4_096
"""Losses per array in :func:`loss_history`."""


def parse_log(logs: DataFrame) -> DataFrame:
    """One row per non-blank line: metrics of marked lines, the status or error a line stands for.

    A marked line that cannot be read is kept with no metrics. Keywords count on every line, in order;
    an error prefix counts only where no keyword does.
    """
    lines = logs.withColumn("line", strip(F.col("line")))
    mark = F.lit(len(fixed.LOG_MARK) + 1)
    marked = lines.withColumn(
        "_body", F.when(F.col("line").startswith(fixed.LOG_MARK),
                        strip(F.substring(F.col("line"), mark, F.char_length("line"))))
    )
    readable = F.col("_one") & F.col("_body").startswith("{")
    fields = with_json(marked, "_body").withColumns({"_readable": readable} | {
        f"_{name}": F.when(readable, F.try_variant_get("_json", f"$[0].{name}", "variant"))
        for name in ("loss", "epoch")
    })
    kinds = fields.withColumns({f"_{name}_kind": F.schema_of_variant(f"_{name}") for name in ("loss", "epoch")})
    keyword: Column = F.lit(None).cast("string")
    for text, status in reversed(fixed.LOG_STATUSES):
        keyword = F.when(F.contains(F.col("line"), F.lit(text)), F.lit(status)).otherwise(keyword)
    is_error = F.lit(False)
    for prefix in fixed.LOG_ERROR_PREFIXES:
        is_error = is_error | F.col("line").startswith(prefix)
    numbers = kinds.withColumns({name: number(f"_{name}", f"_{name}_kind") for name in ("loss", "epoch")})
    keywords = numbers.withColumn("_keyword", keyword)
    known = F.col("_keyword").isNotNull()
    described = F.struct(
        F.when(F.col("_readable"), F.lit("metrics"))
        .when(known, F.lit("status"))
        .when(is_error, F.lit("error"))
        .otherwise(F.lit("other")).alias("kind"),
        "loss", "epoch",
        F.coalesce("_keyword", F.when(F.col("loss").isNotNull(), F.lit("Training..."))).alias("status"),
        F.when(~known & is_error, F.col("line")).alias("error"),
    )
    # The blank lines go last: a filter on this side of ``inline`` is not evaluated again below it.
    return keywords.select(*logs.columns, F.inline(F.array(described))).where("line <> ''")


def run_metrics(parsed: DataFrame, total_epochs: int = fixed.EPOCHS) -> DataFrame:
    """One row per run: its latest loss, epoch, status and error, whatever order the lines arrive in.

    Every column is a partial aggregate, so a run of any length is folded before the shuffle. The
    losses themselves are in :func:`loss_history`.
    """
    return finish_metrics(parsed.groupBy("run_id").agg(*metric_folds()), total_epochs)


def metric_folds() -> list[Column]:
    def latest(name: str) -> Column:
        value = F.col(name)
        return F.max_by(value, F.when(value.isNotNull(), F.col("seq"))).alias(name)

    return [latest("loss"), latest("epoch"), latest("status"), latest("error"),
            F.count("loss").alias("n_losses")]


def finish_metrics(folded: DataFrame, total_epochs: int = fixed.EPOCHS) -> DataFrame:
    step = F.coalesce("epoch", F.lit(0.0))
    return folded.select(
        "run_id",
        F.coalesce("loss", F.lit(0.0)).alias("loss"),
        step.alias("step"),
        F.coalesce(perplexity(F.col("loss")), F.lit(0.0)).alias("perplexity"),
        F.coalesce("status", F.lit("Starting...")).alias("status"),
        F.least(F.lit(100.0), F.lit(100.0) * step / total_epochs).alias("progress"),
        F.lit(total_epochs).alias("total_epochs"),
        F.coalesce("error", F.lit("")).alias("error"),
        "n_losses",
    )


def perplexity(loss: Column) -> Column:
    return F.pow(F.lit(fixed.PERPLEXITY_BASE), loss)


def run_status(metrics: DataFrame, exits: DataFrame, started: DataFrame | None = None) -> DataFrame:
    """Metrics with the final status of the runs that have ended. Every side has one row per run.

    ``started`` (run_id, model, adapter) adds what each run trains.
    """
    if started is not None:
        metrics = metrics.join(started.select("run_id", "model", "adapter"), "run_id", "left")
    ended, clean = F.col("exit_code").isNotNull(), F.col("exit_code") == 0
    code_error = F.format_string("Training process exited with code %d", F.col("exit_code"))
    return metrics.join(exits, "run_id", "left").withColumns({
        "status": F.when(clean, F.lit("Complete")).when(ended, F.lit("Failed")).otherwise(F.col("status")),
        "progress": F.when(clean, F.lit(100.0)).otherwise(F.col("progress")),
        "error": F.when(ended & ~clean, F.coalesce(F.nullif("error", F.lit("")), code_error))
        .otherwise(F.col("error")),
    })


def loss_points(parsed: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """The losses of each run in log order, numbered from 1.

    ``logs``, the lines before parsing, spares a second parse where ``parsed`` is not stored: they are
    counted instead to see which runs are very long.
    """
    return ordered_scan(
        _losses(parsed), ["run_id"], ["seq"], position_chunk("seq"), running={"i": F.lit(1)}, sized_by=logs
    )


def _losses(parsed: DataFrame) -> DataFrame:
    return parsed.where("loss IS NOT NULL").select("run_id", "seq", "loss")


def loss_history(parsed: DataFrame, logs: DataFrame | None = None, block: int = CURVE_BLOCK) -> DataFrame:
    """The losses of each run as ordered arrays of ``block`` values; a short run is one array."""
    points = loss_points(parsed, logs).withColumn("block", F.floor((F.col("i") - 1) / block))
    return points.groupBy("run_id", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "loss"))), lambda p: p["loss"]).alias("losses")
    )


def loss_curve_summary(parsed: DataFrame) -> DataFrame:
    """First, last and range of each curve that has at least two points."""
    folded = parsed.where("loss IS NOT NULL").groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.min_by("loss", "seq").alias("first"),
        F.max_by("loss", "seq").alias("last"),
        F.min("loss").alias("min"),
        F.max("loss").alias("max"),
    )
    return folded.where("n >= 2").withColumn("span", curve_span(F.col("min"), F.col("max")))


def loss_curve_points(parsed: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Each curve scaled to the unit square; whoever draws it adds size and padding."""
    loss = F.col("loss")
    points = ordered_scan(
        _losses(parsed), ["run_id"], ["seq"], position_chunk("seq"), running={"i": F.lit(1)}, sized_by=logs,
        totals={"n": ("sum", F.lit(1)), "low": ("min", loss), "high": ("max", loss)},
    ).where("n >= 2")
    return points.select(
        "run_id", "i",
        ((F.col("i") - 1) / (F.col("n") - 1)).alias("x"),
        ((loss - F.col("low")) / curve_span(F.col("low"), F.col("high"))).alias("y"),
    )


def curve_span(low: Column, high: Column) -> Column:
    return F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))


def training_target(plans: DataFrame) -> DataFrame:
    """The model a run trains: the requested one, else the loaded one, else the default."""
    return plans.withColumn(
        "target",
        F.coalesce(F.nullif("requested", F.lit("")), F.nullif("current", F.lit("")), F.lit(fixed.DEFAULT_MODEL)),
    )


def base_model(picked: Column, current: Column, first_known: Column) -> Column:
    """The model offered for a run: picked, else current, else the first known one."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (picked, current, first_known)])


def run_blockers(plans: DataFrame) -> DataFrame:
    """Why each planned run cannot start, in order; an empty list means it can.

    Needs online, eligible, model, adapter_name and is_training.
    """
    checks = [
        (~F.col("online"), fixed.BLOCKER_OFFLINE),
        (F.col("eligible") == 0, fixed.BLOCKER_NO_EXAMPLES),
        (blank_to_null(F.col("model")).isNull(), fixed.BLOCKER_NO_MODEL),
        (~valid_adapter_name(F.col("adapter_name")), fixed.BLOCKER_BAD_NAME),
        (F.col("is_training"), fixed.BLOCKER_TRAINING),
    ]
    return plans.withColumn(
        "blockers", F.array_compact(F.array(*[F.when(failed, F.lit(text)) for failed, text in checks]))
    )
