"""Model status, polling, parameter bursts and waiting adapter requests, all ordered per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.operators.ordered import EvenChunks, ordered_scan
from tunelake.session import settle

EVENTS = EvenChunks("ts", ("ts", "event_id"))
"""Keys of very many events are cut by rows, wherever in time these lie."""


def status_transitions(statuses: DataFrame, key: str = "host", **scan) -> DataFrame:
    """Loads that finished or failed, and model changes. A key starts idle with no model.

    Needs the key, ts, event_id (breaks ties in time), status and model.
    """
    steps = ordered_scan(
        statuses, [key], ["ts", "event_id"], EVENTS, **scan,
        previous={"prev_status": F.col("status"), "prev_model": F.col("model")},
    )
    was_loading = F.coalesce("prev_status", F.lit("idle")).isin(fixed.LOADING_STATUSES)
    return steps.withColumns({
        "transition": F.when(was_loading & (F.col("status") == "ready"), F.lit("loaded"))
        .when(was_loading & (F.col("status") == "error"), F.lit("failed")),
        "model_changed": ~F.col("model").eqNullSafe(F.col("prev_model")),
    }).where("transition IS NOT NULL OR model_changed")


def offline_spells(polls: DataFrame, key: str = "host", **scan) -> DataFrame:
    """Spells of at least two failed polls in a row: start, the poll that made it an outage, recovery.

    Polls between two successes share the number of successes before them, and a spell is a partial
    aggregate over that number, so an outage of any length is folded before the shuffle.
    """
    ok = F.col("ok")
    numbered = ordered_scan(
        polls, [key], ["ts", "event_id"], EVENTS, **scan,
        running={"successes": ok.cast("bigint")}, previous={"prev_ok": ok},
    )
    spell = F.when(ok, F.col("successes") - 1).otherwise(F.col("successes"))
    # Only failures and the success right after one belong to a spell; the rest never reach the shuffle.
    concerned = numbered.where(~ok | ~F.col("prev_ok"))
    folded = concerned.groupBy(key, spell.alias("spell")).agg(
        F.count_if(~ok).alias("failures"),
        F.min(F.when(~ok, F.col("ts"))).alias("first_failure"),
        F.min(F.when(~ok & ~F.coalesce("prev_ok", F.lit(True)), F.col("ts"))).alias("offline_at"),
        F.min(F.when(ok, F.col("ts"))).alias("recovered_at"),
    )
    return folded.where(F.col("failures") >= fixed.OFFLINE_AFTER).drop("spell")


def load_stage_times(progress: DataFrame, **scan) -> DataFrame:
    """Time from each load milestone to the attempt's next report; NULL for the last one.

    Needs attempt, ts, event_id and progress.
    """
    steps = _with_next(progress, ["attempt"], {"next_ts": F.col("ts")}, **scan)
    micros = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return steps.where(F.col("progress").isin(fixed.LOAD_MILESTONES)).withColumn("micros", micros)


def _with_next(df: DataFrame, keys: list[str], following: dict[str, Column], **scan) -> DataFrame:
    return ordered_scan(
        df, keys, ["ts", "event_id"], EVENTS, previous=following, descending=True, **scan
    )


def debounce(
    changes: DataFrame, key: str = "session", quiet_millis: int = fixed.DEBOUNCE_MILLIS,
    **scan,
) -> DataFrame:
    """The last value of each burst of changes, applied once nothing more came for the quiet time.

    Needs the key, ts, event_id and value.
    """
    steps = _with_next(changes, [key], {"next_ts": F.col("ts")}, **scan)
    pause = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return steps.where(F.col("next_ts").isNull() | (pause >= quiet_millis * 1000)).select(key, "ts", "value")


def pending_intents(intents: DataFrame, results: DataFrame, key: str = "session", **scan) -> DataFrame:
    """What became of each request to use an adapter on a model.

    A request for the current model applies at once. Any other waits for the first later load of its
    model (applied) or failed load (dropped); a newer waiting request replaces it. ``intents`` needs
    the key, ts, event_id, model, adapter and current_model; ``results`` the key, ts, event_id, outcome
    (``ready`` or ``error``) and model.

    One forward scan tells every event which request is waiting when it comes. What ends a wait is then a partial fold
    over the request's own events, so that no request is joined to the results after it. Both inputs are read once.
    """
    at = F.struct("ts", "event_id")
    events = settle(intents.withColumn("kind", F.when(F.col("model").eqNullSafe(F.col("current_model")), F.lit("now"))
                                       .otherwise(F.lit("intent"))).unionByName(
        results.withColumnRenamed("outcome", "kind"), allowMissingColumns=True
    ).select(key, "ts", "event_id", "kind", "model", "adapter"))
    intent = F.col("kind") == "intent"
    scanned = ordered_scan(
        events, [key], ["ts", "event_id"], EVENTS, **scan,
        last_known={"_waiting": F.when(intent, F.struct("ts", "event_id", "model"))},
    )
    waiting = F.col("_waiting")
    ends = (F.col("kind") == "error") | ((F.col("kind") == "ready") & F.col("model").eqNullSafe(waiting["model"]))
    kinds = {name: events.schema[name].dataType.simpleString() for name in ("ts", "event_id")}
    place = f"ts:{kinds['ts']},event_id:{kinds['event_id']}"
    nothing = F.lit(None)
    own = F.struct(at.alias("request"), F.struct("kind", "model", "adapter").alias("asked"),
                   nothing.cast(f"struct<{place},kind:string>").alias("end"), nothing.cast(f"struct<{place}>").alias("next"))
    other = F.struct(F.struct(waiting["ts"].alias("ts"), waiting["event_id"].alias("event_id")).alias("request"),
                     nothing.cast("struct<kind:string,model:string,adapter:string>").alias("asked"),
                     F.when(ends, F.struct("ts", "event_id", "kind")).alias("end"), F.when(intent, at).alias("next"))
    told = F.filter(F.array(F.when(F.col("kind").isin("now", "intent"), own),
                            F.when(waiting.isNotNull() & (ends | intent), other)), lambda x: x.isNotNull())
    folded = scanned.select(key, F.inline(told)).groupBy(key, "request").agg(
        F.max("asked").alias("asked"), F.min("end").alias("end"), F.min("next").alias("next"))
    first = F.struct(F.col("end.ts").alias("ts"), F.col("end.event_id").alias("event_id"))
    ended = F.col("end").isNotNull()
    outcome = (
        F.when(F.col("asked.kind") == "now", F.lit("applied"))
        .when(F.col("next").isNotNull() & (~ended | (F.col("next") < first)), F.lit("replaced"))
        .when(~ended, F.lit("waiting"))
        .when(F.col("end.kind") == "ready", F.lit("applied"))
        .otherwise(F.lit("dropped"))
    )
    resolved = F.when(F.col("asked.kind") == "now", F.col("request.ts")).when(
        outcome.isin("applied", "dropped"), F.col("end.ts"))
    return folded.select(
        key, F.col("request.event_id").alias("event_id"), F.col("request.ts").alias("ts"),
        F.col("asked.model").alias("model"), F.col("asked.adapter").alias("adapter"), outcome.alias("outcome"),
        resolved.alias("resolved_at"),
    )
