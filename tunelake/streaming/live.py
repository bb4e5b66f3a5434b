"""Run metrics, parameter bursts and status events as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tunelake import fixed_values as fixed
from tunelake.operators.runs import finish_metrics, metric_folds, parse_log


def run_metrics_stream(logs: DataFrame, total_epochs: int = fixed.EPOCHS) -> DataFrame:
    """Metrics per run, updated by each micro-batch. Update or complete mode.

    The same folds as the batch form: state is one row per run, a long run is folded before the
    shuffle, and a late line never replaces a newer one because ``seq`` decides.
    """
    return finish_metrics(parse_log(logs).groupBy("run_id").agg(*metric_folds()), total_epochs)


def loss_stream(logs: DataFrame) -> DataFrame:
    """The losses themselves, to be appended to a table and ordered by ``seq`` when read."""
    return parse_log(logs).where("loss IS NOT NULL").select("run_id", "seq", "loss")


def debounce_stream(
    changes: DataFrame, key: str = "session", quiet_millis: int = fixed.DEBOUNCE_MILLIS, delay: str = "10 minutes"
) -> DataFrame:
    """The last value of each burst of changes, once the watermark has passed its quiet time. Append mode."""
    windows = changes.withWatermark("ts", delay).groupBy(
        key, F.session_window("ts", f"{quiet_millis} milliseconds").alias("burst")
    )
    last = F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id")).alias("last")
    return windows.agg(last).select(key, F.col("last.ts").alias("ts"), F.col("last.value").alias("value"))


STATUS_EVENTS = "host string, ts timestamp, event string"
STATUS_STATE = "micros bigint, event_id bigint, status string, model string, failures int"

STATUS_BUCKETS = 512
PACKED_ROWS = 1 << 17
PACKED_POLLS = "bucket int, low bigint, high bigint, polls binary"
WAITING = "low bigint, high bigint, polls binary"
LAST_POLLS = ["host", "status", "model", "failures"]


def status_stream(polls: DataFrame) -> DataFrame:
    """Events of each host as its polls arrive: ``loaded``, ``failed``, ``model_changed``, ``offline``, ``online``.

    Needs host, ts, event_id, ok, status and model (status and model only where ok). Polls go by (ts, event_id), as in
    the batch form. State is the last poll of a host; polls that arrive in a later micro-batch than a newer poll
    are passed over. One host's polls of one micro-batch meet in a task, so bound
    the micro-batch (files per trigger) by what a task may hold. Append mode.
    """
    return polls.groupBy("host").applyInPandasWithState(
        _status_events, STATUS_EVENTS, STATUS_STATE, "append", GroupStateTimeout.NoTimeout
    )


def _status_events(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    micros, event_id, status, model, failures = state.get if state.exists else (-1, -1, "idle", None, 0)
    events = []
    polls = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for poll in polls.itertuples(index=False):
        at = poll.ts.value // 1000
        if (at, poll.event_id) <= (micros, event_id):
            continue
        micros, event_id = at, int(poll.event_id)
        current = poll.model if isinstance(poll.model, str) else None
        status, model, failures, found = _next_status(status, model, failures, poll.ok, poll.status, current)
        events += [(poll.ts, event) for event in found]
    state.update((micros, event_id, status, model, failures))
    yield pd.DataFrame(
        {"host": [key[0]] * len(events), "ts": pd.to_datetime([e[0] for e in events]),
         "event": [e[1] for e in events]}
    )


def ordered_status_stream(polls: DataFrame, delay: str = "10 minutes", buckets: int = STATUS_BUCKETS) -> DataFrame:
    """As :func:`status_stream`, with every poll in its place: the events of the batch form, whatever the order of arrival.

    Polls wait in state until the watermark (``delay`` behind the newest poll) has passed them, and are then read by
    (ts, event_id). A poll that arrives behind the watermark can't be put in its place any more: it comes out as
    an event ``late``, with nothing else changed; one without a time has no place and is left out. State is kept for
    ``buckets`` shares of the hosts, each with its polls of about ``delay``, packed, and the last poll of each host before
    them, so that costs follow polls and not hosts. A bucket's polls that the watermark passes at once meet in a task;
    size ``buckets`` by that, and keep it for the life of a checkpoint. Append mode; the state store must be RocksDB
    (:func:`use_ordered_state`).
    """
    # The time column itself would let Spark drop late polls unseen; as a number it passes.
    rows = polls.withWatermark("ts", delay).where("ts IS NOT NULL").select(
        F.pmod(F.xxhash64("host"), F.lit(buckets)).cast("int").alias("bucket"), "host",
        F.unix_micros("ts").alias("micros"), F.coalesce("event_id", F.lit(-(1 << 63))).cast("long").alias("event_id"),
        F.coalesce("ok", F.lit(False)).alias("ok"), "status", "model")
    return rows.mapInArrow(_pack_polls, PACKED_POLLS).groupBy("bucket").transformWithStateInPandas(
        _OrderedStatus(), outputStructType=STATUS_EVENTS, outputMode="append", timeMode="EventTime")


def use_ordered_state(spark: SparkSession) -> None:
    """The state store that list state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _pack_polls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket for every ``PACKED_ROWS`` polls: their first and last time, and the polls as one value."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PACKED_ROWS:
            yield _packed(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield _packed(pa.Table.from_batches(held))


def _packed(polls: pa.Table) -> pa.RecordBatch:
    order = np.argsort(polls["bucket"].to_numpy(), kind="stable")
    polls = polls.take(pa.array(order)).combine_chunks()
    bucket, micros = polls["bucket"].to_numpy(), polls["micros"].to_numpy()
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(starts[1:], len(bucket))
    rest = polls.drop_columns(["bucket"])
    values = [_to_bytes(rest.slice(a, b - a)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts], pa.int32()), pa.array(np.minimum.reduceat(micros, starts)),
         pa.array(np.maximum.reduceat(micros, starts)), pa.array(values, pa.binary())],
        names=["bucket", "low", "high", "polls"])


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(value).read_all()


class _OrderedStatus(StatefulProcessor):
    """Keys are buckets of hosts. ``first`` is the millisecond of the earliest waiting poll; a timer stands there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.first = handle.getValueState("first", "millis bigint")
        self.last = handle.getValueState("last", "hosts binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for batch in rows:
            for low, high, value in zip(batch["low"], batch["high"], batch["polls"], strict=True):
                if low // 1000 <= passed:
                    late, fresh = _split(_from_bytes(value), passed)
                    yield _status_rows(late["host"], late["micros"], ["late"] * len(late))
                    if not fresh.num_rows:
                        continue
                    low, high, value = _chunk(fresh)
                self.waiting.appendValue((int(low), int(high), bytes(value)))
                first = low if first is None else min(first, low)
        if first is not None:
            self._expect(int(first) // 1000, self.first.get()[0] if self.first.exists() else None)
        yield _status_rows([], [], [])

    def _expect(self, millis: int, before: int | None = None) -> None:
        if before is None or millis < before:
            self.first.update((millis,))
            self.handle.registerTimer(millis)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        if self.first.exists() and self.first.get()[0] <= passed:
            for low, high, value in self.waiting.get():
                if low // 1000 > passed:
                    rest.append((low, high, value))
                    continue
                now, later = _split(_from_bytes(value), passed)
                due.append(now)
                if later.num_rows:
                    rest.append(_chunk(later))
        if not due:
            yield _status_rows([], [], [])
            return
        self.first.clear()
        if rest:
            self.waiting.put(rest)
            self._expect(min(low for low, _, _ in rest) // 1000)
        else:
            self.waiting.clear()
        before = _from_bytes(self.last.get()[0]).to_pandas() if self.last.exists() else pd.DataFrame(columns=LAST_POLLS)
        events, after = _ordered_events(pd.concat(due, ignore_index=True), before)
        self.last.update((_to_bytes(after),))
        yield events

    def close(self) -> None:
        pass


def _split(polls: pa.Table, passed: int) -> tuple[pd.DataFrame, pa.Table]:
    """The polls up to a millisecond, and those after it."""
    is_due = polls["micros"].to_numpy() // 1000 <= passed
    return polls.filter(pa.array(is_due)).to_pandas(), polls.filter(pa.array(~is_due))


def _chunk(polls: pa.Table) -> tuple[int, int, bytes]:
    micros = polls["micros"].to_numpy()
    return int(micros.min()), int(micros.max()), _to_bytes(polls)


def _ordered_events(polls: pd.DataFrame, before: pd.DataFrame) -> tuple[pd.DataFrame, pa.Table]:
    """The events of polls of several hosts and each host's last poll after them, as :func:`_next_status` gives them one
    by one; ``before`` is that of the hosts known so far."""
    known = len(before)
    hosts, names = pd.factorize(pd.concat([before["host"], polls["host"]]).to_numpy(object), use_na_sentinel=False)
    order = np.lexsort((polls["event_id"].to_numpy(), polls["micros"].to_numpy(), hosts[known:]))
    polls, host = polls.iloc[order], hosts[known:][order]
    codes, values = {}, {}
    for name, start in (("status", "idle"), ("model", None)):
        both = np.concatenate([before[name].to_numpy(object), polls[name].to_numpy(object), [start]])
        found, values[name] = pd.factorize(both)
        codes[name] = found[known:-1]
        values[f"first_{name}"] = np.full(len(names), found[-1])
        values[f"first_{name}"][hosts[:known]] = found[:known]
    failed = np.zeros(len(names), np.int64)
    failed[hosts[:known]] = before["failures"].to_numpy(np.int64)

    row, ok = np.arange(len(polls)), polls["ok"].to_numpy(bool)
    new = np.append(True, host[1:] != host[:-1])
    begins = np.maximum.accumulate(np.where(new, row, 0))
    latest = np.maximum.accumulate(np.where(ok, row, -1))
    good = np.append(-1, latest[:-1])
    inside = good >= begins
    failures = np.where(inside, row - good - 1, row - begins + failed[host])
    was = {name: np.where(inside, codes[name][good], values[f"first_{name}"][host]) for name in codes}

    def one_of(code, *statuses):
        return np.append(np.isin(values["status"].astype(str), statuses), False)[code]

    loaded = ok & one_of(was["status"], *fixed.LOADING_STATUSES)
    found = [("offline", ~ok & (failures + 1 == fixed.OFFLINE_AFTER)), ("online", ok & (failures >= fixed.OFFLINE_AFTER)),
             ("loaded", loaded & one_of(codes["status"], "ready")), ("failed", loaded & one_of(codes["status"], "error")),
             ("model_changed", ok & (codes["model"] != was["model"]))]
    at = np.concatenate([np.flatnonzero(hit) for _, hit in found])
    event = np.repeat(np.array([name for name, _ in found], object), [hit.sum() for _, hit in found])
    order = np.argsort(at, kind="stable")
    events = _status_rows(polls["host"].to_numpy(object)[at[order]], polls["micros"].to_numpy()[at[order]], event[order])

    end = np.flatnonzero(np.append(new[1:], True))
    inside = latest[end] >= begins[end]
    failed[host[end]] = np.where(inside, end - latest[end], end - begins[end] + 1 + failed[host[end]])
    after = {"host": pa.array(names, pa.string(), from_pandas=True)}
    for name in codes:
        code = values[f"first_{name}"]
        code[host[end]] = np.where(inside, codes[name][latest[end]], code[host[end]])
        after[name] = pa.array(np.append(values[name].astype(object), None)[code], pa.string(), from_pandas=True)
    return events, pa.table(after | {"failures": pa.array(failed)})


def _status_rows(hosts, micros, events) -> pd.DataFrame:
    return pd.DataFrame({"host": pd.Series(list(hosts), dtype=object),
                         "ts": pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us").reset_index(drop=True),
                         "event": pd.Series(list(events), dtype=object)})


def _next_status(status, model, failures: int, ok: bool, now, current):
    """A host's state after a poll, and the events of it."""
    if not ok:
        return status, model, failures + 1, ["offline"] if failures + 1 == fixed.OFFLINE_AFTER else []
    events = ["online"] if failures >= fixed.OFFLINE_AFTER else []
    if status in fixed.LOADING_STATUSES and now in ("ready", "error"):
        events.append("loaded" if now == "ready" else "failed")
    if current != model:
        events.append("model_changed")
    return now, current, 0, events
