"""Streams over several micro-batches: repeats, late rows, replays."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tunelake.operators import status
from tunelake.operators.curation import accepted, ingest_examples
from tunelake.plans import streams
from tunelake.plans.streams import finish
from tunelake.sources.jsonl import append_batch, stream_lines
from tunelake.streaming import ingest, live

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def feed(spark, folder, batches, schema):
    """Writes each batch as its own files and reads them one file per micro-batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(str(folder)))


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def run(spark, rows, tmp_path, mode="append"):
    name = f"out_{tmp_path.name.replace('-', '_')}"
    finish(rows.writeStream.format("memory").queryName(name).outputMode(mode)
           .option("checkpointLocation", str(tmp_path / "state")))
    return spark.table(name)


def test_lines_arrive_and_a_replay_adds_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    paths = [str(tmp_path / p) for p in ("accepted", "quarantine", "state")]
    for i in range(3):
        (source / f"{i}.jsonl").write_text(json.dumps({"prompt": f"p{i}", "response": "r"}) + "\nbroken\n\n")
        finish(ingest.ingest_stream(stream_lines(spark, str(source)), *paths))
    assert spark.read.parquet(paths[0]).count() == 3 and spark.read.parquet(paths[1]).count() == 3
    again = spark.createDataFrame([(json.dumps({"prompt": "p2", "response": "r"}), 0)], "value string, seq bigint")
    writer = spark.read.parquet(paths[0]).select("writer").distinct().first()[0]
    append_batch(accepted(ingest_examples(again, 2)), paths[0], writer, replay=True)
    assert spark.read.parquet(paths[0]).count() == 3
    append_batch(accepted(ingest_examples(again, 2)), paths[0])
    assert spark.read.parquet(paths[0]).count() == 4
    finish(ingest.ingest_stream(stream_lines(spark, str(source)), paths[0], paths[1], str(tmp_path / "second")))
    assert spark.read.parquet(paths[0]).count() == 7


def test_resent_rating_is_logged_but_captured_once(spark, tmp_path):
    schema = "message_id string, score int, prompt string, response string, ts timestamp"
    rows = [("m1", 10, "p", "r", at(0)), ("m2", 2, "p", "r", at(1)), ("m3", 9, "", "r", at(2))]
    batches = [rows, [("m1", 10, "p", "r", at(60)), ("m4", 7, "p", "r", at(61))]]
    stream = feed(spark, tmp_path / "in", batches, schema)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert run(spark, ingest.rating_log_stream(stream), tmp_path / "a").count() == 5
    captured = run(spark, ingest.rating_capture_stream(stream), tmp_path / "b")
    assert sorted(r["message_id"] for r in captured.collect()) == ["m1", "m4"]


def test_late_log_line_does_not_replace_a_newer_one(spark, tmp_path):
    schema = "run_id string, seq bigint, line string"
    batches = [[("r", 5, 'JSON_LOG:{"loss": 0.5, "epoch": 1.5}')],
               [("r", 2, 'JSON_LOG:{"loss": 0.9, "epoch": 0.5}'), ("r", 3, "Error: old")]]
    out = run(spark, live.run_metrics_stream(feed(spark, tmp_path / "in", batches, schema)), tmp_path, "complete")
    row = out.first()
    assert (row["loss"], row["step"], row["n_losses"], row["error"]) == (0.5, 1.5, 2, "Error: old")


def test_status_state_spans_micro_batches(spark, tmp_path):
    schema = "host string, ts timestamp, event_id bigint, ok boolean, status string, model string"
    batches = [
        [("h", at(1), 1, True, "loading", None), ("h", at(2), 2, False, None, None), ("g", at(1), 3, False, None, None)],
        [("h", at(3), 4, False, None, None), ("h", at(4), 5, False, None, None), ("g", at(2), 6, True, "idle", None)],
        [("h", at(5), 7, True, "ready", "m"), ("h", at(2), 8, True, "error", "late"), ("g", at(3), 9, False, None, None), ("k", at(3), 10, False, None, None), ("k", at(3), 11, False, None, None)],
        [("h", at(6), 12, True, "loading", "m"), ("h", at(7), 13, True, "error", None)],
    ]
    out = run(spark, live.status_stream(feed(spark, tmp_path / "in", batches, schema)), tmp_path)
    got = [(r["host"], int(r["ts"].timestamp() - at(0).timestamp()), r["event"]) for r in
           out.withColumn("ts", F.col("ts")).collect()]
    assert sorted(got) == [("h", 3, "offline"), ("h", 5, "loaded"), ("h", 5, "model_changed"), ("h", 5, "online"),
                           ("h", 7, "failed"), ("h", 7, "model_changed"), ("k", 3, "offline")]


@pytest.fixture
def ordered_state(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    live.use_ordered_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_polls_out_of_order_give_the_batch_result(spark, tmp_path, ordered_state):
    schema = "host string, ts timestamp, event_id bigint, ok boolean, status string, model string"
    rows = [("h", at(1), 1, True, "loading", None), ("h", at(2), 2, False, None, None), ("h", at(3), 3, False, None, None),
            ("h", at(4), 4, True, "ready", "m"), ("h", at(4), 5, True, "loading", "m"), ("h", at(9), 6, True, "error", None),
            ("g", at(2), 7, False, None, None), ("g", at(3), 8, False, None, None), ("g", at(8), 9, True, "idle", None)]
    end = [("z", at(3600), 99, True, "idle", None)]
    batches = [[rows[3], rows[1], rows[7], rows[5]], [rows[0], rows[4], rows[2], rows[6], rows[8]], end,
               [("h", at(5), 50, True, "error", "late"), ("z", at(3500), 51, True, "idle", "m")], [("z", at(7300), 100, True, "idle", "m")]]
    found = run(spark, live.ordered_status_stream(feed(spark, tmp_path / "in", batches, schema)), tmp_path).collect()
    got = sorted((r["host"], int(r["ts"].timestamp() - at(0).timestamp()), r["event"]) for r in found)
    polls = spark.createDataFrame(rows + end, schema)
    changes = status.status_transitions(polls.where("ok"))
    expected = [("h", 5, "late")] + [("z", 3500, "model_changed"), ("z", 3600, "model_changed")]
    for r in changes.where("host <> 'z'").collect():
        expected += [(r["host"], r["ts"], e) for e in ([r["transition"]] if r["transition"] else []) + ["model_changed"] * r["model_changed"]]
    for r in status.offline_spells(polls).collect():
        expected += [(r["host"], r["offline_at"], "offline")] + ([(r["host"], r["recovered_at"], "online")] if r["recovered_at"] else [])
    expected = sorted((h, t if isinstance(t, int) else int(t.timestamp() - at(0).timestamp()), e) for h, t, e in expected)
    assert got == expected and len(got) > 8


@pytest.mark.parametrize("gap, applied", [(399, [(2, 9.0)]), (401, [(1, 5.0), (2, 9.0)])])
def test_debounce(spark, tmp_path, gap, applied):
    schema = "session int, ts timestamp, event_id int, value double"
    batches = [[(1, at(0), 1, 5.0), (1, at(gap / 1000), 2, 9.0)], [(2, at(3600), 3, 1.0)], [(2, at(7200), 4, 1.0)]]
    out = run(spark, live.debounce_stream(feed(spark, tmp_path / "in", batches, schema)), tmp_path)
    got = [(i, r["value"]) for i, r in zip((1, 2) if gap > 400 else (2,), out.where("session = 1").orderBy("ts").collect())]
    assert got == applied


def awkward_documents(spark, folder, ids):
    rows = [(i, f"text {i}", "en", "web") for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(folder)


def test_a_table_of_several_files_is_ingested(spark, tmp_path):
    awkward_documents(spark, f"{tmp_path}/documents.parquet", range(37))
    found = streams.stream_ingest(spark, str(tmp_path)).collect()
    assert sorted(r.seq for r in found) == [i for i in range(37) if i != 19]
    assert {r.seq for r in found if r.status != "accepted"} == {*range(3, 11), 17, 18, 20}


@pytest.mark.parametrize("ids, n", [([0, 36], 2), ([3, 8], 2), ([19], 0)])
def test_ingest_without_good_or_bad_lines(spark, tmp_path, ids, n):
    awkward_documents(spark, f"{tmp_path}/documents.parquet", ids)
    assert sorted(r.seq for r in streams.stream_ingest(spark, str(tmp_path)).collect()) == ids[:n]


@pytest.mark.parametrize("parts", [[], ["day"]])
def test_a_stream_reads_what_a_plain_read_does(spark, tmp_path, parts):
    rows = spark.range(20).selectExpr("id", "id % 3 AS day").repartition(4)
    rows.write.partitionBy(*parts).parquet(f"{tmp_path}/events.parquet")
    (tmp_path / "other").mkdir()
    found = streams.to_table(spark, streams._Streamed(spark).read.parquet(f"{tmp_path}/events.parquet"))
    assert sorted(map(tuple, found.select("id", "day").collect())) == [(i, i % 3) for i in range(20)]


POLLED = "host string, ts timestamp, event_id bigint, ok boolean, status string, model string"


def test_ordered_state_grows_with_polls_not_hosts(spark, tmp_path, ordered_state):
    """Hosts share state rows; a poll without a time or an answer stops nothing."""
    rows = [(f"h{i}", at(i % 50), i, i % 3 > 0, "loading", "m") for i in range(3000)]
    rows += [(None, at(1), 1, None, None, None), (None, at(2), None, False, None, None), ("h1", None, 7, True, "ready", "m")]
    stream = feed(spark, tmp_path / "in", [rows, [("z", at(9000), 1, True, "idle", None)]], POLLED)
    query = (live.ordered_status_stream(stream).writeStream.format("memory").queryName("grown").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    found = [(r.host, r.event) for r in spark.table("grown").collect()]
    assert sorted(found, key=str) == sorted([(None, "offline")] + [(f"h{i}", "model_changed") for i in range(3000) if i % 3], key=str)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 4 * live.STATUS_BUCKETS


@pytest.mark.parametrize("seed", range(6))
def test_ordered_events_follow_the_single_steps(seed):
    """Polls of several hosts, taken in parts, against one poll after another."""
    rng = random.Random(seed)
    polls = [(rng.choice(["a", "b", "c", None]), rng.randrange(40), i, rng.random() < 0.5,
              rng.choice(["starting", "loading", "ready", "error", None]), rng.choice(["m", "n", None])) for i in range(200)]
    names = ["host", "micros", "event_id", "ok", "status", "model"]
    state, before = {}, pd.DataFrame(columns=live.LAST_POLLS)
    for low, high in ((0, 10), (10, 11), (11, 40)):
        part = [p for p in polls if low <= p[1] < high]
        expected = []
        for host, micros, _, ok, now, current in sorted(part, key=lambda p: p[1:3]):
            *state[host], found = live._next_status(*state.get(host, ("idle", None, 0)), ok, now, current)
            expected += [(host, micros, event) for event in found]
        events, after = live._ordered_events(pd.DataFrame(part, columns=names), before)
        got = zip([None if pd.isna(h) else h for h in events["host"]], [t.value // 1000 for t in events["ts"]],
                  events["event"], strict=True)
        assert sorted(map(str, got)) == sorted(map(str, expected))
        assert {r["host"]: [r["status"], r["model"], r["failures"]] for r in after.to_pylist()} == state
        before = live._from_bytes(live._to_bytes(after)).to_pandas()
