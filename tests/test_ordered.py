"""Chunked scans against plain windows: with all keys, one key or no key hot, and chunks down to one row."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tunelake.operators import status
from tunelake.operators.ordered import EvenChunks, mark_hot, number_rows, ordered_scan, position_chunk, with_totals


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows, one is NULL, positions have gaps and values are missing."""
    data = [(None if i % 11 == 0 else ("hot" if i % 3 else f"k{i % 5}"), i * (1 + i % 4 // 3), i % 7 or None)
            for i in range(400)]
    data = [(key, pos * 3 + i % 3, value) for i, (key, pos, value) in enumerate(data)]
    frame = spark.createDataFrame(data, "key string, pos bigint, value bigint")
    return frame.dropDuplicates(["key", "pos"])


@pytest.mark.parametrize("length", [1, 5, 64])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("hot_rows", [0, 60, 1_000_000])
def test_scan_equals_window(rows, length, descending, hot_rows):
    value = F.col("value")
    scanned = ordered_scan(
        rows, ["key"], ["pos"], position_chunk("pos", length), descending=descending,
        hot_rows=hot_rows,
        running={"total": F.coalesce(value, F.lit(0)), "i": F.lit(1)}, previous={"before": value, "at": F.col("pos")},
        last_known={"known": value}, totals={"n": ("sum", F.lit(1)), "low": ("min", value), "high": ("max", value)},
    )
    whole = Window.partitionBy("key")
    along = whole.orderBy(F.col("pos").desc() if descending else F.col("pos"))
    upto, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.select(
        "*", F.sum(F.coalesce(value, F.lit(0))).over(upto).alias("total"), F.row_number().over(along).alias("i"),
        F.lag("value").over(along).alias("before"), F.lag("pos").over(along).alias("at"),
        F.last("value", ignorenulls=True).over(before).alias("known"), F.count("*").over(whole).alias("n"),
        F.min("value").over(whole).alias("low"), F.max("value").over(whole).alias("high"),
    )
    assert sorted(map(str, scanned.collect())) == sorted(map(str, plain.collect()))


def test_number_rows(rows):
    numbered = number_rows(
        rows.withColumn("_chunk", position_chunk("pos", 16)).withColumn("batch", F.lit(1)), ["pos", "key"],
        ["batch", "_chunk"],
    )
    got = [(r["pos"], r["key"]) for r in numbered.orderBy("number").collect()]
    assert got == sorted(got, key=lambda x: (x[0], x[1] or ""))
    assert [r["number"] for r in numbered.orderBy("number").collect()] == list(range(1, rows.count() + 1))


def test_totals_spread_a_key(rows):
    spread = with_totals(rows, ["key"], ["pos"], {"n": ("sum", F.lit(1))}, parts=7, hot_rows=60)
    counts = {r["key"]: r["count"] for r in rows.groupBy("key").count().collect()}
    assert all(r["n"] == counts[r["key"]] for r in spread.collect()) and spread.count() == rows.count()


def test_a_burst_is_cut_by_rows(spark):
    """A quiet day and a second with most of the events: chunks hold about equal numbers of rows, results are the same."""
    burst = F.expr("timestamp_micros(1704067200000000 + if(id < 2000, id * 43000000, 50000000000 + id * 40))")
    events = spark.range(40_000).select(F.lit("k").alias("key"), burst.alias("ts"), F.col("id").alias("event_id"))
    even = EvenChunks("ts", ("ts", "event_id"), rows=1000, one_in=16)
    marked = mark_hot(events, ["key"], 100, even=even).withColumn("chunk", even.chunk())
    sizes = [r["count"] for r in marked.groupBy("chunk").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 4 * 1000
    scan = {"running": {"i": F.lit(1)}, "previous": {"before": F.col("event_id")}}
    cut, whole = (sorted(map(tuple, ordered_scan(events, ["key"], ["ts", "event_id"], even, hot_rows=rows, **scan).collect()))
                  for rows in (100, 1_000_000))
    assert cut == whole


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_intents_by_hand(spark, hot_rows):
    asked = [(1, "s", "m", "now"), (2, "s", "m", "x"), (4, "s", "n", "x"), (5, "s", "n", "x"), (9, "s", "m", "x"), (12, "s", None, "x"),
             (1, "t", "m", "x"), (3, "t", None, None)]
    came = [(3, "s", "ready", "other"), (6, "s", "ready", "m"), (7, "s", "ready", "n"), (8, "s", "error", "n"), (10, "s", "error", None),
            (13, "s", "ready", None), (0, "t", "ready", "m"), (2, "u", "error", "m")]
    ts = F.expr("timestamp_micros(1704067200000000 + event_id * 1000000)")
    intents = spark.createDataFrame([(i, k, m, f"a{i}", m if c == "now" else c) for i, k, m, c in asked],
                                    "event_id long, session string, model string, adapter string, current_model string")
    results = spark.createDataFrame(came, "event_id long, session string, outcome string, model string")
    found = status.pending_intents(intents.withColumn("ts", ts), results.withColumn("ts", ts), hot_rows=hot_rows).collect()
    got = {(r["session"], r["event_id"]): (r["outcome"], r["adapter"], r["resolved_at"] and int(r["resolved_at"].timestamp()) - 1704067200)
           for r in found}
    assert got == {("s", 1): ("applied", "a1", 1), ("s", 2): ("replaced", "a2", None), ("s", 4): ("replaced", "a4", None),
                   ("s", 5): ("applied", "a5", 7), ("s", 9): ("dropped", "a9", 10), ("s", 12): ("applied", "a12", 13),
                   ("t", 1): ("waiting", "a1", None), ("t", 3): ("applied", "a3", 3)}
