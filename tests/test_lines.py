"""Awkward lines and what each of the rules makes of them."""

import json

import pytest
from pyspark.sql import functions as F

from tunelake.functions import json_lines as jl
from tunelake.operators import curation as ops
from tunelake.sources import jsonl

# line, preview, upload status, listed, usable, kept by training, issue
EDGES = [
    ('{"prompt":"a","response":"b"}', True, "accepted", True, True, False, None),
    ('{"prompt":null,"response":"b"}', False, "accepted", False, None, False, None),
    ('{"prompt":"","response":"b","score":9}', False, "accepted", False, None, False, None),
    ('["prompt","response"]', False, "not_object", False, None, False, None),
    ("5", False, "not_object", False, None, False, None),
    ('"prompt response"', False, "not_object", False, None, False, None),
    ('"hello"', False, "not_object", False, None, False, None),
    ("null", False, "not_object", False, None, False, None),
    ("not json", False, "bad_json", False, None, False, None),
    ("{'prompt':'a','response':'b'}", False, "bad_json", False, None, False, None),
    ('{"prompt":"a","response":"b"} junk', False, "bad_json", False, None, False, None),
    ('{"prompt":"a","response":"b"}] {}', False, "bad_json", False, None, False, None),
    ('{"prompt":"a","response":"b"},{"prompt":"c","response":"d"}', False, "bad_json", False, None, False, None),
    ('{"prompt":"a","response":"b","score":"9"}', True, "accepted", True, False, False, "score_not_numeric"),
    ('{"prompt":"a","response":"b","score":null}', True, "accepted", True, False, False, "score_not_numeric"),
    ('{"prompt":"a","response":"b","score":7.0}', True, "accepted", True, True, True, None),
    ('{"prompt":"a","response":"b","score":6.99}', True, "accepted", True, False, False, None),
    ('{"prompt":"a","response":"b","score":true}', True, "accepted", True, False, False, "score_not_numeric"),
    ('{"prompt":"a","prompt":"z","response":"b"}', True, "accepted", True, True, False, None),
    ('{"prompt":"a","response":"b","score":NaN}', False, "bad_json", False, None, False, None),
    ('{"prompt":5,"response":"b","score":9}', True, "not_string", False, None, False, None),
    ('{"prompt":"a"}', False, "missing_key", False, None, False, None),
    ('{"prompt":"a\\u2028b","response":" c ","score":1e1,"x":{"y":[1]}}', True, "accepted", True, True, True, None),
    (" \t  ", None, "blank", False, None, False, None),
    ("", None, "blank", False, None, False, None),
    ("{", False, "bad_json", False, None, False, None),
    ("{}", False, "missing_key", False, None, False, None),
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(edge[0], i) for i, edge in enumerate(EDGES)], "value string, seq bigint")


def test_preview(lines):
    rows = jl.with_parsed(lines).select("seq", jl.preview_valid().alias("ok"), "parsed.state").collect()
    assert {r["seq"]: None if r["state"] == "blank" else r["ok"] for r in rows} == {
        i: edge[1] for i, edge in enumerate(EDGES)
    }
    counts = ops.preview_counts(lines).first()
    assert (counts["valid"], counts["invalid"]) == (
        sum(edge[1] is True for edge in EDGES), sum(edge[1] is False for edge in EDGES)
    )


def test_upload_listing_and_training(lines):
    ingested = ops.ingest_examples(lines, 3)
    rows = {r["seq"]: r for r in ingested.collect()}
    listed = {r["seq"]: r["usable"] for r in ops.listed(ops.accepted(ingested)).collect()}
    for i, (_, _, status, shown, usable, _, issue) in enumerate(EDGES):
        assert (rows[i]["status"], rows[i]["issue"]) == (status, issue), EDGES[i]
        assert (i in listed, listed.get(i)) == (shown, usable), EDGES[i]
    assert rows[18]["prompt"] == "z" and rows[0]["score"] == 10.0 and rows[0]["source"] == "manual_upload"
    kept = ops.load_training_lines(lines)
    assert kept.count() == sum(edge[5] for edge in EDGES)


def test_every_line_has_one_outcome(lines):
    ingested = ops.ingest_examples(lines, 1)
    blank = ingested.where("status = 'blank'").count()
    assert ops.accepted(ingested).count() + ops.quarantined(ingested).count() + blank == len(EDGES)
    assert ingested.select("example_id").distinct().count() == len(EDGES)


def test_serialized_line_keeps_everything(lines):
    rows = ops.accepted(ops.ingest_examples(lines, 1, keep_line=True)).select("seq", "line").collect()
    for row in rows:
        before, after = json.loads(EDGES[row["seq"]][0]), json.loads(row["line"])
        assert after == {"score": 10, "source": "manual_upload"} | before
        assert "\n" not in row["line"]


def test_plain_sample(spark, tmp_path):
    """Sixty lines without score or source: nothing to train on as stored, everything after upload."""
    path = tmp_path / "data.jsonl"
    path.write_text("".join(json.dumps({"prompt": f"p{i}", "response": f"é{i}"}) + "\n" for i in range(60)))
    lines = jsonl.read_lines(spark, str(path))
    assert ops.preview_counts(lines).first().asDict() == {"valid": 60, "invalid": 0}
    assert ops.load_training_lines(lines).count() == 0
    examples = ops.accepted(ops.ingest_examples(lines, 1))
    assert ops.dataset_summary(examples).first().asDict() == {"total": 60, "eligible": 60, "skipped": 0}
    assert ops.training_set(examples).count() == 60


def test_ids_keep_parts_apart(spark):
    rows = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), (None, "c"), ("", "c")], "p string, r string")
    found = rows.select(jl.example_id(F.lit(1), F.lit(2), F.col("p"), F.col("r")).alias("i")).distinct().count()
    assert found == 4


def test_listing_shows_defaults(spark):
    rows = spark.createDataFrame([("x", 1, 1, "p", "r", None, None)],
                                 "example_id string, batch_id bigint, seq bigint, prompt string, response string, "
                                 "score double, source string")
    shown = ops.list_examples(rows).first()
    assert (shown["score"], shown["source"], shown["usable"]) == (0.0, "", False)


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt":"a","response":"b","score":8}\r\n\n')
    (tmp_path / "b.txt").write_text('{"prompt":"c\x0b","response":"d","score":9}')
    (tmp_path / "c.csv").write_text("ignored")
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert ops.load_training_lines(lines).count() == 1 and lines.count() == 3
    assert lines.select("seq").distinct().count() == 3
    missing = jsonl.read_lines(spark, str(tmp_path / "none"))
    assert missing.columns == ["value", "file", "seq"] and missing.count() == 0
    assert ops.load_training_lines(missing).count() == 0


def test_numbers_do_not_depend_on_splits(spark, tmp_path):
    """The same ids under splits of any size, in the order of files and lines; hot, empty and blank files too."""
    folder = tmp_path / "in"
    folder.mkdir()
    sizes = {"a.jsonl": 3, "b.jsonl": 4000, "c.txt": 0, "d.json": 1, "e.jsonl": 700}
    expected = []
    for name, n in sizes.items():
        rows = [json.dumps({"prompt": f"{name} {i % 7}", "response": "r" * (i % 90)}) if i % 5 else "" for i in range(n)]
        (folder / name).write_text("".join(row + "\n" for row in rows))
        expected += rows
    found = []
    for size in ("1k", "10k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "512")
        try:
            lines = jsonl.read_numbered_lines(spark, str(folder))
            assert [r["value"] for r in lines.orderBy("seq").collect()] == expected
            assert [r["seq"] for r in lines.select("seq").orderBy("seq").collect()] == list(range(len(expected)))
            found.append({(r["seq"], r["example_id"]) for r in ops.ingest_examples(lines, 4).collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0] == found[1] == found[2] and len(found[0]) == len(expected)
    missing = jsonl.read_numbered_lines(spark, str(tmp_path / "none"))
    assert missing.columns == ["value", "file", "seq"] and missing.count() == 0


def test_versions_and_batches(spark, tmp_path, lines):
    examples = ops.accepted(ops.ingest_examples(lines, 1))
    root = str(tmp_path / "examples")
    jsonl.append_batch(examples, root)
    with pytest.raises(ValueError):
        jsonl.append_batch(examples, root)
    jsonl.append_batch(examples, root, replay=True)
    jsonl.append_batch(ops.accepted(ops.ingest_examples(lines, 2)), root)
    stored = spark.read.parquet(root)
    assert stored.count() == 2 * examples.count()
    typed = jsonl.read_examples(spark, root)
    assert sorted(typed.columns) == sorted(stored.columns) and typed.count() == stored.count()
    assert jsonl.read_examples(spark, str(tmp_path / "none")).count() == 0
    first = examples.where("seq = 0").select("example_id", "prompt")
    remaining = ops.delete_examples(stored, first)
    jsonl.write_version(remaining, str(tmp_path / "versions"), 1)
    again = jsonl.read_version(spark, str(tmp_path / "versions"), 1)
    assert again.count() == stored.count() - 1
    assert again.join(first, "example_id", "left_semi").count() == 0
    stale = first.withColumn("prompt", F.lit("other"))
    assert ops.delete_examples(stored, stale).count() == stored.count()
    assert ops.delete_conflicts(stored, stale).count() == 1
    jsonl.export_training_set(ops.training_set(again), str(tmp_path / "export"))
    assert set(spark.read.json(str(tmp_path / "export")).columns) == {"prompt", "response"}


def test_search_takes_wildcards_literally(spark):
    rows = spark.createDataFrame(
        [(1, 1, "100% sure", "x", 9.0), (1, 2, "100 sure", "a_b", 9.0)],
        "batch_id int, seq int, prompt string, response string, score double",
    )
    assert [r["seq"] for r in ops.search_examples(rows, " 0% S ").collect()] == [1]
    assert [r["seq"] for r in ops.search_examples(rows, "A_B").collect()] == [2]
    assert ops.search_examples(rows, "  ").count() == 2


def test_nan_score_is_not_usable(spark):
    rows = spark.createDataFrame([(float("nan"),), (7.0,), (None,)], "score double")
    assert [r[0] for r in rows.select(jl.usable(F.col("score"))).collect()] == [False, True, False]


def test_exact_duplicates(spark):
    rows = [("a", 1, 0, "Hi  there", "x"), ("b", 1, 1, "hi there", " X\n"), ("c", 2, 0, "hi there", "y"),
            ("d", 2, 1, "hi", " there x"), ("e", 1, 5, None, ""), ("f", 1, 4, "", None)]
    examples = spark.createDataFrame(rows, "example_id string, batch_id bigint, seq bigint, prompt string, response string")
    found = {(r["first_id"], r["n_examples"]) for r in ops.exact_duplicates(examples).collect()}
    assert found == {("a", 2), ("f", 2)}
