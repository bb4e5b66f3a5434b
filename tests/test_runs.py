import pytest
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.operators import runs as ops
from tunelake.sources import logs as sources

LINES = [
    "Loading Model on cpu...", "Loading Tokenizer for x...", "  Tokenizing dataset...", "",
    'JSON_LOG:{"loss": 2.0, "epoch": 0.5}', 'JSON_LOG: {"epoch": 3.5, "train_loss": 1.0}', "JSON_LOG:{broken",
    'JSON_LOG:{"loss": "3"}', "JSON_LOG:[1]", 'JSON_LOG:{"loss": 1.0} x',
]


def folded(spark, lines, run="r"):
    rows = spark.createDataFrame([(run, i, line) for i, line in enumerate(lines)], "run_id string, seq bigint, line string")
    return ops.parse_log(rows)


def test_folding(spark):
    row = ops.run_metrics(folded(spark, LINES)).first()
    assert (row["loss"], row["perplexity"], row["n_losses"]) == (2.0, pytest.approx(2.718**2), 1)
    assert (row["step"], row["progress"], row["status"], row["error"]) == (3.5, 100.0, "Training...", "")
    half = ops.run_metrics(folded(spark, LINES[:5])).first()
    assert half["progress"] == pytest.approx(100 * 0.5 / 3)
    assert ops.run_metrics(folded(spark, LINES[:2])).first()["status"] == "Loading Model..."
    assert ops.run_metrics(folded(spark, ["x"])).first().asDict() == {
        "run_id": "r", "loss": 0.0, "step": 0.0, "perplexity": 0.0, "status": "Starting...", "progress": 0.0,
        "total_epochs": 3, "error": "", "n_losses": 0,
    }


def test_keyword_beats_error_and_last_error_wins(spark):
    lines = ["Error: x not found.", "No training data found or loaded.", "Error: Saving adapters failed"]
    row = ops.run_metrics(folded(spark, lines)).first()
    assert (row["error"], row["status"]) == (lines[1], "Saving Weights...")


@pytest.mark.parametrize("code, error, expected", [
    (0, True, ("Complete", 100.0, "Error: a")), (1, False, ("Failed", 50.0, "Training process exited with code 1")),
    (2, True, ("Failed", 50.0, "Error: a")), (None, False, ("Training...", 50.0, "")),
])
def test_final_status(spark, code, error, expected):
    lines = ['JSON_LOG:{"loss": 1, "epoch": 1.5}'] + (["Error: a"] if error else [])
    exits = spark.createDataFrame([] if code is None else [("r", code)], "run_id string, exit_code int")
    row = ops.run_status(ops.run_metrics(folded(spark, lines)), exits).first()
    assert (row["status"], row["progress"], row["error"]) == expected


def test_late_lines_keep_their_place(spark):
    rows = [("r", seq, f'JSON_LOG:{{"loss": {loss}}}') for seq, loss in [(3, 0.3), (1, 0.1), (2, 0.2)]]
    parsed = ops.parse_log(spark.createDataFrame(rows, "run_id string, seq bigint, line string"))
    assert ops.run_metrics(parsed).first()["loss"] == 0.3
    assert ops.loss_history(parsed).first()["losses"] == [0.1, 0.2, 0.3]
    assert [r["losses"] for r in ops.loss_history(parsed, block=2).orderBy("block").collect()] == [[0.1, 0.2], [0.3]]


def test_curves(spark):
    parsed = folded(spark, [f'JSON_LOG:{{"loss": {v}}}' for v in (4, 4, 4)]).unionByName(
        folded(spark, [f'JSON_LOG:{{"loss": {v}}}' for v in (3, 1, 2)], "s")).unionByName(
        folded(spark, ['JSON_LOG:{"loss": 1}'], "one"))
    points = {r["run_id"]: r for r in ops.loss_curve_summary(parsed).collect()}
    assert set(points) == {"r", "s"} and points["r"]["span"] == 1.0 and points["s"]["span"] == 2.0
    scaled = ops.loss_curve_points(parsed).where("run_id = 's'").orderBy("i").collect()
    assert [(r["x"], r["y"]) for r in scaled] == [(0.0, 1.0), (0.5, 0.0), (1.0, 0.5)]


def test_blockers(spark):
    plans = spark.createDataFrame(
        [(False, 0, "", "a b", True), (True, 1, "m", "ok", False)],
        "online boolean, eligible int, model string, adapter_name string, is_training boolean",
    )
    bad, good = ops.run_blockers(plans).collect()
    assert bad["blockers"] == [fixed.BLOCKER_OFFLINE, fixed.BLOCKER_NO_EXAMPLES, fixed.BLOCKER_NO_MODEL,
                               fixed.BLOCKER_BAD_NAME, fixed.BLOCKER_TRAINING] and good["blockers"] == []


def test_log_files(spark, tmp_path):
    lines = spark.range(5).select(
        F.lit("r1").alias("run_id"), F.col("id").alias("seq"),
        sources.log_line(F.struct((F.col("id") / 2).alias("loss"))).alias("line"),
    ).coalesce(1)
    sources.write_logs(lines, str(tmp_path / "logs"))
    row = ops.run_metrics(ops.parse_log(sources.read_logs(spark, str(tmp_path / "logs")))).first()
    assert (row["run_id"], row["n_losses"], row["loss"]) == ("r1", 5, 2.0)


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    def write(low, high):
        lines = spark.range(low, high).selectExpr(
            "'r' AS run_id", "id AS seq", """concat('JSON_LOG:{"loss": ', id, '.0, "epoch": 1}') AS line""").coalesce(1)
        sources.write_logs(lines, str(tmp_path / "logs"))

    write(0, 3)
    write(3, 60)
    write(60, 62)
    read = sources.read_logs(spark, str(tmp_path / "logs"))
    assert [r["line"] for r in read.orderBy("seq").collect()] == [
        f'JSON_LOG:{{"loss": {i}.0, "epoch": 1}}' for i in range(62)]
    assert ops.run_metrics(ops.parse_log(read)).first()["loss"] == 61.0
