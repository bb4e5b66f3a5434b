"""The pipeline against brute force on small tables, with the cases that real tables hold rarely."""

import corpus_pipeline
import pytest

WORDS = [f"w{i}" for i in range(4000)]


def text(start, n):
    return " ".join(WORDS[start: start + n])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows = [
        (1, text(0, 300), "en", "a", None), (2, text(0, 300), "en", "a", None),
        (3, text(0, 298) + " other end", "en", "b", None), (4, text(400, 200), "en", "b", None),
        (5, text(700, 200) + " " + text(420, 60), "de", "c", None), (6, None, "en", "c", None), (7, "", None, None, None),
        (8, "x " * 50, "en", "c", None), (None, text(1000, 150), None, None, None), (9, text(1300, 50), "en", "c", None),
        (9, text(1300, 50), "en", "c", None), (9, text(1500, 50), "en", "c", None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(
        f"{root}/labels.parquet")
    return root


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    judged = stages["quality rules"](spark, docs, folder)
    assert sorted(str(r.doc_id) for r in judged.collect()) == sorted(["1", "2", "3", "4", "5", "None", "9", "9", "9"])
    kept = stages["near copies"](spark, judged, folder)
    assert sorted((str(r.doc_id), len(r.text)) for r in kept.collect()) == sorted(
        [("1", len(text(0, 300))), ("4", len(text(400, 200))), ("5", len(text(700, 200)) + 1 + len(text(420, 60))),
         ("None", len(text(1000, 150))), ("9", len(text(1300, 50))), ("9", len(text(1500, 50)))])
    cut = stages["repeated passages"](spark, kept, folder)
    assert cut.columns == docs.columns
    five = cut.where("doc_id = 5").first()
    assert text(700, 199) in five.text and text(425, 50) not in five.text and five.n_chars == len(five.text)
    mixed = stages["mixture"](spark, cut, folder)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_run_gives_ids(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns)
    assert all(r.n_tokens == len(r.ids) for r in out.collect())


def test_token_ids_hold_one_python_worker_per_task(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = dict(corpus_pipeline.STAGES)["token ids"](spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_pass(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr(
        "*", "1 AS _id", "2 AS _block", "3 AS n_words", "4 AS size", "5 AS spans", "6 AS root")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0
