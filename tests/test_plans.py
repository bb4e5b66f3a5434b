"""What the physical plans must look like to hold at scale."""

import contextlib
import io
import re

import pytest

from tunelake.operators import curation, feedback, runs
from tunelake.operators.conversations import conversation_pairs
from tunelake.plans import QUERIES
from tunelake.plans.inputs import examples, log_lines, messages, ratings, table


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


BATCH = [name for name in QUERIES if not name.startswith(("stream_", "adapter_fit", "adapter_accuracy", "scan_"))]


# Queries whose only unpartitioned windows run over summaries: chunk counts.
SUMMARY_WINDOWS = {
    "list_examples", "vocabulary", "tokenize", "pad_truncate", "label_mask", "label_mask_short", "token_budget",
}
UNPARTITIONED = re.compile(r"Arguments: [^\n]*windowspecdefinition\((?:\w+#\d+L?|\d+) (?:ASC|DESC)")


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_window_over_a_table(spark, sf_dir, name):
    text = plan(QUERIES[name].run(spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert name in SUMMARY_WINDOWS or not UNPARTITIONED.search(text)


def test_ingest_has_no_shuffle_and_one_parse(spark, sf_dir):
    text = plan(examples(spark, sf_dir))
    assert "Exchange" not in text and text.count("parseJson") == 1


def test_training_filter_reaches_stored_examples(spark, sf_dir, tmp_path):
    examples(spark, sf_dir).write.parquet(str(tmp_path / "e"))
    text = plan(curation.training_set(spark.read.parquet(str(tmp_path / "e"))))
    assert "GreaterThanOrEqual(score,7.0)" in text
    assert re.search(r"ReadSchema: struct<prompt:string,response:string,score:double>", text)


def test_rating_and_run_folds_are_partial(spark, sf_dir):
    for frame in (feedback.latest_rating(ratings(spark, sf_dir)),
                  runs.run_metrics(runs.parse_log(log_lines(spark, sf_dir)))):
        text = plan(frame)
        assert "partial_max_by" in text and text.count("Exchange (") <= 2 and "Window" not in text


def test_moderate_top_k_is_cut_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["decode_policy"].run(spark, sf_dir))
    assert "WindowGroupLimit" in text


def test_pairs_of_messages_use_chunks(spark, sf_dir):
    text = plan(conversation_pairs(messages(spark, sf_dir)))
    assert re.search(r"hashpartitioning\(conv_id#\d+L, _chunk#\d+L", text)


def test_without_hot_keys_texts_are_read_and_shuffled_once(spark, sf_dir):
    frame = conversation_pairs(messages(spark, sf_dir))
    frame.collect()
    tree = plan(frame).split("== Initial Plan ==")[0]
    assert tree.count("+- Scan parquet") == 1 and len(re.findall(r"\+- Window", tree)) == 1
