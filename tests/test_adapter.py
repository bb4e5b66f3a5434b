import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.operators import adapter as ops
from tunelake.operators import runs
from tunelake.plans.inputs import table


@pytest.fixture(scope="module")
def features(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id").repartition(5)


@pytest.fixture(scope="module")
def base(features):
    return ops.class_centroids(features, 64, 10)


@pytest.fixture(scope="module")
def fit(features, base):
    seen = []
    result = ops.fit_adapter(features, base, steps_per_epoch=3, learning_rate=0.02, seed=2, on_log=seen.append)
    assert seen == result.logs
    return result


def test_centroids(features, base):
    pdf = features.toPandas()
    for label in range(10):
        rows = np.stack(pdf[pdf["label"] == label]["embedding"]).astype(float)
        assert base[label] == pytest.approx(rows.mean(axis=0))


def test_loss_falls_and_epochs_are_kept(fit):
    assert len(fit.logs) == 9 and len(fit.epochs) == 3 and fit.logs[-1]["epoch"] == 3.0
    by_epoch = np.array([log["loss"] for log in fit.logs]).reshape(3, 3).mean(axis=1)
    assert by_epoch[0] > by_epoch[1] > by_epoch[2]


def test_first_step_is_the_base(features, base):
    """B starts at zero, so the first loss is the base's, dropout or not."""
    fit = ops.fit_adapter(features, base, epochs=1, steps_per_epoch=1)
    pdf = features.toPandas()
    logits = np.stack(pdf["embedding"]).astype(float) @ base.T
    log_total = np.log(np.exp(logits).sum(axis=1))
    expected = (log_total - logits[np.arange(len(pdf)), pdf["label"]]).mean()
    assert fit.logs[0]["loss"] == pytest.approx(expected)


def test_gradients_match_differences(features, base):
    rng = np.random.default_rng(0)
    adapter = ops.Adapter(rng.normal(0, 0.1, (8, 64)), rng.normal(0, 0.1, (10, 8)))
    _, grad_a, grad_b = ops._gradients(features, base, adapter, 0.1, 4)
    for matrix, grad in (("a", grad_a), ("b", grad_b)):
        losses = []
        for step in (1e-5, -1e-5):
            moved = ops.Adapter(adapter.a.copy(), adapter.b.copy())
            getattr(moved, matrix)[3, 5] += step
            losses.append(ops._gradients(features, base, moved, 0.1, 4)[0])
        assert grad[3, 5] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-8)


def test_reruns_agree(features, base, fit):
    again = ops.fit_adapter(features.repartition(2), base, steps_per_epoch=3, learning_rate=0.02, seed=2)
    assert again.adapter.a == pytest.approx(fit.adapter.a) and again.adapter.b == pytest.approx(fit.adapter.b)


def test_apply_and_remove(features, base, fit):
    plain = {r["id"]: r["logits"] for r in ops.score_features(features, base).collect()}
    zero = ops.score_features(features, base, ops.new_adapter(64, 10))
    assert all(plain[r["id"]] == r["logits"] for r in zero.collect())
    applied = {r["id"]: r["logits"] for r in ops.score_features(features, base, fit.adapter).collect()}
    assert applied != plain
    removed = {r["id"]: r["logits"] for r in ops.score_features(features, base).collect()}
    assert removed == plain


def test_save_and_load(spark, tmp_path, fit):
    root = str(tmp_path / "adapters")
    for name in ("mine", "other"):
        for epoch, adapter in enumerate(fit.epochs, start=1):
            ops.save_adapter(spark, root, "org--base", name, epoch, adapter)
    loaded = ops.load_adapter(spark, root, "org--base", "mine")
    assert (loaded.a == fit.adapter.a).all() and (loaded.b == fit.adapter.b).all()
    first = ops.load_adapter(spark, root, "org--base", "mine", epoch=1)
    assert (first.b == fit.epochs[0].b).all()
    with pytest.raises(ValueError):
        ops.load_adapter(spark, root, "org--base", "none")


def test_logs_feed_the_run_operators(spark, fit):
    parsed = runs.parse_log(ops.fit_log_lines(spark, fit, "r"))
    metrics = runs.run_metrics(parsed).first()
    assert (metrics["n_losses"], metrics["progress"], metrics["status"]) == (9, 100.0, "Training...")
    assert metrics["loss"] == fit.logs[-1]["loss"]


def test_rows_without_label_or_embedding(features, base):
    odd = features.limit(5).withColumn("label", F.lit(None).cast("int")).unionByName(
        features.limit(5).withColumn("embedding", F.lit(None).cast("array<float>")))
    both = features.unionByName(odd)
    one = ops.fit_adapter(features, base, epochs=1, steps_per_epoch=2)
    two = ops.fit_adapter(both, base, epochs=1, steps_per_epoch=2)
    assert one.logs[0]["loss"] == pytest.approx(two.logs[0]["loss"])
    scored = ops.score_features(both, base).select("embedding", "logits", "predicted").collect()
    assert sum(r["logits"] is None for r in scored) == 5
    assert all((r["embedding"] is None) == (r["logits"] is None) == (r["predicted"] is None) for r in scored)


def test_label_outside_the_base_fails(features, base):
    with pytest.raises(Exception, match="labels must be 0 to 4"):
        ops.fit_adapter(features, base[:5], epochs=1, steps_per_epoch=1)
