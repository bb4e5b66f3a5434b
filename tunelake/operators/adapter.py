"""Low-rank adapters over a frozen linear classifier: fit, save, apply, remove."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake import schemas
from tunelake.sources.logs import log_line


@dataclass
class Adapter:
    """``a`` is rank x inputs, ``b`` classes x rank. With ``b`` zero the base is unchanged."""

    a: np.ndarray
    b: np.ndarray
    alpha: float = fixed.ADAPTER_ALPHA

    @property
    def scale(self) -> float:
        return self.alpha / self.a.shape[0]


@dataclass
class Fit:
    adapter: Adapter
    logs: list[dict] = field(default_factory=list)
    epochs: list[Adapter] = field(default_factory=list)


def new_adapter(n_inputs: int, n_classes: int, rank: int = fixed.ADAPTER_RANK, seed: int = 0) -> Adapter:
    a = np.random.default_rng(seed).normal(0.0, 1.0 / np.sqrt(n_inputs), (rank, n_inputs))
    return Adapter(a, np.zeros((n_classes, rank)))


def class_centroids(features: DataFrame, n_inputs: int, n_classes: int) -> np.ndarray:
    """A base classifier: the mean embedding of each class, ``n_classes`` x ``n_inputs`` numbers.

    Labels are 0 to ``n_classes - 1``; classes without rows stay zero.
    """

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        labels = batch.column("label").to_numpy()
        sums = total.reshape(n_classes, n_inputs + 1)
        np.add.at(sums[:, :n_inputs], labels, _matrix(batch.column("embedding")))
        np.add.at(sums[:, n_inputs], labels, 1.0)

    rows = _complete(features).where(F.col("label").between(0, n_classes - 1)).select("embedding", "label")
    sums = _summed(rows, n_classes * (n_inputs + 1), add).reshape(n_classes, n_inputs + 1)
    return sums[:, :n_inputs] / np.maximum(sums[:, n_inputs:], 1.0)


def _complete(features: DataFrame) -> DataFrame:
    return features.withColumn("label", F.col("label").cast("int")).where(
        "embedding IS NOT NULL AND label IS NOT NULL"
    )


def _summed(rows: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """A vector of ``size`` sums over all rows: each task adds up its Arrow batches, the tasks' vectors are
    summed on the cluster, and only the result is collected."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                add(total, batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["pos", "value"]
        )

    totals = np.zeros(size)
    partial = rows.mapInArrow(sums, "pos int, value double")
    for pos, value in partial.groupBy("pos").agg(F.sum("value").alias("value")).collect():
        totals[pos] = value
    return totals


def fit_adapter(
    features: DataFrame, base: np.ndarray, *, rank: int = fixed.ADAPTER_RANK, epochs: int = fixed.EPOCHS,
    steps_per_epoch: int = 4, learning_rate: float = fixed.LEARNING_RATE, dropout: float = fixed.ADAPTER_DROPOUT,
    seed: int = 0, on_log: Callable[[dict], None] | None = None,
    on_epoch: Callable[[int, Adapter], None] | None = None,
) -> Fit:
    """Fits an adapter data-parallel: each step is one job over the step's share of the rows.

    Needs id, embedding and label. Tasks turn Arrow batches into gradients of the two small matrices;
    the sums are aggregated on the cluster and ``rank * (inputs + classes)`` numbers reach the driver,
    which makes the (Adam) update. Rows are clustered by step once, so that a step reads its own share
    of the stored columns only. ``on_log`` gets each step's metrics, ``on_epoch`` the adapter after each
    epoch, to be saved before the next one starts.
    """
    n_classes, n_inputs = base.shape
    fit = Fit(new_adapter(n_inputs, n_classes, rank, seed))
    update = _Adam(learning_rate)
    step_of = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(steps_per_epoch)).cast("int")
    rows = (
        _complete(features)
        .select("id", "embedding", "label", step_of.alias("step"))
        .sortWithinPartitions("step")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        for epoch in range(epochs):
            for step in range(steps_per_epoch):
                loss, grad_a, grad_b = _gradients(
                    rows.where(F.col("step") == step), base, fit.adapter, dropout, seed + epoch
                )
                update(fit.adapter, grad_a, grad_b)
                log = {"loss": loss, "learning_rate": learning_rate,
                       "epoch": epoch + (step + 1) / steps_per_epoch}
                fit.logs.append(log)
                if on_log:
                    on_log(log)
            fit.epochs.append(Adapter(fit.adapter.a.copy(), fit.adapter.b.copy(), fit.adapter.alpha))
            if on_epoch:
                on_epoch(epoch + 1, fit.epochs[-1])
    finally:
        rows.unpersist()
    return fit


def _gradients(
    rows: DataFrame, base: np.ndarray, adapter: Adapter, dropout: float, seed: int
) -> tuple[float, np.ndarray, np.ndarray]:
    a, b, scale = adapter.a, adapter.b, adapter.scale

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        x = _matrix(batch.column("embedding"))
        labels = batch.column("label").to_numpy()
        if labels.min() < 0 or labels.max() >= base.shape[0]:
            raise ValueError(f"labels must be 0 to {base.shape[0] - 1}, the classes of the base")
        dropped = x * _dropout_mask(batch.column("id").to_numpy(), x.shape[1], dropout, seed)
        hidden = dropped @ a.T
        probability = _softmax(x @ base.T + scale * hidden @ b.T)
        picked = probability[np.arange(len(labels)), labels]
        error = probability.copy()
        error[np.arange(len(labels)), labels] -= 1.0
        total[0] += len(labels)
        total[1] -= np.log(np.maximum(picked, 1e-12)).sum()
        total[2:2 + a.size] += (scale * (error @ b).T @ dropped).ravel()
        total[2 + a.size:] += (scale * error.T @ hidden).ravel()

    totals = _summed(rows.select("id", "embedding", "label"), 2 + a.size + b.size, add)
    n_rows = max(totals[0], 1.0)
    return (
        float(totals[1] / n_rows),
        totals[2:2 + a.size].reshape(a.shape) / n_rows,
        totals[2 + a.size:].reshape(b.shape) / n_rows,
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _softmax(logits: np.ndarray) -> np.ndarray:
    weights = np.exp(logits - logits.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def _dropout_mask(ids: np.ndarray, width: int, rate: float, seed: int) -> np.ndarray:
    """Keep-or-drop per value, decided by a hash of seed, row id and position: a rerun task agrees."""
    if rate <= 0:
        return np.ones((len(ids), width))
    with np.errstate(over="ignore"):
        key = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64)
        key += np.uint64(seed + 1) * np.uint64(0xD1B54A32D192ED03)
        key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(31)
    uniform = key.astype(np.float64) / 2.0**64
    return (uniform >= rate) / (1.0 - rate)


class _Adam:
    def __init__(self, rate: float, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-8):
        self.rate, self.beta1, self.beta2, self.epsilon = rate, beta1, beta2, epsilon
        self.steps, self.moments = 0, {}

    def __call__(self, adapter: Adapter, grad_a: np.ndarray, grad_b: np.ndarray) -> None:
        self.steps += 1
        adapter.a = adapter.a - self._move("a", grad_a)
        adapter.b = adapter.b - self._move("b", grad_b)

    def _move(self, name: str, grad: np.ndarray) -> np.ndarray:
        first, second = self.moments.get(name, (np.zeros_like(grad), np.zeros_like(grad)))
        first = self.beta1 * first + (1 - self.beta1) * grad
        second = self.beta2 * second + (1 - self.beta2) * grad**2
        self.moments[name] = first, second
        unbiased = first / (1 - self.beta1**self.steps)
        return self.rate * unbiased / (np.sqrt(second / (1 - self.beta2**self.steps)) + self.epsilon)


def logits(base: np.ndarray, adapter: Adapter | None = None) -> Callable[[Column], Column]:
    """Class scores of an embedding: the base alone, or with an adapter added.

    Without an adapter only the base product is computed, so removing one restores the base exactly.
    """

    @F.arrow_udf("array<double>")
    def score(embeddings: pa.Array) -> pa.Array:
        if isinstance(embeddings, pa.ChunkedArray):
            embeddings = embeddings.combine_chunks()
        present = embeddings.is_valid().to_numpy(zero_copy_only=False)
        if not present.any():
            return pa.nulls(len(embeddings), pa.list_(pa.float64()))
        x = _matrix(embeddings.drop_null())
        scores = x @ base.T
        if adapter is not None:
            scores = scores + adapter.scale * (x @ adapter.a.T) @ adapter.b.T
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * scores.shape[1])
        lists = pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))
        return lists.take(pa.array(np.cumsum(present) - 1, mask=~present))

    return score


def score_features(features: DataFrame, base: np.ndarray, adapter: Adapter | None = None) -> DataFrame:
    """Adds ``logits`` and the predicted class, both NULL where there is no embedding."""
    scored = features.withColumn("logits", logits(base, adapter)(F.col("embedding")))
    best = F.array_position("logits", F.array_max("logits")) - 1
    return scored.withColumn("predicted", best.cast("int"))


def adapter_rows(spark: SparkSession, model: str, name: str, epoch: int, adapter: Adapter) -> DataFrame:
    """The two matrices as a table, one row per matrix row."""
    rows = [
        (model, name, epoch, matrix, i, [float(v) for v in values])
        for matrix, weights in (("A", adapter.a), ("B", adapter.b))
        for i, values in enumerate(weights)
    ]
    return spark.createDataFrame(rows, schemas.ADAPTER)


def save_adapter(spark: SparkSession, root: str, model: str, name: str, epoch: int, adapter: Adapter) -> None:
    """Writes the adapter of one epoch, partitioned so that one adapter is read by pruning. Saving it
    again replaces it."""
    (
        adapter_rows(spark, model, name, epoch, adapter)
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "name", "epoch")
        .parquet(root)
    )


def load_adapter(
    spark: SparkSession, root: str, model: str, name: str, epoch: int | None = None,
    alpha: float = fixed.ADAPTER_ALPHA,
) -> Adapter:
    """The adapter of an epoch, the last one by default."""
    saved = spark.read.parquet(root).where((F.col("model") == model) & (F.col("name") == name))
    if epoch is None:
        epoch = saved.agg(F.max("epoch")).first()[0]
    if epoch is None:
        raise ValueError(f"no adapter {name!r} for model {model!r}")
    rows = saved.where(F.col("epoch") == epoch).orderBy("matrix", "row").select("matrix", "values").collect()
    return Adapter(
        np.array([r["values"] for r in rows if r["matrix"] == "A"]),
        np.array([r["values"] for r in rows if r["matrix"] == "B"]),
        alpha,
    )


def fit_log_lines(spark: SparkSession, fit: Fit, run_id: str) -> DataFrame:
    """A run's own log as marked lines, which the log operators read like any other."""
    rows = [(run_id, i, log["loss"], log["learning_rate"], log["epoch"]) for i, log in enumerate(fit.logs)]
    logs = spark.createDataFrame(rows, "run_id string, seq bigint, loss double, learning_rate double, epoch double")
    return logs.select("run_id", "seq", log_line(F.struct("loss", "learning_rate", "epoch")).alias("line"))
