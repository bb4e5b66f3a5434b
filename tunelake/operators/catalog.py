"""Model and adapter listings from folder paths, lookups and parameter counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.functions.text import (
    cached_model, cached_model_truncated, matches_search, model_folder, strip, valid_adapter_name,
)


def model_catalog(paths: DataFrame) -> DataFrame:
    """Models held in a cache, from the last element of each path."""
    folder = F.element_at(F.split("path", "/"), -1)
    return paths.withColumns({"model": cached_model(folder), "truncated": cached_model_truncated(folder)}).where(
        "model IS NOT NULL"
    )


def adapter_catalog(paths: DataFrame, loaded: DataFrame) -> DataFrame:
    """Adapters under ``<root>/<org--repo>/<adapter>`` that belong to a loaded model.

    ``loaded`` has one row per model in use. Its size decides the join; a model with very many adapters
    is split by the adaptive skew join.
    """
    parts = F.split("path", "/")
    adapters = paths.where(F.size(parts) >= 3).select(
        F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("adapter")
    )
    models = loaded.select("model", model_folder(F.col("model")).alias("folder")).distinct()
    return adapters.join(models, "folder").select("model", "adapter")


def adapter_selection(picks: DataFrame, adapters: DataFrame) -> DataFrame:
    """The adapter offered per pick (model, picked): the picked one if the model has it, else its first
    by name, else none."""
    first = adapters.groupBy("model").agg(F.min("adapter").alias("_first"))
    held = adapters.select("model", F.col("adapter").alias("picked"), F.lit(True).alias("_held")).distinct()
    offered = F.coalesce(F.when(F.col("_held"), F.col("picked")), F.col("_first"), F.lit(""))
    joined = picks.join(held, ["model", "picked"], "left").join(first, "model", "left")
    return joined.withColumn("selected", offered).drop("_held", "_first")


def adapter_names(names: DataFrame, default: str) -> DataFrame:
    """Whether each name is valid, the name a run would train under and the one shown after loading."""
    given = F.nullif("name", F.lit(""))
    return names.withColumns({
        "valid": valid_adapter_name(F.col("name")),
        "training_name": F.coalesce(given, F.lit(default)),
        "loaded_name": F.coalesce(given, F.lit(fixed.LEGACY_ADAPTER)),
    })


def model_search(models: DataFrame, query: str) -> DataFrame:
    """Models whose name holds the query, ignoring case."""
    return models.where(matches_search(F.lit(query), F.col("model")))


def can_fetch(models: DataFrame, query: str) -> DataFrame:
    """Whether the query names a model not held yet: it has a slash and no model is called exactly so."""
    wanted = strip(F.lit(query))
    known = F.coalesce(F.bool_or(F.col("model") == wanted), F.lit(False))
    return models.agg((F.contains(wanted, F.lit("/")) & ~known).alias("can_fetch"))


def known_models(wanted: DataFrame, models: DataFrame) -> DataFrame:
    return wanted.join(models.select("model"), "model", "left_semi")


def unknown_models(wanted: DataFrame, models: DataFrame) -> DataFrame:
    return wanted.join(models.select("model"), "model", "left_anti")


def model_options(current: DataFrame, models: DataFrame) -> DataFrame:
    """The current model first, then the others, without repeats or empty names. Sort by rank, model."""
    ranked = current.select("model", F.lit(0).alias("rank")).unionByName(
        models.select("model", F.lit(1).alias("rank"))
    )
    return ranked.where("model <> ''").groupBy("model").agg(F.min("rank").alias("rank"))


def trainable_params(layers: DataFrame, rank: int = fixed.ADAPTER_RANK) -> DataFrame:
    """Trainable against all parameters. Needs d_in, d_out and adapted per layer."""
    adapter = F.when(F.col("adapted"), F.lit(rank) * (F.col("d_in") + F.col("d_out"))).otherwise(F.lit(0))
    counted = layers.agg(
        F.sum(adapter).alias("trainable"), F.sum(F.col("d_in") * F.col("d_out")).alias("frozen")
    )
    return counted.withColumn("total", F.col("trainable") + F.col("frozen")).withColumn(
        "trainable_percent", F.round(100 * F.col("trainable") / F.col("total"), 6)
    )
