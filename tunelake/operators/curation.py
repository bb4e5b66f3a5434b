"""Ingest, listing, search, deletion and totals of training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.functions import json_lines as jl
from tunelake.functions.text import matches_search
from tunelake.operators.ordered import number_rows, position_chunk


def parse_lines(lines: DataFrame) -> DataFrame:
    """One row per line with its parse state, and the text fields where they are text."""
    return jl.with_parsed(lines).select(
        "seq",
        F.col("parsed.state").alias("state"),
        F.col("parsed.prompt").alias("prompt"),
        F.col("parsed.response").alias("response"),
    )


def preview_counts(lines: DataFrame) -> DataFrame:
    """Valid and invalid lines by the preview rule; blank lines count as neither."""
    return (
        jl.with_parsed(lines)
        .where(F.col("parsed.state") != "blank")
        .agg(F.count_if(jl.preview_valid()).alias("valid"), F.count_if(~jl.preview_valid()).alias("invalid"))
    )


def load_training_lines(lines: DataFrame, threshold: float = fixed.USABLE_SCORE) -> DataFrame:
    """Training rows straight from stored lines: a missing score reads as zero, so it is left out."""
    return (
        jl.with_parsed(lines)
        .where(
            jl.is_object()
            & jl.good_score(F.col("parsed.score"), threshold)
            & (F.col("parsed.prompt") != "")
            & (F.col("parsed.response") != "")
        )
        .select(F.col("parsed.prompt").alias("prompt"), F.col("parsed.response").alias("response"))
    )


def ingest_examples(lines: DataFrame, batch_id: int, keep_line: bool = False) -> DataFrame:
    """Validates and completes a batch. One row per line; ``status`` is ``accepted`` or the reason it is not.

    One pass without a shuffle. Split it with :func:`accepted` and :func:`quarantined`.
    """
    columns: list[Column] = [
        jl.example_id(F.lit(batch_id), F.col("seq"), F.col("parsed.prompt"), F.col("parsed.response"))
        .alias("example_id"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("parsed.prompt").alias("prompt"),
        F.col("parsed.response").alias("response"),
        jl.upload_score().alias("score"),
        jl.upload_source().alias("source"),
        jl.upload_status().alias("status"),
        jl.score_issue().alias("issue"),
    ]
    if keep_line:
        columns.append(
            F.when(jl.upload_status() == "accepted", jl.upload_line())
            .otherwise(F.col("parsed.text")).alias("line")
        )
    return jl.with_parsed(lines).select(*columns)


def accepted(ingested: DataFrame) -> DataFrame:
    return ingested.where(F.col("status") == "accepted").drop("status")


def quarantined(ingested: DataFrame) -> DataFrame:
    return ingested.where(~F.col("status").isin("accepted", "blank"))


def ingest_counts(ingested: DataFrame) -> DataFrame:
    """Lines by status; ``accepted`` is the number added."""
    return ingested.groupBy("status").agg(F.count("*").alias("lines"))


def listed(examples: DataFrame) -> DataFrame:
    """Examples a listing shows: prompt and response both non-empty. A missing score shows as 0, a missing source as
    the empty text."""
    shown = examples.where((F.col("prompt") != "") & (F.col("response") != "")).withColumns({
        "usable": jl.usable(F.col("score")), "score": F.coalesce("score", F.lit(fixed.LISTING_SCORE)),
    })
    return shown.withColumn("source", F.coalesce("source", F.lit(""))) if "source" in shown.columns else shown


def list_examples(examples: DataFrame) -> DataFrame:
    """The listing with each example's number, counted from 1 in insertion order.

    Sort by ``number`` descending for newest first.
    """
    shown = listed(examples).withColumn("_chunk", position_chunk("seq"))
    return number_rows(shown, ["seq"], ["batch_id", "_chunk"]).drop("_chunk")


def newest_examples(examples: DataFrame, page: int = 20) -> DataFrame:
    """The first page of the listing, newest first."""
    return listed(examples).orderBy(F.col("batch_id").desc(), F.col("seq").desc()).limit(page)


def dataset_summary(examples: DataFrame) -> DataFrame:
    totals = listed(examples).agg(
        F.count("*").alias("total"), F.count_if("usable").alias("eligible")
    )
    return totals.withColumn("skipped", F.col("total") - F.col("eligible"))


def training_set(examples: DataFrame, threshold: float = fixed.USABLE_SCORE) -> DataFrame:
    """Prompt and response of the examples good enough to train on."""
    return examples.where(
        jl.good_score(F.col("score"), threshold) & (F.col("prompt") != "") & (F.col("response") != "")
    ).select("prompt", "response")


def search_examples(examples: DataFrame, query: str) -> DataFrame:
    return listed(examples).where(matches_search(F.lit(query), F.col("prompt"), F.col("response")))


def search_counts(examples: DataFrame, query: str) -> DataFrame:
    found = matches_search(F.lit(query), F.col("prompt"), F.col("response"))
    return listed(examples).agg(F.count_if(found).alias("matched"), F.count("*").alias("total"))


def delete_examples(examples: DataFrame, requests: DataFrame) -> DataFrame:
    """The dataset without the examples whose id and prompt both match a request.

    :func:`tunelake.sources.versions.delete` commits the result as the next version of a stored dataset.
    """
    return examples.join(requests.select("example_id", "prompt"), ["example_id", "prompt"], "left_anti")


def delete_conflicts(examples: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that match no example as the caller saw it: gone, or another prompt by now."""
    return requests.join(examples.select("example_id", "prompt"), ["example_id", "prompt"], "left_anti")


def lines_removed(lines: DataFrame) -> DataFrame:
    """How many lines a clear removes, bad ones included; :func:`tunelake.sources.versions.clear` does it."""
    return lines.agg(F.count("*").alias("removed"))


def all_examples(*parts: DataFrame) -> DataFrame:
    """Uploads and rated replies as one dataset, duplicates kept."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def readiness(examples: DataFrame) -> DataFrame:
    """Usable examples per source against the guide's sizes for a quick test and a consistent style."""
    counted = listed(examples).groupBy("source").agg(F.count_if("usable").alias("eligible"))
    return counted.withColumn(
        "readiness",
        F.when(F.col("eligible") < fixed.QUICK_TEST_SIZE, F.lit("too few"))
        .when(F.col("eligible") < fixed.CONSISTENT_SIZE, F.lit("quick test"))
        .otherwise(F.lit("consistent style")),
    )


def exact_duplicates(examples: DataFrame, min_size: int = 2) -> DataFrame:
    """Groups of examples with the same prompt and response, white space and letter case aside: the group's size and
    its first example. One row per group; only hashes are shuffled, folded by each task first."""
    prompt, response = (
        F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"[ \t\n\r\f]+", " ")))
        for name in ("prompt", "response")
    )
    text = F.sha2(F.concat(F.char_length(prompt).cast("string"), F.lit(":"), prompt, response), 256)
    groups = examples.select(text.alias("text_hash"), "example_id", "batch_id", "seq").groupBy("text_hash").agg(
        F.count("*").alias("n_examples"), F.min_by("example_id", F.struct("batch_id", "seq")).alias("first_id"))
    return groups.where(F.col("n_examples") >= min_size)
