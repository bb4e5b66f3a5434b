"""The corpus pipeline: quality rules, near copies, repeated passages, source mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of ``documents``. A rejected document, all but one of each group of near copies and repeated passages go;
the mixture repeats or leaves out documents; the last stage returns token ids with a digest of what they decode to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tunelake.llm import bpe, mixing, near_dedup, quality, suffix_dedup
from tunelake.llm.queries_format import tokenizer
from tunelake.llm.registry import ready, table
from tunelake.session import shared_dir


def quality_rules(spark, docs, sf_dir):
    ready(spark)
    return quality.select_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark, docs, sf_dir):
    ready(spark)
    return near_dedup.keep_first(docs)


def repeated_passages(spark, docs, sf_dir):
    """Texts without the passages that an earlier document has, cut at whole characters."""
    ready(spark)
    rest = [name for name in docs.columns if name not in ("doc_id", "text", "n_chars")]
    cut = suffix_dedup.remove_repeats(docs, keep=rest, whole_chars=True)
    text = F.col("kept").cast("string")
    return cut.withColumn("text", text).withColumn("n_chars", F.char_length(text).cast("long")).select(*docs.columns)


def mixture(spark, docs, sf_dir):
    return mixing.repeat_documents(mixing.mix(docs), docs.columns)


def token_ids(spark, docs, sf_dir):
    ranks, pattern = tokenizer(ready(spark))
    return bpe.round_trip(docs, ranks, pattern, keep=["doc_id", "lang", "source"]).select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("token ids", token_ids),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``. What passes between two stages is stored in the cluster's shared folder."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
