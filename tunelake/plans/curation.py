"""Curation queries over example lines made from the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tunelake.functions import json_lines as jl
from tunelake.functions.text import source_label
from tunelake.operators import curation as ops
from tunelake.operators.feedback import rating_capture
from tunelake.plans.inputs import BATCH_ID, LINES, RATINGS, example_lines, examples, id_sql, ingested, ratings, table
from tunelake.plans.registry import query
from tunelake.session import shared_dir
from tunelake.sources import versions
from tunelake.sources.jsonl import read_lines, read_numbered_lines, write_lines

SEARCH = "  The ThEr "


@query("scan_examples", f"""WITH {LINES}
SELECT prompt, response FROM ingested
WHERE (k IN (13) OR (k >= 21 AND score >= 7)) AND prompt <> '' AND response <> ''""")
def scan_examples(spark, sf_dir):
    """Written as JSON Lines files, read back, and filtered as training does: no default score applies."""
    path = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    write_lines(example_lines(spark, sf_dir), path)
    return ops.load_training_lines(read_lines(spark, path))


@query("scan_numbered", f"""WITH {LINES},
numbered AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS place FROM ingested)
SELECT {id_sql("1", "place", "prompt", "response")} AS example_id, place AS seq, prompt, response, status
FROM numbered""")
def scan_numbered(spark, sf_dir):
    """Written as JSON Lines files in order, and read back with numbers and ids that no split decides."""
    path = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    write_lines(example_lines(spark, sf_dir).repartitionByRange("seq").sortWithinPartitions("seq"), path)
    return ops.ingest_examples(read_numbered_lines(spark, path), BATCH_ID).select(
        "example_id", "seq", "prompt", "response", "status")


@query("parse_lines", f"""WITH {LINES}
SELECT seq, CASE status WHEN 'accepted' THEN 'object' WHEN 'not_string' THEN 'object'
                        WHEN 'missing_key' THEN 'object' ELSE status END AS state, prompt, response
FROM ingested""")
def parse_lines(spark, sf_dir):
    return ops.parse_lines(example_lines(spark, sf_dir))


@query("preview_counts", f"""WITH {LINES}
SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM (
  SELECT (status = 'accepted' AND k NOT IN (1, 2) AND r <> '') OR (k = 18 AND r <> '') AS ok
  FROM ingested JOIN lines USING (seq, k) WHERE status <> 'blank')""")
def preview_counts(spark, sf_dir):
    return ops.preview_counts(example_lines(spark, sf_dir))


@query("upload_accept", f"WITH {LINES} SELECT seq, status = 'accepted' AS accepted, status FROM ingested")
def upload_accept(spark, sf_dir):
    rows = ingested(spark, sf_dir)
    return rows.select("seq", (F.col("status") == "accepted").alias("accepted"), "status")


@query("upload_defaults", f"WITH {LINES} SELECT seq, score, source, issue FROM examples")
def upload_defaults(spark, sf_dir):
    return examples(spark, sf_dir).select("seq", "score", "source", "issue")


@query("ingest_examples", f"""WITH {LINES}
SELECT {id_sql("1", "seq", "prompt", "response")} AS example_id, 1::BIGINT AS batch_id, seq,
       prompt, response, CASE WHEN k IN (3, 4, 5, 6, 7, 8, 9, 10, 17, 19) THEN NULL ELSE score END AS score,
       CASE WHEN k IN (3, 4, 5, 6, 7, 8, 9, 10, 17, 19) THEN NULL ELSE source END AS source, status, issue
FROM ingested""")
def ingest_examples(spark, sf_dir):
    return ingested(spark, sf_dir)


@query("serialized_lines", f"""WITH {LINES}
SELECT e.seq, e.prompt, e.response, e.score, e.source, CASE WHEN k IN (26, 27) THEN 'x' END AS tag
FROM examples e JOIN ingested i USING (seq)""")
def serialized_lines(spark, sf_dir):
    """Accepted lines with their defaults written into the line and read back; unknown keys survive."""
    lines = ops.accepted(ops.ingest_examples(example_lines(spark, sf_dir), BATCH_ID, keep_line=True))
    again = jl.with_parsed(lines.select("seq", F.col("line").alias("value")))
    return again.select(
        "seq", F.col("parsed.prompt").alias("prompt"), F.col("parsed.response").alias("response"),
        F.col("parsed.score").alias("score"), F.col("parsed.source").alias("source"),
        F.get_json_object("value", "$.tags[0]").alias("tag"),
    )


@query("ingest_counts", f"WITH {LINES} SELECT status, count(*) AS lines FROM ingested GROUP BY status")
def ingest_counts(spark, sf_dir):
    return ops.ingest_counts(ingested(spark, sf_dir))


@query("list_examples", f"""WITH {LINES}
SELECT row_number() OVER (ORDER BY batch_id, seq) AS number, example_id, prompt, response, score, source, usable
FROM listed""")
def list_examples(spark, sf_dir):
    return ops.list_examples(examples(spark, sf_dir)).select(
        "number", "example_id", "prompt", "response", "score", "source", "usable"
    )


@query("newest_examples", f"WITH {LINES} SELECT seq, prompt, score, usable FROM listed ORDER BY seq DESC LIMIT 20")
def newest_examples(spark, sf_dir):
    return ops.newest_examples(examples(spark, sf_dir)).select("seq", "prompt", "score", "usable")


@query("dataset_summary", f"""WITH {LINES}
SELECT count(*) AS total, count(*) FILTER (usable) AS eligible, count(*) FILTER (NOT usable) AS skipped FROM listed""")
def dataset_summary(spark, sf_dir):
    return ops.dataset_summary(examples(spark, sf_dir))


@query("training_set", f"WITH {LINES} SELECT prompt, response FROM listed WHERE usable")
def training_set(spark, sf_dir):
    return ops.training_set(examples(spark, sf_dir))


@query("search_examples", f"""WITH {LINES}
SELECT seq FROM listed WHERE contains(lower(prompt), 'the ther') OR contains(lower(response), 'the ther')""")
def search_examples(spark, sf_dir):
    return ops.search_examples(examples(spark, sf_dir), SEARCH).select("seq")


@query("search_counts", f"""WITH {LINES}
SELECT count(*) FILTER (contains(lower(prompt), 'the ther') OR contains(lower(response), 'the ther')) AS matched,
       count(*) AS total FROM listed""")
def search_counts(spark, sf_dir):
    return ops.search_counts(examples(spark, sf_dir), SEARCH)


@query("source_labels", f"""WITH {LINES}
SELECT seq, CASE WHEN source = 'human_feedback' THEN 'Chat rating' WHEN source = 'manual_upload'
  THEN 'Added manually' WHEN coalesce(source, '') = '' THEN 'Unknown source' ELSE source END AS label FROM listed""")
def source_labels(spark, sf_dir):
    return ops.listed(examples(spark, sf_dir)).select("seq", source_label(F.col("source")).alias("label"))


def delete_requests(rows):
    """Every second example, every third request with a prompt the caller no longer sees."""
    stale = F.when(F.col("seq") % 3 == 0, F.concat("prompt", F.lit(" (old)"))).otherwise(F.col("prompt"))
    return rows.where("seq % 2 = 0").select("example_id", stale.alias("prompt"), "seq")


def stored(spark, sf_dir):
    """The accepted examples as the first version of a dataset of their own."""
    return versions.append(versions.Snapshot(f"{shared_dir(spark)}/set-{uuid.uuid4().hex}", 0), examples(spark, sf_dir))


@query("delete_example", f"""WITH {LINES}
SELECT seq, example_id FROM examples
WHERE NOT (seq % 2 = 0 AND seq % 3 <> 0 AND prompt IS NOT NULL)""")
def delete_example(spark, sf_dir):
    """Stored, deleted from and committed; what is read back is the current version."""
    base = stored(spark, sf_dir)
    versions.delete(base, delete_requests(base.examples(spark)))
    return versions.snapshot(spark, base.root).examples(spark).select("seq", "example_id")


@query("delete_conflicts", f"""WITH {LINES}
SELECT seq, example_id FROM examples WHERE seq % 2 = 0 AND (seq % 3 = 0 OR prompt IS NULL)""")
def delete_conflicts(spark, sf_dir):
    rows = examples(spark, sf_dir)
    return ops.delete_conflicts(rows, delete_requests(rows)).select("seq", "example_id")


@query("clear_dataset", "SELECT count(*) AS removed, 0::BIGINT AS remaining FROM documents")
def clear_dataset(spark, sf_dir):
    """An empty version is committed; ``removed`` counts the lines, bad ones included."""
    base = stored(spark, sf_dir)
    versions.clear(spark, base)
    left = versions.snapshot(spark, base.root).examples(spark).agg(F.count("*").alias("remaining"))
    removed = ops.lines_removed(example_lines(spark, sf_dir))
    return removed.unionByName(left, allowMissingColumns=True).agg(
        F.max("removed").alias("removed"), F.max("remaining").alias("remaining")
    )


@query("dataset_versions", f"""WITH {LINES}, {RATINGS},
first AS (SELECT example_id, seq, prompt FROM examples),
second AS (SELECT * FROM first WHERE NOT (seq % 2 = 0 AND seq % 3 <> 0 AND prompt IS NOT NULL)),
rated AS (SELECT count(DISTINCT message_id) AS n FROM ratings WHERE score >= 7 AND prompt <> '' AND response <> '')
SELECT 1::BIGINT AS version, 'append' AS note, 1 AS n_parts, count(*) AS n, count(prompt) AS n_prompts FROM first
UNION ALL SELECT 2, 'delete', 1, count(*), count(prompt) FROM second
UNION ALL SELECT 3, 'append', 2, count(*) + min(rated.n), count(prompt) + min(rated.n) FROM second, rated
UNION ALL SELECT 4, 'clear', 0, 0, 0""")
def dataset_versions(spark, sf_dir):
    """Examples stored, some deleted, rated replies added to what is current by then, all cleared: every version read
    back."""
    base = stored(spark, sf_dir)
    versions.change(spark, base.root, lambda now: versions.delete(now, delete_requests(now.examples(spark))))
    captured = rating_capture(ratings(spark, sf_dir), 2)
    names = base.examples(spark).columns
    captured = captured.select(*[F.col(c) if c in captured.columns else F.lit(None).alias(c) for c in names])
    versions.change(spark, base.root, lambda now: versions.append(now, captured))
    versions.change(spark, base.root, lambda now: versions.clear(spark, now))
    found = [versions.snapshot(spark, base.root, version) for version in versions.versions(spark, base.root)]
    counted = [shot.examples(spark).agg(F.lit(shot.version).cast("long").alias("version"), F.count("*").alias("n"),
                                        F.count("prompt").alias("n_prompts")) for shot in found]
    return versions.history(spark, base.root).join(ops.all_examples(*counted), "version")


@query("all_examples", f"""WITH {LINES}, {RATINGS}
SELECT source, count(*) AS n, count(DISTINCT prompt) AS prompts FROM (
  SELECT prompt, source FROM examples UNION ALL
  SELECT arg_min(prompt, ts) AS prompt, 'human_feedback' AS source FROM ratings
  WHERE score >= 7 AND prompt <> '' AND response <> '' GROUP BY message_id) GROUP BY source""")
def all_examples(spark, sf_dir):
    columns = ["example_id", "batch_id", "prompt", "response", "score", "source"]
    merged = ops.all_examples(
        examples(spark, sf_dir).select(columns), rating_capture(ratings(spark, sf_dir), 2).select(columns)
    )
    return merged.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("prompt").alias("prompts"))


@query("readiness", f"""WITH {LINES}
SELECT source, eligible, CASE WHEN eligible < 10 THEN 'too few' WHEN eligible < 50 THEN 'quick test'
  ELSE 'consistent style' END AS readiness
FROM (SELECT source, count(*) FILTER (usable) AS eligible FROM listed GROUP BY source)""")
def readiness(spark, sf_dir):
    return ops.readiness(examples(spark, sf_dir))


DUPLICATES = r"""
WITH normal AS (
  SELECT doc_id, lower(trim(regexp_replace('Write a ' || lang || ' text', '[ \t\n\r\f]+', ' ', 'g'))) AS p,
         lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f]+', ' ', 'g'))) AS r FROM documents)
SELECT sha256(length(p)::VARCHAR || ':' || p || r) AS text_hash, count(*) AS n_examples,
       arg_min(doc_id::VARCHAR, doc_id) AS first_id
FROM normal GROUP BY p, r
"""


def document_examples(spark, sf_dir):
    """Each document as the answer to a request for a text in its language."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("example_id"), F.lit(1).cast("bigint").alias("batch_id"),
        F.col("doc_id").alias("seq"), F.concat(F.lit("Write a "), "lang", F.lit(" text")).alias("prompt"),
        F.col("text").alias("response"))


@query("exact_duplicates", DUPLICATES)
def exact_duplicates(spark, sf_dir):
    return ops.exact_duplicates(document_examples(spark, sf_dir), min_size=1)
