"""Queries that judge, search and remove documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunelake.llm import near_dedup, quality, suffix_dedup, toxicity
from tunelake.llm.registry import query, table

_RATIO_SQL = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}

QUALITY_SQL = r"""
WITH cut AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM cut),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 4]) AS n FROM places),
covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM windows, range(0, 5) t(j) WHERE n > 1 GROUP BY doc_id),
features AS (
  SELECT doc_id, lang, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM cut LEFT JOIN covered USING (doc_id)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM features),
good AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
tries AS (
""" + "\n  UNION ALL ".join(
    f"SELECT '{name}' AS ratio, {i} AS place, {cut}::DOUBLE AS cut"
    for name, (_, grid) in quality.RATIOS.items() for i, cut in enumerate(grid)
) + r"""),
ratios AS (
""" + "\n  UNION ALL ".join(
    f"SELECT doc_id, lang, base_failed, '{name}' AS ratio, {text} AS value FROM based"
    for name, text in _RATIO_SQL.items()
) + rf"""),
strata AS (SELECT count(*) AS n FROM (SELECT DISTINCT lang FROM documents)),
counts AS (
  SELECT lang, ratio, place, cut, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad,
         count(*) FILTER (good AND value > cut) AS lost, count(*) FILTER (NOT good AND value > cut) AS caught
  FROM ratios JOIN good USING (doc_id) JOIN tries USING (ratio) WHERE NOT base_failed GROUP BY ALL),
tested AS (
  SELECT *, caught / greatest(n_bad, 1) - {quality.GOOD_COST} * lost / n_good AS gain,
         list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1)
           + i * ln({quality.MAX_FALSE_REJECTION} / {len(quality.RATIOS)})
           + (n_good - i) * ln(1 - {quality.MAX_FALSE_REJECTION} / {len(quality.RATIOS)})))) AS tail
  FROM counts WHERE n_good > 0),
chosen AS (
  SELECT lang, ratio, cut FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, ratio ORDER BY gain DESC, place) AS best FROM tested
    WHERE lost < n_good AND gain > 0
      AND tail <= (1 - {quality.CONFIDENCE}) / (SELECT n * (SELECT count(*) FROM tries) FROM strata))
  WHERE best = 1),
rejected AS (
  SELECT DISTINCT doc_id FROM ratios JOIN chosen
  ON ratios.ratio = chosen.ratio AND ratios.lang IS NOT DISTINCT FROM chosen.lang AND value > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rejected.doc_id IS NULL AS kept
FROM based LEFT JOIN rejected USING (doc_id)
"""


@query("op5_quality_rules", QUALITY_SQL)
def quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


REPEATS_SQL = r"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
places AS (SELECT doc_id, digits, unnest(range(0, length(digits) // 2)) AS i FROM raw),
windows AS (
  SELECT doc_id, i, substr(digits, 2 * i + 1, 2) AS byte,
         CASE WHEN 2 * i + 100 <= length(digits) THEN substr(digits, 2 * i + 1, 100) END AS gram
  FROM places),
firsts AS (SELECT gram, min(doc_id) AS first_id FROM windows WHERE gram IS NOT NULL GROUP BY gram HAVING count(*) > 1),
marked AS (
  SELECT doc_id, i, byte, CASE WHEN first_id < doc_id THEN i END AS hit FROM windows LEFT JOIN firsts USING (gram)),
covered AS (
  SELECT doc_id, i, byte, coalesce(max(hit) OVER (PARTITION BY doc_id ORDER BY i) > i - 50, false) AS gone FROM marked),
runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM covered),
summed AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
         string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS rest
  FROM runs GROUP BY doc_id)
SELECT doc_id, (length(digits) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM raw LEFT JOIN summed USING (doc_id)
"""


@query("op4_suffix_dedup", REPEATS_SQL)
def suffix_repeats(spark, sf_dir):
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["stop"] - span["start"])
    return kept.select(
        "doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_near_dedup")
def near_copies(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "class_id", "n_class")


@query("op6_toxicity")
def toxic_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.language_model(docs)
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"), model)
    return toxicity.score(docs, model, scorer, keep=["doc_id"]).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
