"""Queries that rearrange texts and compare their words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunelake.llm import fill_middle, spelling
from tunelake.llm.registry import query, table

FILL_SQL = rf"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('{fill_middle.SEED}:' || doc_id) AS digest
  FROM documents),
draws AS (
  SELECT *, len(lines)::BIGINT AS n, ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2,
         ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4
  FROM units),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR h3 % 100 >= {fill_middle.RATE} THEN 'plain'
              WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM draws),
parts AS (
  SELECT *, array_to_string(lines[1:low], '') AS prefix, array_to_string(lines[low + 1:high], '') AS middle,
         array_to_string(lines[high + 1:], '') AS suffix
  FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query("op12_fill_middle", FILL_SQL)
def fill_in_middle(spark, sf_dir):
    moved = fill_middle.transform(table(spark, sf_dir, "documents"))
    return fill_middle.restore(moved).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias(
            "output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


# DuckDB has no crc32: the checksum is folded over the bytes with the table of its polynomial.
SPELLING_SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS steps),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
counted AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs GROUP BY ALL),
bytes AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS digits FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(0, length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
    lambda c, byte: xor(c >> 8, steps[xor(c & 255, byte) + 1])), 4294967295::BIGINT) AS h
  FROM bytes, steps),
typed AS (
  SELECT CASE WHEN h % {spelling.TYPO_ONE_IN} = 0
    THEN substr(run, 1, h % length(run)) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= {spelling.MIN_LENGTH}
  GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
edits AS (
  SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS replaced,
         substr(word, 1, i - 1) || substr(word, i + 1) AS deleted FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM edits a JOIN edits b ON a.replaced = b.replaced AND a.word <> b.word
  UNION SELECT edits.word, words.word, words.n FROM edits JOIN words ON edits.deleted = words.word
  UNION SELECT words.word, edits.word, edits.n FROM edits JOIN words ON edits.deleted = words.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN form_n >= {spelling.TIMES} * n THEN form END AS form,
         CASE WHEN form_n >= {spelling.TIMES} * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chains AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT chains.word, formed.form FROM chains JOIN formed ON formed.word = chains.root WHERE formed.form IS NOT NULL)
SELECT formed.*, root FROM formed JOIN (
  SELECT chains.word, chains.root FROM chains JOIN formed ON formed.word = chains.root WHERE formed.form IS NULL) USING (word)
"""


@query("op13_spelling_variants", SPELLING_SQL)
def spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))
