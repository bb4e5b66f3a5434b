"""Sequence queries: training text, vocabulary, ids, masks, budgets and the batch plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.operators import conversations
from tunelake.operators import sequences as ops
from tunelake.plans.inputs import LINES, MESSAGES, examples, messages, table
from tunelake.plans.registry import query

LENGTH = fixed.MAX_LENGTH
SHORT = 64
"""A length that cuts many of the rows here."""


def sft_rows(spark, sf_dir):
    return ops.training_text(conversations.answered_pairs(messages(spark, sf_dir)))


SFT = f"""{MESSAGES},
sft AS (
  SELECT conv_id, turn, '<|user|>' || chr(10) || prompt || '<|endoftext|>' || chr(10) || '<|assistant|>' || chr(10)
    AS prefix, prefix || shown || '<|endoftext|>' AS full_text FROM pairs),
pieces AS (
  SELECT conv_id, turn, regexp_extract_all(full_text, '<\\|[a-z]+\\|>|[^ \\t\\n\\r\\f<]+|<') AS full_tokens,
         len(regexp_extract_all(prefix, '<\\|[a-z]+\\|>|[^ \\t\\n\\r\\f<]+|<')) AS n_prompt FROM sft),
flat AS (
  SELECT conv_id, turn, unnest(full_tokens) AS token, generate_subscripts(full_tokens, 1) AS pos FROM pieces),
vocab AS (
  SELECT token, uses, (row_number() OVER (ORDER BY uses DESC, token) + 1)::INTEGER AS token_id
  FROM (SELECT token, count(*) AS uses FROM flat WHERE token <> '<|endoftext|>' GROUP BY token)),
tokenized AS (
  SELECT conv_id, turn, list(CASE WHEN flat.token = '<|endoftext|>' THEN 0 ELSE coalesce(token_id, 1) END
    ORDER BY pos) AS ids FROM flat LEFT JOIN vocab ON vocab.token = flat.token GROUP BY conv_id, turn),
rows AS (
  SELECT conv_id, turn, ids, n_prompt, len(ids) AS n, least(len(ids), {LENGTH}) AS kept,
         range({LENGTH}) AS slots
  FROM tokenized JOIN pieces USING (conv_id, turn))
"""


@query("sft_text", f"WITH {SFT} SELECT conv_id, turn, prefix, full_text FROM sft")
def sft_text(spark, sf_dir):
    return sft_rows(spark, sf_dir).select("conv_id", "turn", "prefix", "full_text")


@query("vocabulary", f"WITH {SFT} SELECT token, uses, token_id FROM vocab")
def vocabulary(spark, sf_dir):
    return ops.vocabulary(sft_rows(spark, sf_dir))


def tokenized(spark, sf_dir):
    return ops.tokenize_once(sft_rows(spark, sf_dir), ["conv_id", "turn"])


def joined(ids):
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


@query("tokenize", f"""WITH {SFT}
SELECT conv_id, turn, array_to_string(ids, ' ') AS ids, n_prompt::INTEGER AS n_prompt FROM rows""")
def tokenize(spark, sf_dir):
    return tokenized(spark, sf_dir).select("conv_id", "turn", joined(F.col("ids")).alias("ids"), "n_prompt")


@query("tokenize_callable", """
SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)), ' ') AS ids
FROM conversations""")
def tokenize_callable(spark, sf_dir):
    """A caller's tokenizer, here code points of characters."""
    encode = ops.callable_encoder(lambda: lambda texts: [[ord(c) for c in text] for text in texts])
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", joined(encode(F.col("text"))).alias("ids"))


@query("pad_truncate", f"""WITH {SFT}
SELECT conv_id, turn,
  array_to_string(list_transform(slots, lambda i: CASE WHEN i < n THEN ids[i + 1] ELSE 0 END), ' ') AS input_ids,
  array_to_string(list_transform(slots, lambda i: CASE WHEN i < n THEN 1 ELSE 0 END), ' ') AS attention_mask FROM rows""")
def pad_truncate(spark, sf_dir):
    rows = ops.pad_truncate(tokenized(spark, sf_dir), LENGTH)
    return rows.select("conv_id", "turn", joined(F.col("input_ids")).alias("input_ids"),
                       joined(F.col("attention_mask")).alias("attention_mask"))


@query("label_mask", f"""WITH {SFT}
SELECT conv_id, turn,
  array_to_string(list_transform(slots, lambda i: CASE WHEN i < n_prompt OR i >= n THEN -100 ELSE ids[i + 1] END), ' ')
    AS labels, n::INTEGER AS n_tokens, n > {LENGTH} AS truncated, n_prompt >= kept AS fully_masked FROM rows""")
def label_mask(spark, sf_dir):
    rows = ops.label_mask(tokenized(spark, sf_dir), LENGTH)
    return rows.select("conv_id", "turn", joined(F.col("labels")).alias("labels"), "n_tokens", "truncated",
                       "fully_masked")


@query("label_mask_short", f"""WITH {SFT}
SELECT conv_id, turn,
  array_to_string(list_transform(range({SHORT}), lambda i: CASE WHEN i < n_prompt OR i >= n THEN -100 ELSE ids[i + 1] END), ' ')
    AS labels, n::INTEGER AS n_tokens, n > {SHORT} AS truncated, n_prompt >= least(n, {SHORT}) AS fully_masked FROM rows""")
def label_mask_short(spark, sf_dir):
    rows = ops.label_mask(tokenized(spark, sf_dir), SHORT)
    return rows.select("conv_id", "turn", joined(F.col("labels")).alias("labels"), "n_tokens", "truncated",
                       "fully_masked")


@query("token_budget", f"""WITH {SFT}
SELECT count(*) AS n_rows, sum(n_prompt)::BIGINT AS prompt_tokens, sum(n - n_prompt)::BIGINT AS response_tokens,
  count(*) FILTER (n > {LENGTH}) AS truncated_rows, count(*) FILTER (n_prompt >= kept) AS fully_masked_rows,
  sum(greatest(kept - n_prompt, 0))::BIGINT AS trained_tokens,
  round(1 - sum(kept) / (count(*) * {LENGTH}), 6) AS padding_share FROM rows""")
def token_budget(spark, sf_dir):
    return ops.token_budget(tokenized(spark, sf_dir), LENGTH)


@query("batch_manifest", f"""WITH {LINES},
draws AS (
  SELECT epoch::INTEGER AS epoch, example_id, md5(concat_ws(':', '7', epoch, example_id)) AS draw
  FROM listed, (SELECT unnest(range({fixed.EPOCHS})) AS epoch) WHERE usable),
ordered AS (
  SELECT epoch, example_id, row_number() OVER (PARTITION BY epoch ORDER BY draw, example_id) - 1 AS position FROM draws)
SELECT epoch, example_id, position, position AS batch, position // {fixed.ACCUMULATION} AS step FROM ordered""")
def batch_manifest(spark, sf_dir):
    usable = examples(spark, sf_dir).where("score >= 7 AND prompt <> '' AND response <> ''")
    return ops.batch_manifest(usable, seed=7)
