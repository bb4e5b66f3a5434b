"""Conversation queries: pairs, histories, requests and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.functions import chat
from tunelake.operators import conversations as ops
from tunelake.operators.decode import inference_requests as with_parameters
from tunelake.operators.ordered import ordered_scan, position_chunk
from tunelake.plans.inputs import MESSAGES, messages, table
from tunelake.plans.registry import query


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("conversation_pairs", f"WITH {MESSAGES} SELECT conv_id, turn, prompt, response FROM pairs")
def conversation_pairs(spark, sf_dir):
    return ops.conversation_pairs(messages(spark, sf_dir))


@query("split_thinking", f"WITH {MESSAGES} SELECT conv_id, turn, thought, answer FROM split")
def split_thinking(spark, sf_dir):
    return ops.split_thinking(messages(spark, sf_dir)).select("conv_id", "turn", "thought", "answer")


HISTORY = """
history AS (
  SELECT conv_id, turn, role, raw AS message,
         coalesce(count(*) FILTER (keep) OVER w, 0) AS n_history,
         string_agg(role || ':' || content, '|' ORDER BY turn) FILTER (keep) OVER w AS joined,
         string_agg('<|' || role || '|>' || chr(10) || content || '<|endoftext|>' || chr(10), '' ORDER BY turn)
           FILTER (keep) OVER w AS rendered
  FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
requests AS (
  SELECT conv_id, turn, message, n_history, coalesce(joined, '') AS history, coalesce(rendered, '') AS rendered
  FROM history WHERE role = 'user')
"""


def joined_history(history):
    return F.array_join(F.transform(history, lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|")


@query("chat_history", f"WITH {MESSAGES}, {HISTORY} SELECT conv_id, turn, message, n_history, history FROM requests")
def chat_history(spark, sf_dir):
    rows = ops.chat_history(messages(spark, sf_dir))
    return rows.select(
        "conv_id", "turn", "message", F.size("history").cast("bigint").alias("n_history"),
        joined_history(F.col("history")).alias("history"),
    )


@query("history_blocks", f"""WITH {MESSAGES}
SELECT conv_id, turn // 4 AS block,
       coalesce(sum(count(*) FILTER (keep)) OVER (PARTITION BY conv_id ORDER BY turn // 4
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_before,
       count(*) FILTER (keep) AS n,
       coalesce(string_agg(role || ':' || content, '|' ORDER BY turn) FILTER (keep), '') AS turns
FROM kept GROUP BY conv_id, turn // 4""")
def history_blocks(spark, sf_dir):
    """Blocks of four turns, so that the conversations here span several."""
    rows = ops.history_blocks(messages(spark, sf_dir), block=4)
    return rows.withColumn("turns", joined_history(F.col("turns")))


@query("regenerate_requests", f"""WITH {MESSAGES}, {HISTORY},
ends AS (
  SELECT conv_id, turn, role, lag(role) OVER w AS asked_role, lag(turn) OVER w AS asked_turn
  FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
SELECT r.conv_id, r.turn, r.message, r.n_history FROM ends JOIN requests r
  ON r.conv_id = ends.conv_id AND r.turn = ends.asked_turn
WHERE ends.role = 'assistant' AND ends.asked_role = 'user' AND r.message <> ''""")
def regenerate_requests(spark, sf_dir):
    return ops.regenerate_requests(messages(spark, sf_dir)).withColumn("n_history", F.col("n_history").cast("bigint"))


def replies(spark, sf_dir):
    """Assistant turns as replies, some of them replaced by the two kinds of failure."""
    content = (
        F.when(F.col("turn") % 5 == 0, F.concat(F.lit("System: No model loaded. "), "text"))
        .when(F.col("turn") % 5 == 1, F.concat(F.lit("Error during inference: "), "text"))
        .when(F.col("turn") % 5 == 2, F.concat(F.lit("System: "), "text"))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", "role", content.alias("content")
    )


@query("reply_errors", """
SELECT conv_id, turn, CASE WHEN turn % 5 < 2 THEN 'error' ELSE role END AS role,
  CASE turn % 5 WHEN 0 THEN 'No model loaded. ' || text WHEN 1 THEN 'Error during inference: ' || text
                WHEN 2 THEN 'System: ' || text ELSE text END AS content
FROM conversations WHERE role = 'assistant'""")
def reply_errors(spark, sf_dir):
    return ops.reply_roles(replies(spark, sf_dir))


def prompt_settings(spark, sf_dir):
    """System prompts asked for per conversation: a persona's, blank, padded, or the turn's own text."""
    name = F.element_at(F.array(*[F.lit(n) for n in [*fixed.PERSONAS, "Nobody"]]), (F.col("conv_id") % 5 + 1).cast("int"))
    asked = F.when(F.col("turn") % 3 == 0, F.lit(" \n ")).when(F.col("turn") % 3 == 1, F.lit(
        "  You are a cheerful pirate. Answer every question in pirate speak.\n")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("persona"), asked.alias("asked"))


ASKED = """
asked AS (
  SELECT conv_id, turn, text, ['Assistant', 'Coder', 'Tutor', 'Pirate', 'Nobody'][conv_id % 5 + 1] AS persona,
    CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'You are a cheerful pirate. Answer every question in pirate speak.'
                  ELSE trim(text, E' \\t\\n\\r') END AS trimmed
  FROM conversations)
"""


@query("system_prompt", f"""WITH {ASKED}
SELECT conv_id, turn, CASE WHEN trimmed = '' THEN 'You are a helpful AI assistant.' ELSE trimmed END AS system,
  CASE turn % 3 WHEN 0 THEN chr(32) || chr(10) || chr(32)
    WHEN 1 THEN '  You are a cheerful pirate. Answer every question in pirate speak.' || chr(10)
    ELSE CASE WHEN text = '' THEN trimmed ELSE text END END AS after_load
FROM asked""")
def system_prompt(spark, sf_dir):
    rows = prompt_settings(spark, sf_dir).withColumn("system", chat.system_prompt(F.col("asked")))
    return rows.select(
        "conv_id", "turn", "system",
        chat.system_prompt_after_load(F.col("system"), F.col("asked")).alias("after_load"),
    )


PERSONA_ROWS = ", ".join(f"({sql_text(n)}, {sql_text(p)})" for n, p in fixed.PERSONAS.items())


@query("persona_lookup", f"""WITH {ASKED}, personas(persona, prompt) AS (VALUES {PERSONA_ROWS})
SELECT conv_id, turn, asked.persona, p.prompt, a.persona AS active FROM asked
LEFT JOIN personas p ON p.persona = asked.persona LEFT JOIN personas a ON a.prompt = trimmed""")
def persona_lookup(spark, sf_dir):
    personas = ops.persona_table(spark)
    rows = prompt_settings(spark, sf_dir).withColumnRenamed("asked", "system")
    rows = ops.active_persona(ops.persona_lookup(rows, personas), personas)
    return rows.select("conv_id", "turn", "persona", "prompt", "active")


def requests(spark, sf_dir):
    """Requests of all user turns, with thinking and adapter switches by conversation."""
    return ops.chat_history(messages(spark, sf_dir)).select(
        "conv_id", "turn", "message", "history",
        chat.system_prompt(F.when(F.col("conv_id") % 2 == 0, F.lit(" ")).otherwise(F.lit(fixed.PERSONAS["Coder"])))
        .alias("system"),
        (F.col("conv_id") % 3 > 0).alias("enable_thinking"),
        (F.col("conv_id") % 4 == 0).alias("adapter_loaded"),
        (F.col("conv_id") % 7 > 0).alias("template"),
    )


BUILT = f"""
built AS (
  SELECT conv_id, turn, message, n_history, rendered, conv_id % 7 > 0 AS template,
         conv_id % 3 > 0 AND NOT conv_id % 4 = 0 AS thinking,
         CASE WHEN conv_id % 2 = 0 THEN {sql_text(fixed.DEFAULT_SYSTEM_PROMPT)}
              ELSE {sql_text(fixed.PERSONAS["Coder"])} END AS system
  FROM requests),
prompts AS (
  SELECT *, CASE WHEN NOT template THEN message ELSE
    '<|system|>' || chr(10) || system
    || CASE WHEN thinking THEN {sql_text(fixed.THINKING_SUFFIX)} ELSE {sql_text(fixed.DIRECT_SUFFIX)} END
    || '<|endoftext|>' || chr(10)
    || CASE WHEN thinking THEN '<|user|>' || chr(10) || 'Hello<|endoftext|>' || chr(10) || '<|assistant|>' || chr(10)
         || {sql_text(fixed.ONE_SHOT_ASSISTANT)} || '<|endoftext|>' || chr(10) ELSE '' END
    || rendered || '<|user|>' || chr(10) || message || '<|endoftext|>' || chr(10) || '<|assistant|>' || chr(10)
    END AS prompt
  FROM built)
"""


@query("thinking_mode", f"WITH {MESSAGES}, {HISTORY}, {BUILT} SELECT conv_id, turn, thinking FROM built")
def thinking_mode(spark, sf_dir):
    return requests(spark, sf_dir).select(
        "conv_id", "turn",
        chat.uses_thinking(F.col("enable_thinking"), F.col("adapter_loaded")).alias("thinking"),
    )


@query("build_messages", f"""WITH {MESSAGES}, {HISTORY}, {BUILT}
SELECT conv_id, turn, (n_history + CASE WHEN thinking THEN 4 ELSE 2 END)::BIGINT AS n_messages,
  '<|system|>' || chr(10) || system
    || CASE WHEN thinking THEN {sql_text(fixed.THINKING_SUFFIX)} ELSE {sql_text(fixed.DIRECT_SUFFIX)} END
    || '<|endoftext|>' || chr(10)
    || CASE WHEN thinking THEN '<|user|>' || chr(10) || 'Hello<|endoftext|>' || chr(10) || '<|assistant|>' || chr(10)
         || {sql_text(fixed.ONE_SHOT_ASSISTANT)} || '<|endoftext|>' || chr(10) ELSE '' END
    || rendered || '<|user|>' || chr(10) || message || '<|endoftext|>' || chr(10) AS said
FROM built""")
def build_messages(spark, sf_dir):
    built = ops.build_messages(requests(spark, sf_dir))
    return built.select(
        "conv_id", "turn", F.size("messages").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("messages", lambda t: F.concat(
            F.lit("<|"), t["role"], F.lit("|>\n"), t["content"], F.lit("<|endoftext|>\n"))), "").alias("said"),
    )


@query("render_prompt", f"WITH {MESSAGES}, {HISTORY}, {BUILT} SELECT conv_id, turn, prompt FROM prompts")
def render_prompt(spark, sf_dir):
    return ops.render_prompts(requests(spark, sf_dir)).select("conv_id", "turn", "prompt")


def parameterized(spark, sf_dir):
    top_k = F.when(F.col("conv_id") % 5 == 0, F.lit(0)).otherwise(F.lit(50))
    return ops.render_prompts(requests(spark, sf_dir)).withColumns({
        "temperature": F.lit(0.7), "top_p": F.lit(0.9), "max_new_tokens": F.lit(1024), "top_k": top_k,
        "repetition_penalty": F.lit(1.1), "min_new_tokens": F.lit(0),
    })


@query("inference_requests", f"""WITH {MESSAGES}, {HISTORY}, {BUILT}
SELECT conv_id, turn, prompt, 0.7::DOUBLE AS temperature, 0.9::DOUBLE AS top_p, 1024 AS max_new_tokens,
  CASE WHEN conv_id % 5 > 0 THEN 50 END AS top_k, 1.1::DOUBLE AS repetition_penalty, 0 AS min_new_tokens,
  true AS do_sample FROM prompts""")
def inference_requests(spark, sf_dir):
    return with_parameters(parameterized(spark, sf_dir)).select(
        "conv_id", "turn", "prompt", *fixed.DECODE_PARAMS, "do_sample"
    )


LONG = """
long_messages AS (
  SELECT conv_id % 3 AS conv_id, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, turn) - 1 AS turn,
         role, content FROM messages),
long_spoken AS (
  SELECT conv_id, turn, role, content AS raw,
    CASE WHEN role = 'assistant'
         THEN trim(regexp_replace(content, '(?s)<think>.*?(?:</think>|$)', ''), E' \\t\\n\\r\\f\\v')
         ELSE content END AS content FROM long_messages),
long_kept AS (
  SELECT *, role IN ('user', 'assistant') AND trim(content, E' \\t\\n\\r\\f\\v') <> '' AS keep FROM long_spoken),
long_history AS (
  SELECT conv_id, turn, role, raw AS message,
         string_agg('<|' || role || '|>' || chr(10) || content || '<|endoftext|>' || chr(10), '' ORDER BY turn)
           FILTER (keep) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           AS rendered
  FROM long_kept)
"""


def joined_conversations(spark, sf_dir, joined):
    """Conversations of many turns: those of equal ``joined``, one after the other."""
    rows = messages(spark, sf_dir).withColumn("joined", joined.cast("bigint"))
    chunk = F.col("conv_id") * (1 << 20) + position_chunk("turn")
    return ordered_scan(rows, ["joined"], ["conv_id", "turn"], chunk, running={"place": F.lit(1)}).select(
        F.col("joined").alias("conv_id"), (F.col("place") - 1).cast("bigint").alias("turn"), "role", "content")


def long_prompts(conversations):
    return ops.prompt_digests(conversations, F.lit(fixed.DEFAULT_SYSTEM_PROMPT), F.lit(False)).select(
        "conv_id", "turn", "prompt_md5")


LONG_PROMPTS = f"""
SELECT conv_id, turn, md5('<|system|>' || chr(10) || {sql_text(fixed.DEFAULT_SYSTEM_PROMPT)}
  || {sql_text(fixed.DIRECT_SUFFIX)} || '<|endoftext|>' || chr(10) || coalesce(rendered, '')
  || '<|user|>' || chr(10) || message || '<|endoftext|>' || chr(10) || '<|assistant|>' || chr(10)) AS prompt_md5
FROM long_history WHERE role = 'user'
"""


@query("render_long_prompt", f"WITH {MESSAGES}, {LONG} {LONG_PROMPTS}")
def render_long_prompt(spark, sf_dir):
    """Prompts of every user turn of three conversations that hold all messages."""
    return long_prompts(joined_conversations(spark, sf_dir, F.col("conv_id") % 3))


JOINED = 40
"""Conversations that follow each other in one long conversation; the number of these grows with the table."""

EVERY_LONG = LONG.replace(
    "SELECT conv_id % 3 AS conv_id, row_number() OVER (PARTITION BY conv_id % 3 ORDER",
    f"SELECT conv_id // {JOINED} AS conv_id, row_number() OVER (PARTITION BY conv_id // {JOINED} ORDER")


def by_forties():
    return F.floor(F.col("conv_id") / JOINED)


@query("render_every_long_prompt", f"WITH {MESSAGES}, {EVERY_LONG} {LONG_PROMPTS}")
def render_every_long_prompt(spark, sf_dir):
    """Prompts of every user turn of long conversations whose number grows with the table."""
    return long_prompts(joined_conversations(spark, sf_dir, by_forties()))


@query("history_bounds", f"""WITH {MESSAGES}, {EVERY_LONG}
SELECT conv_id, turn, message, n_history, length(coalesce(rendered, '')) AS history_chars
FROM long_history JOIN (
  SELECT conv_id, turn, count(*) FILTER (keep) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_history FROM long_kept) USING (conv_id, turn)
WHERE role = 'user'""")
def history_bounds(spark, sf_dir):
    return ops.history_bounds(joined_conversations(spark, sf_dir, by_forties()))


@query("asked_histories", f"""WITH {MESSAGES}, {EVERY_LONG}, lasts AS (
  SELECT conv_id, max(turn) AS turn FROM long_kept WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, turn, message, md5(coalesce(rendered, '')) AS history_md5 FROM long_history JOIN lasts USING (conv_id, turn)""")
def asked_histories(spark, sf_dir):
    """The whole history of each long conversation's last request."""
    said = joined_conversations(spark, sf_dir, by_forties())
    lasts = said.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    rows = ops.chat_history(said, asked=lasts)
    whole = F.array_join(F.transform("history", lambda t: chat.rendered_turn(t["role"], t["content"])), "")
    return rows.select("conv_id", "turn", "message", F.md5(whole).alias("history_md5"))


@query("answered_pairs", f"""WITH {MESSAGES}
SELECT conv_id, turn, prompt, shown AS response FROM pairs""")
def answered_pairs(spark, sf_dir):
    return ops.answered_pairs(messages(spark, sf_dir))


@query("new_tokens", f"""WITH {MESSAGES}
SELECT conv_id, turn, response AS generated, length(response)::BIGINT AS n_generated FROM pairs""")
def new_tokens(spark, sf_dir):
    """Outputs that repeat their prompt, as text and as ids (here code points), cut to the new part."""
    pairs = ops.conversation_pairs(messages(spark, sf_dir))
    output = F.concat("prompt", "response")
    ids = F.transform(F.split(output, ""), lambda c: F.ascii(c))
    return pairs.select(
        "conv_id", "turn", chat.generated_part(output, F.col("prompt")).alias("generated"),
        F.size(chat.generated_ids(ids, F.char_length("prompt"))).cast("bigint").alias("n_generated"),
    )


def load_echo():
    """A stand-in generator: repeats the prompt and answers with its length; it fails on very short ones."""

    def generate(batch):
        if (batch["prompt"].str.len() < 40).any():
            raise ValueError("prompt too short")
        return [f"{prompt}{len(prompt)} characters" for prompt in batch["prompt"]]

    return generate


@query("batch_inference", f"""WITH {MESSAGES}, {HISTORY}, {BUILT}
SELECT conv_id, turn, 'assistant' AS role, CASE WHEN length(prompt) < 40
  THEN 'Error during inference: prompt too short' ELSE length(prompt) || ' characters' END AS content FROM prompts""")
def batch_inference(spark, sf_dir):
    prompts = ops.render_prompts(requests(spark, sf_dir)).select("conv_id", "turn", "prompt")
    return ops.batch_inference(prompts, load_echo).select("conv_id", "turn", "role", "content")


@query("batch_inference_unloaded", f"""
SELECT conv_id, turn, {sql_text(fixed.NO_MODEL_REPLY)} AS content FROM conversations WHERE role = 'user'""")
def batch_inference_unloaded(spark, sf_dir):
    prompts = requests(spark, sf_dir).select("conv_id", "turn", F.col("message").alias("prompt"))
    return ops.batch_inference(prompts, None).select("conv_id", "turn", "content")
