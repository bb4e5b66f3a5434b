"""The operators' inputs, derived row by row from the shared tables.

Each DataFrame here has a SQL twin (upper case, a list of common table expressions) used by the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.operators.curation import accepted, ingest_examples

BATCH_ID = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_sql(*parts: str) -> str:
    """The SQL twin of ``example_id``."""
    return "sha256(" + " || ".join(
        f"coalesce(length({part}::VARCHAR)::VARCHAR || ':' || {part}::VARCHAR, '-')" for part in parts) + ")"


def as_source(derived: DataFrame) -> DataFrame:
    """Makes derived columns behave like stored ones: computed once, not again in every expression above."""
    return derived.select(F.inline(F.array(F.struct(*derived.columns))))


def example_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per document: every way a line can be awkward, and good lines of all scores."""
    prompt = F.concat_ws(
        " ", F.lit("Write a"), F.col("lang"), F.lit("text for"), F.col("source"), F.lit("number"), F.col("doc_id")
    )
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("text").alias("r"), prompt.alias("p"),
        (F.col("doc_id") % 37).alias("k"), "doc_id",
    )
    docs = docs.withColumn("both", F.to_json(F.struct(F.col("p").alias("prompt"), F.col("r").alias("response"))))
    both = F.col("both")
    opened = F.substring(both, F.lit(1), F.char_length(both) - 1)
    response = F.expr("substring(to_json(named_struct('response', r)), 2)")
    score = (F.col("doc_id") % 11).cast("string")

    def extra(text: str):
        return F.concat(opened, F.lit(text + "}"))

    line = (
        F.when(F.col("k") == 0, both)
        .when(F.col("k") == 1, F.concat(F.lit('{"prompt":null,'), response))
        .when(F.col("k") == 2, F.concat(F.lit('{"score":9,"prompt":"",'), response))
        .when(F.col("k") == 3, F.to_json(F.array("p", "r")))
        .when(F.col("k") == 4, F.col("doc_id").cast("string"))
        .when(F.col("k") == 5, F.lit('"prompt response"'))
        .when(F.col("k") == 6, F.lit('"hello"'))
        .when(F.col("k") == 7, F.lit("null"))
        .when(F.col("k") == 8, F.concat(F.lit("not json "), F.col("p")))
        .when(F.col("k") == 9, F.concat(F.lit("{'prompt':'"), F.col("p"), F.lit("','response':'b'}")))
        .when(F.col("k") == 10, F.concat(both, F.lit("] junk {}")))
        .when(F.col("k") == 11, extra(',"score":"9"'))
        .when(F.col("k") == 12, extra(',"score":null'))
        .when(F.col("k") == 13, extra(',"score":7.0'))
        .when(F.col("k") == 14, extra(',"score":6.99'))
        .when(F.col("k") == 15, extra(',"score":true'))
        .when(F.col("k") == 16, F.concat(F.lit('{"prompt":"a",'), F.substring(both, F.lit(2), F.char_length(both))))
        .when(F.col("k") == 17, extra(',"score":NaN'))
        .when(F.col("k") == 18, F.concat(F.lit('{"score":9,"prompt":5,'), response))
        .when(F.col("k") == 19, F.lit(" \t "))
        .when(F.col("k") == 20, F.concat(F.lit('{"score":8,'), response))
        .when(F.col("k") <= 25, F.concat(F.lit("  "), opened, F.lit(',"source":"human_feedback","score":'), score,
                                         F.lit("}\t")))
        .when(F.col("k") <= 27, F.concat(opened, F.lit(',"tags":["x"],"source":"crawl","score":'), score, F.lit("}")))
        .when(F.col("k") == 28, F.concat(opened, F.lit(',"source":null,"score":'), score, F.lit("}")))
        .otherwise(F.concat(opened, F.lit(',"score":'), score, F.lit("}")))
    )
    return as_source(docs.select(line.alias("value"), "seq"))


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_examples(example_lines(spark, sf_dir), BATCH_ID)


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(ingested(spark, sf_dir))


LINES = f"""
lines AS (
  SELECT doc_id AS seq, text AS r, doc_id % 37 AS k, doc_id,
         'Write a ' || lang || ' text for ' || source || ' number ' || doc_id AS p
  FROM documents),
ingested AS (
  SELECT seq, k,
    CASE WHEN k IN (3, 4, 5, 6, 7) THEN 'not_object' WHEN k IN (8, 9, 10, 17) THEN 'bad_json'
         WHEN k = 18 THEN 'not_string' WHEN k = 19 THEN 'blank' WHEN k = 20 THEN 'missing_key'
         ELSE 'accepted' END AS status,
    CASE WHEN k IN (3, 4, 5, 6, 7, 8, 9, 10, 17, 19, 1, 18, 20) THEN NULL WHEN k = 2 THEN '' ELSE p END AS prompt,
    CASE WHEN k IN (3, 4, 5, 6, 7, 8, 9, 10, 17, 19) THEN NULL ELSE r END AS response,
    CASE WHEN k IN (11, 12, 15) THEN NULL WHEN k = 13 THEN 7.0 WHEN k = 14 THEN 6.99 WHEN k IN (2, 18) THEN 9.0
         WHEN k = 20 THEN 8.0 WHEN k > 20 THEN doc_id % 11 ELSE 10.0 END::DOUBLE AS score,
    CASE WHEN k BETWEEN 21 AND 25 THEN 'human_feedback' WHEN k IN (26, 27) THEN 'crawl' WHEN k = 28 THEN NULL
         ELSE 'manual_upload' END AS source,
    CASE WHEN k IN (11, 12, 15) THEN 'score_not_numeric' END AS issue
  FROM lines),
examples AS (
  SELECT {id_sql("1", "seq", "prompt", "response")} AS example_id, 1::BIGINT AS batch_id,
         seq, prompt, response, score, source, issue
  FROM ingested WHERE status = 'accepted'),
listed AS (
  SELECT * REPLACE (coalesce(score, 0) AS score, coalesce(source, '') AS source), coalesce(score >= 7, false) AS usable
  FROM examples WHERE prompt <> '' AND response <> '')
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns; replies carry think blocks that are closed, left open or absent."""
    text, turn = F.col("text"), F.col("turn")
    reply = (
        F.when(turn % 3 == 0, F.concat(F.lit("<think>plan "), turn, F.lit("</think> "), text,
                                       F.lit(" <think>late</think>")))
        .when(turn % 3 == 1, F.concat(text, F.lit(" <think>open "), turn))
        .otherwise(text)
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.when(F.col("role") == "assistant", reply).otherwise(text).alias("content")
    )


MESSAGES = """
messages AS (
  SELECT conv_id, turn, role,
    CASE WHEN role = 'assistant' AND turn % 3 = 0
           THEN '<think>plan ' || turn || '</think> ' || text || ' <think>late</think>'
         WHEN role = 'assistant' AND turn % 3 = 1 THEN text || ' <think>open ' || turn
         ELSE text END AS content
  FROM conversations),
split AS (
  SELECT *,
    trim(regexp_extract(content, '(?s)<think>(.*?)(?:</think>|$)', 1), E' \\t\\n\\r\\f\\v') AS thought,
    trim(regexp_replace(content, '(?s)<think>.*?(?:</think>|$)', ''), E' \\t\\n\\r\\f\\v') AS answer
  FROM messages),
spoken AS (
  SELECT conv_id, turn, role, content AS raw, CASE WHEN role = 'assistant' THEN answer ELSE content END AS content
  FROM split),
kept AS (
  SELECT *, role IN ('user', 'assistant') AND trim(content, E' \\t\\n\\r\\f\\v') <> '' AS keep FROM spoken),
pairs AS (
  SELECT conv_id, turn, prompt, response, trim(regexp_replace(response, '(?s)<think>.*?(?:</think>|$)', ''),
    E' \\t\\n\\r\\f\\v') AS shown FROM (
    SELECT conv_id, turn, role, content AS response, lag(content) OVER w AS prompt, lag(role) OVER w AS prompt_role
    FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'assistant' AND prompt_role = 'user')
"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of replies, many of them sent again, some without a prompt."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", "user_id", "event_type").alias("message_id"),
        (F.col("event_id") % 10 + 1).cast("int").alias("score"),
        F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Tell me about "), "event_type"))
        .alias("prompt"),
        F.col("props").alias("response"),
        F.col("ts"),
    )


RATINGS = """
ratings AS (
  SELECT user_id || '-' || event_type AS message_id, (event_id % 10 + 1)::INTEGER AS score,
         CASE WHEN event_id % 7 = 0 THEN '' ELSE 'Tell me about ' || event_type END AS prompt,
         props AS response, ts
  FROM events)
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training output of one run per user: metrics, statuses, errors and lines that cannot be read."""
    kind, value = F.col("event_id") % 9, F.col("value")
    epoch = (F.col("event_id") % 350) / 100
    metrics = F.to_json(F.struct((value / 100).alias("loss"), F.lit(0.0002).alias("learning_rate"),
                                 epoch.alias("epoch")))
    line = (
        F.when(kind == 0, F.lit("Loading Model on cpu..."))
        .when(kind == 1, F.lit("  Tokenizing dataset...\t"))
        .when(kind == 6, F.concat(F.lit("JSON_LOG:"), F.to_json(F.struct(epoch.alias("epoch")))))
        .when(kind == 7, F.lit("JSON_LOG:{broken"))
        .when(kind == 8, F.concat(F.lit("Error: shard "), F.col("user_id"), F.lit(" not found.")))
        .otherwise(F.concat(F.lit("JSON_LOG:"), metrics))
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), "user_id").alias("run_id"), F.col("event_id").alias("seq"), line.alias("line")
    ).transform(as_source)


def run_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of the runs that have ended; every third run is still going."""
    code = F.col("user_id") % 3
    return (
        table(spark, sf_dir, "events").where(code < 2)
        .groupBy("user_id").agg(F.count("*").alias("n"))
        .select(F.concat(F.lit("run-"), "user_id").alias("run_id"), (code * 7).cast("int").alias("exit_code"))
    )


LOGS = """
logs AS (
  SELECT 'run-' || user_id AS run_id, event_id AS seq, event_id % 9 AS k, user_id,
         CASE WHEN event_id % 9 BETWEEN 2 AND 5 THEN value / 100 END AS loss,
         CASE WHEN event_id % 9 BETWEEN 2 AND 6 THEN (event_id % 350) / 100.0 END::DOUBLE AS epoch
  FROM events),
parsed AS (
  SELECT run_id, seq, loss, epoch,
         CASE WHEN k BETWEEN 2 AND 6 THEN 'metrics' WHEN k IN (0, 1) THEN 'status' WHEN k = 8 THEN 'error'
              ELSE 'other' END AS kind,
         CASE WHEN k = 0 THEN 'Loading Model...' WHEN k = 1 THEN 'Tokenizing...'
              WHEN k BETWEEN 2 AND 5 THEN 'Training...' END AS status,
         CASE WHEN k = 8 THEN 'Error: shard ' || user_id || ' not found.' END AS error
  FROM logs),
folded AS (
  SELECT run_id, arg_max(loss, seq) FILTER (loss IS NOT NULL) AS loss,
         arg_max(epoch, seq) FILTER (epoch IS NOT NULL) AS epoch,
         arg_max(status, seq) FILTER (status IS NOT NULL) AS status,
         arg_max(error, seq) FILTER (error IS NOT NULL) AS error,
         count(loss) AS n_losses
  FROM parsed GROUP BY run_id),
metrics AS (
  SELECT run_id, round(coalesce(loss, 0), 6) AS loss, coalesce(epoch, 0) AS step,
         round(coalesce(pow(2.718, loss), 0), 6) AS perplexity, coalesce(status, 'Starting...') AS status,
         round(least(100, 100 * coalesce(epoch, 0) / 3), 6) AS progress, 3 AS total_epochs,
         coalesce(error, '') AS error, n_losses
  FROM folded)
"""


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status polls, one host per user; an ``error`` event is a poll that got no answer."""
    status = (
        F.when(F.col("event_type") == "signup", F.lit("starting"))
        .when(F.col("event_type") == "click", F.lit("loading"))
        .when(F.col("event_type") == "view", F.lit("ready"))
        .when(F.col("event_type") == "purchase", F.lit("error"))
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("host-"), "user_id").alias("host"), "ts", "event_id",
        (F.col("event_type") != "error").alias("ok"), status.alias("status"),
        F.concat(F.lit("org/model-"), (F.col("user_id") + F.col("event_id")) % 3).alias("model"),
    )


POLLS = """
polls AS (
  SELECT 'host-' || user_id AS host, ts, event_id, event_type <> 'error' AS ok,
         CASE event_type WHEN 'signup' THEN 'starting' WHEN 'click' THEN 'loading' WHEN 'view' THEN 'ready'
                         WHEN 'purchase' THEN 'error' END AS status,
         'org/model-' || ((user_id + event_id) % 3) AS model
  FROM events)
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates, one request per user, some of them masked (minus infinity), with top-k on for most requests
    and off for some."""
    masked = (F.col("value") <= 0) | (F.col("event_id") % 11 == 0)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("candidate"),
        F.when(masked, F.lit(float("-inf"))).otherwise(F.log("value")).alias("logit"),
        (F.col("event_type") == "view").alias("used"),
        (F.col("event_type") == "signup").alias("is_end"),
        (F.col("user_id") % 4).alias("n_generated"),
        F.lit(0.7).alias("temperature"), F.lit(0.9).alias("top_p"),
        F.when(F.col("user_id") % 5 == 0, F.lit(0)).when(F.col("user_id") % 5 == 1, F.lit(5000))
        .otherwise(F.lit(20)).alias("top_k"),
        F.lit(1.1).alias("repetition_penalty"), F.lit(2).alias("min_new_tokens"),
    )


POLICY = """
scores AS (
  SELECT user_id AS request_id, event_id AS candidate,
         CASE WHEN event_type = 'view' THEN CASE WHEN ln(value) > 0 THEN ln(value) / 1.1::DOUBLE
              ELSE ln(value) * 1.1::DOUBLE END ELSE ln(value) END / 0.7::DOUBLE AS score,
         CASE user_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 5000 ELSE 20 END AS top_k
  FROM events WHERE value > 0 AND event_id % 11 <> 0 AND NOT (event_type = 'signup' AND user_id % 4 < 2)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, candidate) AS rank FROM scores),
weighed AS (
  SELECT *, exp(score - max(score) OVER (PARTITION BY request_id)) AS weight
  FROM ranked WHERE top_k = 0 OR rank <= top_k),
massed AS (
  SELECT *, sum(weight) OVER (PARTITION BY request_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto,
         sum(weight) OVER (PARTITION BY request_id) AS total
  FROM weighed),
nucleus AS (
  SELECT *, sum(weight) OVER (PARTITION BY request_id) AS kept
  FROM massed WHERE round((upto - weight) / total, 9) < 0.9),
policy AS (
  SELECT request_id, candidate, rank, weight / kept AS probability, upto / kept AS cumulative FROM nucleus)
"""
