"""Catalog and status queries over paths from suppliers and customers and polls from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunelake.operators import catalog as ops
from tunelake.operators import status
from tunelake.plans.inputs import POLLS, polls, table
from tunelake.plans.registry import query

SEARCH = " REPO1 "


def model_paths(spark, sf_dir):
    """Cache folders per supplier: plain, with a longer repository name, without one, and unrelated."""
    key = F.col("s_suppkey")
    base = F.concat(F.lit("models--org"), "s_nationkey")
    folder = (
        F.when(key % 5 == 0, F.concat(base, F.lit("--repo"), key, F.lit("--v2")))
        .when(key % 5 == 1, base)
        .when(key % 5 == 2, F.concat(F.lit("datasets--org--repo"), key))
        .otherwise(F.concat(base, F.lit("--repo"), key))
    )
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("/cache/"), folder).alias("path"))


MODELS = """
models AS (
  SELECT '/cache/models--org' || s_nationkey || '--repo' || s_suppkey || CASE WHEN s_suppkey % 5 = 0 THEN '--v2'
    ELSE '' END AS path, 'org' || s_nationkey || '/repo' || s_suppkey AS model, s_suppkey % 5 = 0 AS truncated
  FROM supplier WHERE s_suppkey % 5 IN (0, 3, 4))
"""


@query("model_catalog", f"WITH {MODELS} SELECT path, model, truncated FROM models")
def model_catalog(spark, sf_dir):
    return ops.model_catalog(model_paths(spark, sf_dir))


def adapter_paths(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("/adapters/org"), "c_nationkey", F.lit("--repo"), F.col("c_custkey") % 4, F.lit("/"),
                 F.lower("c_mktsegment"), F.lit("_"), "c_custkey").alias("path")
    )


@query("adapter_catalog", """
SELECT 'org' || c_nationkey || '/repo' || c_custkey % 4 AS model, lower(c_mktsegment) || '_' || c_custkey AS adapter
FROM customer JOIN nation ON c_nationkey = n_nationkey AND c_custkey % 4 = n_nationkey % 4""")
def adapter_catalog(spark, sf_dir):
    loaded = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("org"), "n_nationkey", F.lit("/repo"), F.col("n_nationkey") % 4).alias("model")
    )
    return ops.adapter_catalog(adapter_paths(spark, sf_dir), loaded)


@query("adapter_selection", """
WITH adapters AS (
  SELECT 'org' || c_nationkey || '/repo' || c_custkey % 4 AS model, lower(c_mktsegment) || '_' || c_custkey AS adapter
  FROM customer JOIN nation ON c_nationkey = n_nationkey AND c_custkey % 4 = n_nationkey % 4),
picks AS (
  SELECT c_custkey, 'org' || c_nationkey || '/repo' || c_nationkey % 4 AS model,
         lower(c_mktsegment) || '_' || c_custkey AS picked FROM customer),
firsts AS (SELECT model, min(adapter) AS first FROM adapters GROUP BY model)
SELECT c_custkey, model, picked, CASE WHEN EXISTS (
    SELECT 1 FROM adapters a WHERE a.model = picks.model AND a.adapter = picked) THEN picked
  ELSE coalesce(first, '') END AS selected FROM picks LEFT JOIN firsts USING (model)""")
def adapter_selection(spark, sf_dir):
    picks = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("org"), "c_nationkey", F.lit("/repo"), F.col("c_nationkey") % 4).alias("model"),
        F.concat(F.lower("c_mktsegment"), F.lit("_"), "c_custkey").alias("picked"),
    )
    return ops.adapter_selection(picks, adapter_catalog(spark, sf_dir))


@query("adapter_names", """
WITH names AS (
  SELECT p_partkey AS key, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN ''
    WHEN 2 THEN replace(p_name, ' ', '-') || chr(10) WHEN 3 THEN replace(p_name, ' ', '/') ELSE p_name END AS name
  FROM part)
SELECT key, name, regexp_full_match(name, '[A-Za-z0-9_-]+') AS valid,
  coalesce(nullif(name, ''), 'adapter') AS training_name, coalesce(nullif(name, ''), 'Legacy Adapter') AS loaded_name
FROM names""")
def adapter_names(spark, sf_dir):
    key, name = F.col("p_partkey"), F.col("p_name")
    made = (
        F.when(key % 5 == 0, F.replace(name, F.lit(" "), F.lit("_")))
        .when(key % 5 == 1, F.lit(""))
        .when(key % 5 == 2, F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit("\n")))
        .when(key % 5 == 3, F.replace(name, F.lit(" "), F.lit("/")))
        .otherwise(name)
    )
    names = table(spark, sf_dir, "part").select(key.alias("key"), made.alias("name"))
    return ops.adapter_names(names, default="adapter")


def models(spark, sf_dir):
    return ops.model_catalog(model_paths(spark, sf_dir)).select("model")


@query("model_search", f"WITH {MODELS} SELECT model FROM models WHERE contains(lower(model), 'repo1')")
def model_search(spark, sf_dir):
    return ops.model_search(models(spark, sf_dir), SEARCH)


@query("can_fetch", f"""WITH {MODELS}
SELECT 'org3/REPO3' AS wanted, NOT bool_or(model = 'org3/REPO3') AS can_fetch FROM models""")
def can_fetch(spark, sf_dir):
    wanted = " org3/REPO3 "
    return ops.can_fetch(models(spark, sf_dir), wanted).select(F.lit(wanted.strip()).alias("wanted"), "can_fetch")


def wanted_models(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("org"), "c_nationkey", F.lit("/repo"), "c_custkey").alias("model")
    )


WANTED = "wanted AS (SELECT c_custkey, 'org' || c_nationkey || '/repo' || c_custkey AS model FROM customer)"


@query("known_models", f"WITH {MODELS}, {WANTED} SELECT * FROM wanted WHERE model IN (SELECT model FROM models)")
def known_models(spark, sf_dir):
    return ops.known_models(wanted_models(spark, sf_dir), models(spark, sf_dir))


@query("unknown_models", f"WITH {MODELS}, {WANTED} SELECT * FROM wanted WHERE model NOT IN (SELECT model FROM models)")
def unknown_models(spark, sf_dir):
    return ops.unknown_models(wanted_models(spark, sf_dir), models(spark, sf_dir))


@query("model_options", f"""WITH {MODELS}
SELECT model, min(rank)::INTEGER AS rank FROM (
  SELECT 'org' || n_nationkey || '/repo' || n_nationkey AS model, 0 AS rank FROM nation
  UNION ALL SELECT model, 1 FROM models) GROUP BY model""")
def model_options(spark, sf_dir):
    current = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("org"), "n_nationkey", F.lit("/repo"), "n_nationkey").alias("model")
    )
    return ops.model_options(current, models(spark, sf_dir))


@query("trainable_params", """
SELECT trainable, frozen, trainable + frozen AS total, round(100 * trainable / (trainable + frozen), 6) AS trainable_percent
FROM (SELECT sum(CASE WHEN p_partkey % 2 = 0 THEN 8 * (p_size * 64 + 256) ELSE 0 END)::BIGINT AS trainable,
             sum(p_size * 64 * 256)::BIGINT AS frozen FROM part)""")
def trainable_params(spark, sf_dir):
    layers = table(spark, sf_dir, "part").select(
        (F.col("p_size") * 64).alias("d_in"), F.lit(256).alias("d_out"), (F.col("p_partkey") % 2 == 0).alias("adapted")
    )
    return ops.trainable_params(layers)


@query("status_transitions", f"""WITH {POLLS},
steps AS (
  SELECT *, lag(status) OVER w AS prev_status, lag(model) OVER w AS prev_model FROM polls WHERE ok
  WINDOW w AS (PARTITION BY host ORDER BY ts, event_id)),
named AS (
  SELECT *, CASE WHEN prev_status IN ('starting', 'downloading', 'loading') THEN
    CASE status WHEN 'ready' THEN 'loaded' WHEN 'error' THEN 'failed' END END AS transition,
    model IS DISTINCT FROM prev_model AS model_changed FROM steps)
SELECT host, event_id, ts, status, model, prev_model, transition, model_changed FROM named
WHERE transition IS NOT NULL OR model_changed""")
def status_transitions(spark, sf_dir):
    rows = status.status_transitions(polls(spark, sf_dir).where("ok"))
    return rows.select("host", "event_id", "ts", "status", "model", "prev_model", "transition", "model_changed")


@query("offline_spells", f"""WITH {POLLS},
numbered AS (
  SELECT *, sum(ok::INTEGER) OVER w AS successes FROM polls WINDOW w AS (PARTITION BY host ORDER BY ts, event_id)),
failed AS (
  SELECT *, row_number() OVER (PARTITION BY host, successes ORDER BY ts, event_id) AS i FROM numbered WHERE NOT ok),
spells AS (
  SELECT host, successes, count(*) AS failures, min(ts) AS first_failure, min(ts) FILTER (i = 2) AS offline_at
  FROM failed GROUP BY host, successes HAVING count(*) >= 2)
SELECT host, failures, first_failure, offline_at, n.ts AS recovered_at
FROM spells LEFT JOIN (SELECT host, ts, successes - 1 AS successes FROM numbered WHERE ok) n USING (host, successes)""")
def offline_spells(spark, sf_dir):
    return status.offline_spells(polls(spark, sf_dir).select("host", "ts", "event_id", "ok"))


@query("load_stage_times", """
WITH steps AS (
  SELECT user_id AS attempt, event_id, ts, [10, 20, 40, 100, 15][event_id % 5 + 1]::DOUBLE AS progress,
         lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events)
SELECT attempt, event_id, progress, date_diff('microseconds', ts, next_ts) AS micros FROM steps WHERE progress <> 15""")
def load_stage_times(spark, sf_dir):
    level = F.element_at(F.array(*[F.lit(v) for v in (10.0, 20.0, 40.0, 100.0, 15.0)]),
                         (F.col("event_id") % 5 + 1).cast("int"))
    progress = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("attempt"), "ts", "event_id", level.alias("progress")
    )
    return status.load_stage_times(progress).select("attempt", "event_id", "progress", "micros")


QUIET_HOURS = 6

DEBOUNCED = f"""
marked AS (
  SELECT user_id AS session, ts, event_id, value,
         coalesce(date_diff('microseconds', lag(ts) OVER w, ts) >= {QUIET_HOURS} * 3600000000, true) AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
bursts AS (
  SELECT *, sum(starts::INTEGER) OVER (PARTITION BY session ORDER BY ts, event_id) AS burst FROM marked),
debounced AS (
  SELECT session, max(ts) AS ts, arg_max(value, ts) AS value FROM bursts GROUP BY session, burst)
"""


def changes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", "event_id", "value")


@query("debounce_params", f"WITH {DEBOUNCED} SELECT * FROM debounced")
def debounce_params(spark, sf_dir):
    return status.debounce(changes(spark, sf_dir), quiet_millis=QUIET_HOURS * 3_600_000)


@query("pending_intents", """
WITH intents AS (
  SELECT user_id AS session, event_id, ts, 'm' || event_id % 2 AS model, 'a' || event_id AS adapter,
         'm' || event_id // 7 % 3 AS current_model FROM events WHERE event_type = 'signup'),
results AS (
  SELECT user_id AS session, event_id, ts, CASE event_type WHEN 'view' THEN 'ready' ELSE 'error' END AS outcome,
         'm' || event_id % 3 AS model FROM events
  WHERE event_type = 'view' OR (event_type = 'purchase' AND event_id % 4 = 0)),
firsts AS (
  SELECT i.session, i.event_id, min(r.ts) AS hit, arg_min(r.outcome, r.ts) AS outcome FROM intents i JOIN results r
    ON r.session = i.session AND r.ts > i.ts AND (r.outcome = 'error' OR r.model = i.model) GROUP BY ALL),
nexts AS (
  SELECT i.session, i.event_id, min(n.ts) AS hit FROM intents i JOIN intents n
    ON n.session = i.session AND n.ts > i.ts AND n.model <> n.current_model GROUP BY ALL),
resolved AS (
  SELECT i.*, CASE WHEN i.model = i.current_model THEN 'applied'
    WHEN n.hit IS NOT NULL AND (f.hit IS NULL OR n.hit < f.hit) THEN 'replaced' WHEN f.hit IS NULL THEN 'waiting'
    WHEN f.outcome = 'ready' THEN 'applied' ELSE 'dropped' END AS outcome, f.hit
  FROM intents i LEFT JOIN firsts f USING (session, event_id) LEFT JOIN nexts n USING (session, event_id))
SELECT session, event_id, ts, model, adapter, outcome,
  CASE WHEN model = current_model THEN ts WHEN outcome IN ('applied', 'dropped') THEN hit END AS resolved_at
FROM resolved""")
def pending_intents(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session")

    def model(number):
        return F.concat(F.lit("m"), number)

    intents = events.where("event_type = 'signup'").select(
        "session", "ts", "event_id", model(F.col("event_id") % 2).alias("model"),
        F.concat(F.lit("a"), "event_id").alias("adapter"),
        model(F.expr("event_id div 7 % 3")).alias("current_model"),
    )
    results = events.where("event_type = 'view' OR (event_type = 'purchase' AND event_id % 4 = 0)").select(
        "session", "ts", "event_id",
        F.when(F.col("event_type") == "view", F.lit("ready")).otherwise(F.lit("error")).alias("outcome"),
        model(F.col("event_id") % 3).alias("model"),
    )
    return status.pending_intents(intents, results)
