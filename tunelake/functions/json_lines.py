"""Strict parsing and validation of JSON Lines, one parse per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.functions.text import strip

FIELDS = ("prompt", "response", "score", "source")


def with_parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds the struct ``parsed`` describing each line; malformed lines are described, never raised.

    ``parsed.state`` is ``blank``, ``bad_json``, ``not_object`` or ``object``. The steps are separate
    projections so that Spark evaluates the parse and each field once, and ``inline`` keeps later
    filters from repeating them below.
    """
    text = lines.withColumn("_text", strip(F.coalesce(F.col(column), F.lit(""))))
    state = (
        F.when(F.col("_text") == "", F.lit("blank"))
        .when(~F.col("_one"), F.lit("bad_json"))
        .when(~F.col("_text").startswith("{"), F.lit("not_object"))
        .otherwise(F.lit("object"))
    )
    checked = with_json(text, "_text").withColumn("_state", state)
    fields = checked.withColumns({
        f"_{name}": F.when(F.col("_state") == "object", F.try_variant_get("_json", f"$[0].{name}", "variant"))
        for name in FIELDS
    })
    kinds = fields.withColumns({f"_{name}_kind": F.schema_of_variant(f"_{name}") for name in FIELDS})
    strings = kinds.withColumns({
        f"_{name}_text": F.when(F.col(f"_{name}_kind") == "STRING", F.try_variant_get(f"_{name}", "$", "string"))
        for name in ("prompt", "response", "source")
    })
    parsed = F.struct(
        F.col("_state").alias("state"),
        F.col("_text").alias("text"),
        # The kind is VOID for an explicit null and NULL for an absent key.
        F.col("_prompt_kind").alias("prompt_kind"),
        F.col("_response_kind").alias("response_kind"),
        F.col("_prompt_text").alias("prompt"),
        F.col("_response_text").alias("response"),
        _truthy("prompt").alias("prompt_truthy"),
        _truthy("response").alias("response_truthy"),
        F.col("_score_kind").isNotNull().alias("has_score"),
        number("_score", "_score_kind").alias("score"),
        F.col("_source_kind").isNotNull().alias("has_source"),
        F.col("_source_text").alias("source"),
    )
    return strings.select(*lines.columns, F.inline(F.array(F.struct(parsed.alias("parsed")))))


def with_json(lines: DataFrame, column: str) -> DataFrame:
    """Adds ``_json``, a VARIANT array whose first element is the text's JSON value, and ``_one``, whether
    the text is exactly one JSON value.

    The text is parsed together with its own hash: anything after its first value moves the hash out of
    second place.
    """
    text = F.col(column)
    hashed = lines.withColumn("_hash", F.xxhash64(text))
    wrapped = F.concat(F.lit("["), text, F.lit(","), F.col("_hash").cast("string"), F.lit("]"))
    parsed = hashed.withColumn("_json", F.try_parse_json(wrapped))
    in_second_place = F.try_variant_get("_json", "$[1]", "bigint") == F.col("_hash")
    nothing_after = F.try_variant_get("_json", "$[2]", "variant").isNull()
    return parsed.withColumn("_one", F.coalesce(in_second_place & nothing_after, F.lit(False)))


def number(value: str, kind: str) -> Column:
    """A JSON number as a double; NULL for any other type, numeric text and booleans included."""
    return F.when(~F.col(kind).isin("STRING", "BOOLEAN"), F.try_variant_get(value, "$", "double"))


def _truthy(name: str) -> Column:
    """Whether a field counts as present: not null, false, zero or the empty string."""
    kind, value = F.col(f"_{name}_kind"), f"_{name}"
    return (
        F.when(kind == "STRING", F.col(f"_{name}_text") != "")
        .when(kind.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .otherwise(F.coalesce(F.try_variant_get(value, "$", "double") != 0, F.lit(True)))
    )


def is_object() -> Column:
    return F.col("parsed.state") == "object"


def preview_valid() -> Column:
    """Preview rule: both fields are truthy, whatever their type."""
    return is_object() & F.col("parsed.prompt_truthy") & F.col("parsed.response_truthy")


def upload_status() -> Column:
    """Upload rule: both keys are present, null and empty included. Other lines get their reason.

    A prompt or response of another type than text is set aside too: nothing downstream can use it.
    """
    kinds = [F.col("parsed.prompt_kind"), F.col("parsed.response_kind")]
    absent = kinds[0].isNull() | kinds[1].isNull()
    other = ~kinds[0].isin("STRING", "VOID") | ~kinds[1].isin("STRING", "VOID")
    return (
        F.when(~is_object(), F.col("parsed.state"))
        .when(absent, F.lit("missing_key"))
        .when(other, F.lit("not_string"))
        .otherwise(F.lit("accepted"))
    )


def upload_score() -> Column:
    """The default applies only where the key is absent; an explicit null stays null."""
    return F.when(is_object() & ~F.col("parsed.has_score"), F.lit(fixed.UPLOAD_SCORE)).otherwise(
        F.col("parsed.score")
    )


def upload_source() -> Column:
    return F.when(is_object() & ~F.col("parsed.has_source"), F.lit(fixed.UPLOAD_SOURCE)).otherwise(
        F.col("parsed.source")
    )


def score_issue() -> Column:
    return F.when(F.col("parsed.has_score") & F.col("parsed.score").isNull(), F.lit("score_not_numeric"))


def upload_line() -> Column:
    """The accepted line as one JSON line with the absent defaults added; other keys and text untouched."""
    body = F.substring(F.col("parsed.text"), F.lit(1), F.char_length("parsed.text") - 1)
    score = F.when(~F.col("parsed.has_score"), F.lit(f', "score": {fixed.UPLOAD_SCORE:.0f}'))
    source = F.when(~F.col("parsed.has_source"), F.lit(f', "source": "{fixed.UPLOAD_SOURCE}"'))
    return F.concat(body, F.coalesce(score, F.lit("")), F.coalesce(source, F.lit("")), F.lit("}"))


def good_score(score: Column, threshold: float = fixed.USABLE_SCORE) -> Column:
    """Filter form: a plain comparison reaches the Parquet scan. NaN, which Spark sorts last, is no score."""
    return (score >= threshold) & ~F.isnan(score)


def usable(score: Column, threshold: float = fixed.USABLE_SCORE) -> Column:
    """Column form: a missing score is not usable."""
    return F.coalesce(good_score(score, threshold), F.lit(False))


def example_id(batch: Column, seq: Column, prompt: Column, response: Column) -> Column:
    """A stable id. Every part is written with its length, and a missing one differs from an empty one."""
    parts = [part.cast("string") for part in (batch, seq, prompt, response)]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.char_length(part).cast("string"), F.lit(":"), part), F.lit("-")) for part in parts
    ]), 256)
