"""Text expressions: trimming, think blocks, reply errors, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed


def strip(text: Column) -> Column:
    """Removes white space (Unicode included) from both ends.

    Text without any at its ends, the usual case, is passed on without the character-wise trim.
    """
    spaces = F.lit(fixed.WHITESPACE)
    padded = F.contains(spaces, F.left(text, F.lit(1))) | F.contains(spaces, F.right(text, F.lit(1)))
    return F.when(padded, F.btrim(text, spaces)).otherwise(text)


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def thought(content: Column) -> Column:
    """The first think block of a reply, trimmed; a block left open runs to the end of the text."""
    start, end = _think_bounds(content)
    body_start = start + len(fixed.THINK_OPEN)
    body = F.when(end > 0, F.substring(content, body_start, end - body_start)).otherwise(
        F.substring(content, body_start, F.char_length(content))
    )
    return strip(F.when(start > 0, body).otherwise(F.lit("")))


def answer(content: Column) -> Column:
    """The reply without its first think block, trimmed. Later blocks stay."""
    start, end = _think_bounds(content)
    before = F.substring(content, F.lit(1), start - 1)
    after = F.when(
        end > 0, F.substring(content, end + len(fixed.THINK_CLOSE), F.char_length(content))
    ).otherwise(F.lit(""))
    return strip(F.when(start > 0, F.concat(before, after)).otherwise(content))


def _think_bounds(content: Column) -> tuple[Column, Column]:
    start = F.position(F.lit(fixed.THINK_OPEN), content)
    end = F.position(F.lit(fixed.THINK_CLOSE), content, start + len(fixed.THINK_OPEN))
    return start, end


def is_error_reply(content: Column) -> Column:
    return content.startswith(fixed.INFERENCE_ERROR_PREFIX) | content.startswith(fixed.NO_MODEL_PREFIX)


def without_system_prefix(content: Column) -> Column:
    return F.when(
        content.startswith(fixed.SYSTEM_PREFIX),
        F.substring(content, F.lit(len(fixed.SYSTEM_PREFIX) + 1), F.char_length(content)),
    ).otherwise(content)


def matches_search(query: Column, *fields: Column) -> Column:
    """True when the trimmed query is a substring of any field, ignoring case; an empty query matches all."""
    needle = F.lower(strip(query))
    found = F.lit(False)
    for field in fields:
        found = found | F.coalesce(F.contains(F.lower(field), needle), F.lit(False))
    return (needle == "") | found


def source_label(source: Column) -> Column:
    label = F.when(F.coalesce(source, F.lit("")) == "", F.lit(fixed.UNKNOWN_SOURCE))
    for code, text in fixed.SOURCE_LABELS.items():
        label = label.when(source == code, F.lit(text))
    return label.otherwise(source)


def valid_adapter_name(name: Column) -> Column:
    return F.coalesce(name.rlike(fixed.ADAPTER_NAME_PATTERN), F.lit(False))


def model_folder(model: Column) -> Column:
    """``org/repo`` as one folder name."""
    return F.replace(model, F.lit("/"), F.lit("--"))


def cached_model(folder: Column) -> Column:
    """``models--org--repo`` back to ``org/repo``; NULL for any other folder."""
    parts = F.split(folder, "--")
    return F.when(
        folder.startswith("models--") & (F.size(parts) >= 3),
        F.concat_ws("/", F.get(parts, 1), F.get(parts, 2)),
    )


def cached_model_truncated(folder: Column) -> Column:
    """A repository name holding ``--`` loses what follows it."""
    return F.size(F.split(folder, "--")) > 3
