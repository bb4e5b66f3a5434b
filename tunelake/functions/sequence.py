"""Token arrays: splitting, truncation, padding and label masks, all on built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed

# Role marks and the end mark are tokens of their own; other tokens are runs without white space.
TOKEN_PATTERN = r"<\|[a-z]+\|>|[^ \t\n\r\f<]+|<"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def repeat(value: int, times: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(times, F.lit(0)).cast("int"))


def kept_length(n_tokens: Column, length: int) -> Column:
    return F.least(n_tokens, F.lit(length))


def input_ids(ids: Column, pad: int, length: int = fixed.MAX_LENGTH) -> Column:
    """Cut to ``length``, then padded on the right."""
    return F.concat(F.slice(ids, 1, length), repeat(pad, F.lit(length) - F.size(ids)))


def attention_mask(n_tokens: Column, length: int = fixed.MAX_LENGTH) -> Column:
    return F.concat(repeat(1, kept_length(n_tokens, length)), repeat(0, F.lit(length) - n_tokens))


def labels(ids: Column, n_prompt: Column, length: int = fixed.MAX_LENGTH) -> Column:
    """Loss only on the response. Masking goes by position: the real end token stays a target even
    though padding uses the same id."""
    kept = kept_length(F.size(ids), length)
    masked = F.least(n_prompt, kept)
    ignored = fixed.IGNORED_LABEL
    return F.concat(
        repeat(ignored, masked),
        F.slice(ids, masked + 1, kept - masked),
        repeat(ignored, F.lit(length) - kept),
    )
