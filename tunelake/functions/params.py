"""Decode parameters: defaults, partial updates, bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed

INTEGER_PARAMS = ("max_new_tokens", "top_k", "min_new_tokens")


def overlay(name: str, new: Column, current: Column | None = None) -> Column:
    """A parameter after an update that may leave it out."""
    default = F.lit(fixed.DECODE_PARAMS[name][0])
    return F.coalesce(new, current, default) if current is not None else F.coalesce(new, default)


def bounded(name: str, value: Column) -> Column:
    """The value inside the parameter's bounds."""
    _, low, high = fixed.DECODE_PARAMS[name]
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def parsed_integer(name: str, text: Column) -> Column:
    """A typed number: leading digits count, anything unreadable or zero becomes the lowest value."""
    digits = F.regexp_extract(text, r"\A\s*([+-]?\d{1,9})", 1)
    number = F.nullif(F.nullif(digits, F.lit("")).cast("int"), F.lit(0))
    return bounded(name, F.coalesce(number, F.lit(fixed.DECODE_PARAMS[name][1])))


def sent_top_k(top_k: Column) -> Column:
    """Top-k goes to the generator only when it is on."""
    return F.when(top_k > 0, top_k)
