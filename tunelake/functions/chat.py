"""Building the message list of a request and rendering it to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunelake import fixed_values as fixed
from tunelake.functions.text import blank_to_null, strip

TURN = "struct<role:string,content:string>"


def system_prompt(requested: Column) -> Column:
    """The requested prompt trimmed, or the default where it is blank."""
    return F.coalesce(blank_to_null(requested), F.lit(fixed.DEFAULT_SYSTEM_PROMPT))


def system_prompt_after_load(current: Column, sent: Column) -> Column:
    """Loading an adapter replaces the prompt only when it sends one, and takes it as it is."""
    return F.coalesce(F.nullif(sent, F.lit("")), current)


def uses_thinking(enable_thinking: Column, adapter_loaded: Column) -> Column:
    return enable_thinking & ~adapter_loaded


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def kept_turn(role: Column, content: Column) -> Column:
    """History keeps the turns of both speakers unless they are blank."""
    return F.coalesce(role.isin("user", "assistant") & (strip(content) != ""), F.lit(False))


def message_list(system: Column, thinking: Column, history: Column, message: Column) -> Column:
    """System text with its instruction, two example turns when thinking, kept history, the message."""
    suffix = F.when(thinking, F.lit(fixed.THINKING_SUFFIX)).otherwise(F.lit(fixed.DIRECT_SUFFIX))
    example = F.when(
        thinking,
        F.array(turn("user", F.lit(fixed.ONE_SHOT_USER)), turn("assistant", F.lit(fixed.ONE_SHOT_ASSISTANT))),
    ).otherwise(F.array().cast(f"array<{TURN}>"))
    kept = F.filter(history, lambda t: kept_turn(t["role"], t["content"]))
    return F.concat(
        F.array(turn("system", F.concat(system, suffix))), example, kept, F.array(turn("user", message))
    )


def rendered_turn(role: Column, content: Column) -> Column:
    """A turn under its role mark."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), content, F.lit(fixed.END_TOKEN + "\n"))


def rendered_head(system: Column, thinking: Column) -> Column:
    """What a rendered prompt holds before its history."""
    none = F.array().cast(f"array<{TURN}>")
    # The message list without history ends with the message, an empty one here.
    return F.array_join(F.transform(
        F.slice(message_list(system, thinking, none, F.lit("")), F.lit(1), F.when(thinking, 3).otherwise(1)),
        lambda t: rendered_turn(t["role"], t["content"])), "")


def render(messages: Column) -> Column:
    """A message list as text: each turn under its role mark, then the mark of the reply to come."""
    turns = F.transform(messages, lambda t: rendered_turn(t["role"], t["content"]))
    return F.concat(F.array_join(turns, ""), F.lit(fixed.ASSISTANT_MARK))


def rendered_request(template: Column, messages: Column, message: Column) -> Column:
    """Text given to the generator. Without a template only the message itself is used."""
    return F.when(template, render(messages)).otherwise(message)


def training_prefix(prompt: Column) -> Column:
    """What stands before the response in training text; no system prompt and no history."""
    return F.concat(
        F.lit(fixed.USER_MARK), prompt, F.lit(fixed.END_TOKEN + "\n"), F.lit(fixed.ASSISTANT_MARK)
    )


def training_text(prompt: Column, response: Column) -> Column:
    return F.concat(training_prefix(prompt), response, F.lit(fixed.END_TOKEN))


def generated_part(output: Column, prompt: Column) -> Column:
    """The part of a generator's output that follows its prompt."""
    return F.substring(output, F.char_length(prompt) + 1, F.char_length(output))


def generated_ids(output_ids: Column, n_prompt: Column) -> Column:
    return F.slice(output_ids, n_prompt + 1, F.greatest(F.size(output_ids) - n_prompt, F.lit(0)))
