"""What a model server's JSON response says: tokens, timings, text, reasoning, tool calls. Anything missing is 0, empty or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_reasoning


def at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def number(v: Column, path: str) -> Column:
    """A number that isn't negative; 0 for anything else."""
    return F.greatest(F.lit(0.0), F.coalesce(at(v, path, "double"), F.lit(0.0)))


def tokens(v: Column, path: str) -> Column:
    return F.floor(number(v, path)).cast("long")


def completion_tokens(v: Column) -> Column:
    return tokens(v, "$.usage.completion_tokens")


def call_timings(v: Column) -> Column:
    """Prompt and cached tokens, prefill and generation seconds and their source; null if the response tells nothing.

    A server's own timings go first, then durations in its usage block, then bare token counts.
    """
    row = lambda p, c, a, b, s: F.struct(p.alias("prompt_tokens"), c.alias("cached_prompt_tokens"), a.alias("prefill_seconds"), b.alias("generation_seconds"), F.lit(s).alias("source"))
    own_prompt, own_cache = tokens(v, "$.timings.prompt_n"), tokens(v, "$.timings.cache_n")
    own = row(own_prompt, own_cache, number(v, "$.timings.prompt_ms") / 1000, number(v, "$.timings.predicted_ms") / 1000, "llamacpp")
    has_own = (own_prompt > 0) | (own_cache > 0) | at(v, "$.timings.prompt_ms", "double").isNotNull()
    cached, total = tokens(v, "$.usage.prompt_tokens_details.cached_tokens"), tokens(v, "$.usage.prompt_tokens")
    fresh = F.greatest(F.lit(0), total - cached)
    timed = at(v, "$.usage.prompt_eval_duration", "double").isNotNull() | at(v, "$.usage.generation_duration", "double").isNotNull()
    durations = row(fresh, cached, number(v, "$.usage.prompt_eval_duration"), number(v, "$.usage.generation_duration"), "omlx")
    counts = row(fresh, cached, F.lit(0.0), F.lit(0.0), "usage")
    return F.when(has_own, own).when(timed, durations).when((total > 0) | (cached > 0), counts)


def hit_length_cap(v: Column) -> Column:
    return F.coalesce(at(v, "$.choices[0].finish_reason", "string") == "length", F.lit(False))


def message_text(v: Column) -> Column:
    """The first choice's answer, or its reasoning where there is no answer, without inline reasoning."""
    content = F.coalesce(at(v, "$.choices[0].message.content", "string"), F.lit(""))
    thought = F.coalesce(at(v, "$.choices[0].message.reasoning_content", "string"), F.lit(""))
    return strip_reasoning(F.when(F.trim(content) == "", thought).otherwise(content))


def message_reasoning(v: Column) -> Column:
    return F.nullif(at(v, "$.choices[0].message.reasoning_content", "string"), F.lit(""))


def tool_calls(v: Column) -> Column:
    """Names and arguments (JSON text) of the calls; arguments that don't parse are an empty object."""
    raw = F.coalesce(at(v, "$.choices[0].message.tool_calls", "array<variant>"), F.array().cast("array<variant>"))

    def call(c: Column) -> Column:
        text = at(c, "$.function.arguments", "string")
        args = F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))
        return F.struct(at(c, "$.function.name", "string").alias("name"), F.to_json(args).alias("arguments"))

    return F.transform(raw, call)


def sampling_description(temperature: Column, seed: Column) -> Column:
    """One line that says what sampler made a file."""
    warm = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", temperature.cast("double")), "0+$", ""), r"\.$", "")
    first = F.when(temperature.isNull(), "server-default").otherwise(F.concat(F.lit("temperature="), warm))
    return F.concat(first, F.lit(", "), F.when(seed.isNull(), "no seed sent").otherwise(F.concat(F.lit("seed="), seed.cast("string"), F.lit("+trial"))))
