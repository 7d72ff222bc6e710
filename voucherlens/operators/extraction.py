"""What comes back from an extraction: who answered, what it took, what the answer says, and whether its fields are the right ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the model names of two providers begin; all others are local.
PREFIXES = {"gemini": ["gemini"], "openai": ["gpt", "o1", "o3", "o4", "chatgpt", "text-"]}
LOCAL = "ollama"


def provider(model: Column) -> Column:
    """Who runs a model, by its name."""
    low, out = F.lower(model), F
    for name, starts in PREFIXES.items():
        out = out.when(low.rlike("^(?:" + "|".join(starts) + ")"), name)
    return out.otherwise(LOCAL)


def _first(doc: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(doc, f"$.{p}") for p in paths])


def usage(response: Column) -> Column:
    """struct(tokens_in, tokens_out, tokens_thinking) of an answer in JSON, in either spelling of its keys; what is missing is 0.

    Thinking is billed as output but reported apart from it, so the output has both.
    """
    number = lambda a, b: F.coalesce(_first(response, f"usageMetadata.{a}", f"usage_metadata.{a}", f"usageMetadata.{b}", f"usage_metadata.{b}").try_cast("long"), F.lit(0))
    thinking = number("thoughtsTokenCount", "thoughts_token_count")
    return F.struct(number("promptTokenCount", "prompt_token_count").alias("tokens_in"), (number("candidatesTokenCount", "candidates_token_count") + thinking).alias("tokens_out"), thinking.alias("tokens_thinking"))


def response_text(response: Column) -> Column:
    """struct(text, error) of a batch answer in JSON: the text parts of its first candidate, or why there is none."""
    candidates = F.from_json(F.get_json_object(response, "$.candidates"), "array<struct<content:struct<parts:array<struct<text:string>>>>>")
    parts = F.get(candidates, 0)["content"]["parts"]
    text = F.array_join(F.transform(F.coalesce(parts, F.array().cast("array<struct<text:string>>")), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    error = F.when(F.coalesce(F.size(candidates), F.lit(0)) < 1, "batch response has no candidates").when(text == "", "batch response candidate has no text part")
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def field_difference(keys: Column, fields: Iterable[str]) -> Column:
    """struct(missing, unknown): fields that an array of keys lacks, in their order, and keys that are no fields."""
    wanted = F.array(*map(F.lit, fields))
    return F.struct(F.array_except(wanted, keys).alias("missing"), F.array_except(keys, wanted).alias("unknown"))
