"""Values of JSON texts found by key at any depth, in the order of the text. All are Catalyst expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from voucherlens.functions import text

# an escaped backslash and an escaped quote, while a text is cut into tokens: no character of a text has these codes
_BACKSLASH, _QUOTE = "￾", "￿"


def _hidden(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _shown(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def tokens(doc: Column) -> Column:
    """Tokens of a JSON text: strings with their quotes, brackets, colons, commas, numbers and words."""
    return F.regexp_extract_all(_hidden(doc), F.lit(r'"[^"]*"|[{}\[\]:,]|[^\s{}\[\]:,"]+'), F.lit(0))


def plain(token: Column) -> Column:
    """What a string token says, its escapes resolved; other tokens as they stand."""
    said = F.try_variant_get(F.try_parse_json(_shown(token)), "$", "string")
    return F.when(token.startswith('"'), F.when(token.contains("\\") | token.contains(_BACKSLASH) | token.contains(_QUOTE), said).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))).otherwise(token)


def _nested(t: Column, at: Column) -> Column:
    """The text from an opening bracket at `at` to the one that closes it."""
    begin = F.struct(F.lit(0).alias("depth"), F.lit("").alias("said"), F.lit(False).alias("over"))

    def read(a: Column, x: Column) -> Column:
        depth = a["depth"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
        more = F.struct(depth.alias("depth"), F.concat(a["said"], x).alias("said"), (depth == 0).alias("over"))
        return F.when(a["over"], a).otherwise(more)

    return _shown(F.aggregate(F.slice(t, at + 1, F.size(t)), begin, read)["said"])


def is_value(token: Column, after: Column) -> Column:
    """Whether a value says something: no null, false, zero, empty bracket or blank, nor a word for a missing value."""
    zero = token.rlike("^-?[0-9]") & (F.coalesce(token.try_cast("double"), F.lit(1.0)) == 0)
    empty = (token.isin("{", "[")) & after.isin("}", "]")
    word = F.lower(F.trim(plain(token))).isin(text.VALID_NULLS)
    return F.coalesce(~(zero | empty | word | token.isin("null", "false", ",", "}", "]")), F.lit(False))


def deep_first(doc: Column, key: str) -> Column:
    """The first value of `key` at any depth of a JSON text that says something, in the order of the text; else null.

    Strings come back unescaped, numbers as written, objects and arrays as JSON. A key inside a string is no key. A text
    that is no JSON gives what its tokens give; a null gives null.
    """
    quoted = json.dumps(key, ensure_ascii=False).replace("\\\\", _BACKSLASH).replace('\\"', _QUOTE)

    def find(t: Column) -> Column:
        here = lambda i: (F.get(t, i) == quoted) | (F.get(t, i).contains("\\u") & (plain(F.get(t, i)) == key))
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - 3, F.lit(0))), lambda i: (F.get(t, i + 1) == ":") & here(i) & is_value(F.get(t, i + 2), F.get(t, i + 3)))
        return text.let(F.get(places, 0) + 2, lambda at: F.when(F.get(t, at).isin("{", "["), _nested(t, at)).otherwise(plain(F.get(t, at))))

    return F.when(doc.contains(json.dumps(key, ensure_ascii=False)[1:-1]) | doc.contains("\\u"), text.let(tokens(doc), find))


def pick_value(key: str, fragment: Column, verbatim: Column, occurrence: Column) -> Column:
    """A field of a record in three JSON documents: at any depth of the fragment, else of the verbatim record, else at the
    top of the interpreted one, the first that says something; else N/A."""
    top = F.get_json_object(occurrence, f"$.{key}")
    said = F.when(~F.lower(F.trim(top)).isin([*text.VALID_NULLS, "null", "false", "0", "0.0", "[]", "{}"]), top)
    return F.coalesce(deep_first(fragment, key), deep_first(verbatim, key), said, F.lit("N/A"))
