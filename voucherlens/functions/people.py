"""Collectors' names: the first person of a field, its surname and initials, and the ways it may be spelt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voucherlens.functions.text import let

# What stands between the persons of a field (or after them), and what initials look like.
BETWEEN = r"(?iU)\s*(?:;|&|/|\band\b|\bet\b|\bet al\.?|\bs\.?\s?n\.?\b)\s*"
INITIALS = r"^(?:\p{L}\.?){1,4}$"


def _trimmed(c: Column, marks: str) -> Column:
    return F.regexp_replace(c, rf"^[{marks}]+|[{marks}]+$", "")


def _is_initials(token: Column) -> Column:
    """One to four letters, with points or few or all capital."""
    return token.rlike(INITIALS) & (token.contains(".") | (F.length(token) <= 2) | ((F.upper(token) == token) & (F.lower(token) != token)))


def _letters(tokens: Column) -> Column:
    """Initials of name parts: all letters of "K.H.", the first of "Pierre"."""
    return F.flatten(F.transform(tokens, lambda t: F.when(_is_initials(t), F.regexp_extract_all(t, F.lit(r"\p{L}"), F.lit(0))).otherwise(F.array(F.substring(t, 1, 1)))))


def parse_name(c: Column) -> Column:
    """struct(surname, initials array) of the first person of a collector field; an empty surname where there is none.

    "Last, F. M.", "F.M. Last", "First Middle Last" and a single word are understood.
    """
    none = F.array().cast("array<string>")
    say = lambda surname, initials: F.struct(surname.alias("surname"), initials.alias("initials"))

    def read(one: Column) -> Column:
        after = F.array_remove(F.split(F.regexp_extract(one, r"(?s)^[^,]*,(.*)$", 1), r"\s+"), "")
        by_comma = say(_trimmed(F.substring_index(one, ",", 1), r"\s."), _letters(after))
        return F.when(one == "", say(F.lit(""), none)).when(one.contains(","), by_comma).otherwise(let(F.array_remove(F.split(one, r"\s+"), ""), by_parts))

    def by_parts(parts: Column) -> Column:
        short = F.filter(parts, _is_initials)
        others = F.array_join(F.filter(parts, lambda t: ~_is_initials(t)), " ")
        last = say(_trimmed(F.element_at(parts, -1), "."), _letters(F.slice(parts, F.lit(1), F.size(parts) - 1)))
        mixed = (F.size(short) > 0) & (F.size(short) < F.size(parts))
        return F.when(F.size(parts) == 1, say(_trimmed(F.get(parts, 0), "."), none)).when(mixed, say(_trimmed(others, r"\s."), _letters(short))).otherwise(last)

    first = F.get(F.split(F.trim(F.coalesce(c, F.lit(""))), BETWEEN, 2), 0)
    return let(_trimmed(first, r"\s,."), read)


def titled(c: Column) -> Column:
    """Every run of letters with a capital first and small letters after."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def name_variants(c: Column) -> Column:
    """The common spellings of a collector's name, in order: the surname as written and in title case, with initials six ways, before and after."""

    def spell(p: Column) -> Column:
        surnames = F.array_distinct(F.array(p["surname"], titled(p["surname"])))
        capitals = F.transform(p["initials"], lambda i: F.upper(i))
        dotted = F.transform(capitals, lambda i: F.concat(i, F.lit(".")))
        forms = F.array(*[F.array_join(dotted, x) for x in ("", " ")], *[F.array_join(capitals, x) for x in (".", ". ", " ", "")])
        full = F.flatten(F.transform(surnames, lambda s: F.flatten(F.transform(forms, lambda f: F.array(F.concat(s, F.lit(", "), f), F.concat(s, F.lit(" "), f), F.concat(f, F.lit(" "), s))))))
        every = F.when(F.size(p["initials"]) > 0, F.concat(surnames, full)).otherwise(surnames)
        return F.when(p["surname"] == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))

    return let(parse_name(c), spell)


def profile_key(c: Column) -> Column:
    """surname|initials in small letters; null without a surname."""
    return let(parse_name(c), lambda p: F.when(p["surname"] != "", F.lower(F.concat(p["surname"], F.lit("|"), F.array_join(p["initials"], "")))))
