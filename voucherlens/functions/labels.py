"""Dates in the text of a label, as candidates with their place, and what they say of a truth and a transcription that differ."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from voucherlens.functions.dates import MONTHS, ROMAN, components, date_accuracy, free_components
from voucherlens.functions.text import let

# How sure a kind of candidate is, the longest range of years, what stands between parts, the verdicts.
RANKS = {"high": 3, "range": 2, "medium": 1, "year": 0}
LONGEST = 20
_BETWEEN = r"[\s./\-]+"
_ORDINAL = r"(?:st|nd|rd|th)?"
_YEAR = r"(\d{4}|\d{2})"
FOR_FOUND, FOR_TRUTH = "sheet supports AI — GBIF likely wrong", "sheet supports GBIF — AI wrong"
FOR_BOTH, FOR_NONE, NO_DATE = "sheet confirms both AI and GBIF", "sheet agrees with neither / inconclusive", "no date pattern found on sheet — review manually"

_NAMES = {name: n for n, names in MONTHS.items() for name in names.split()}


def _choice(words: list[str]) -> str:
    """An alternative of words in their order, what they begin with stated once: at most places of a text one letter decides. A word comes after those it begins."""
    firsts: dict[str, list[str]] = {}
    for w in words:
        firsts.setdefault(w[:1], []).append(w[1:])
    last = "|" if firsts.pop("", None) else ""
    return "|".join(re.escape(a) + (rest[0] if len(rest) == 1 else f"(?:{_choice(rest)})") for a, rest in firsts.items()) + last


_MONTH = _choice(sorted(_NAMES, key=len, reverse=True))
_CANDIDATE = "array<struct<said:string,iso:string,year:int,confidence:string,first:int,last:int,place:int>>"

#: pattern, what its groups are, confidence: in the order that decides between equals
_FORMS = [
    (r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", "ymd", "high"),
    (rf"\b(\d{{1,2}}){_ORDINAL}{_BETWEEN}([ivx]{{1,4}}){_BETWEEN}{_YEAR}\b", "dry", "high"),
    (rf"\b(\d{{1,2}})[./\-](\d{{1,2}})[./\-]{_YEAR}\b", "dmy", "high"),
    (rf"\b({_MONTH})\.?{_BETWEEN}(\d{{1,2}}){_ORDINAL},?{_BETWEEN}{_YEAR}\b", "ndy", "high"),
    (rf"\b(\d{{1,2}}){_ORDINAL}{_BETWEEN}({_MONTH})\.?,?{_BETWEEN}{_YEAR}\b", "dny", "high"),
    (rf"\b([ivx]{{1,4}})[./\-]{_YEAR}\b", "ry", "medium"),
    (rf"\b({_MONTH})\.?,?{_BETWEEN}{_YEAR}\b", "ny", "medium"),
]


def full_year(y: Column, hints: Column, this_year: int) -> Column:
    """A year of two digits as the first hinted year that ends so, else the latest one that isn't in the future."""
    short = y.try_cast("int")
    fits = F.get(F.filter(hints, lambda h: h % 100 == short), 0)
    return F.when(F.length(y) == 4, short).otherwise(F.coalesce(fits, F.when(short <= this_year % 100, 2000 + short).otherwise(1900 + short)))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def candidates(label: Column, years: Column, days: Column | None = None, this_year: int = 2026) -> Column:
    """All dates of a label's text, overlapping ones too: array<struct(said, iso, year, confidence, first, last, place)>.

    By kind, then by place: full dates, months, ranges of years (first to last, 20 years at most, no iso), a year equal to
    one of the hinted `years` (array<int>), a pair of numbers equal to day and month of one of the hinted `days`
    (array<struct(y, m, d)>) in either order. place: where the text has what it says, from 1.
    """
    days = (F.array() if days is None else days).cast("array<struct<y:int,m:int,d:int>>")
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    romans = F.create_map(*[F.lit(x) for i, r in enumerate(ROMAN) for x in (r.lower(), i + 1)])
    low = F.lower(F.coalesce(label, F.lit("")))

    def search(text: Column, hints: Column) -> Column:
        all_ = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        place = lambda said: F.instr(text, said)
        none = F.lit(None).cast("int")

        def form(pattern: str, order: str, confidence: str) -> Column:
            def one(said: Column) -> Column:
                part = {k: F.regexp_extract(said, pattern, i + 1) for i, k in enumerate(order)}
                month = F.try_element_at(names, part["n"]) if "n" in part else F.try_element_at(romans, part["r"]) if "r" in part else part["m"].try_cast("int")
                day = part["d"].try_cast("int") if "d" in part else none
                read = F.struct(full_year(part["y"], hints, this_year).alias("y"), month.alias("m"), day.alias("d"))
                fine = lambda x: (x["m"].between(1, 12)) & (x["d"].between(1, 31) if "d" in part else F.lit(True))
                iso = lambda x: F.concat_ws("-", F.lpad(x["y"].cast("string"), 4, "0"), _two(x["m"]), _two(x["d"]) if "d" in part else F.lit(None).cast("string"))
                return let(read, lambda x: F.when(fine(x), F.struct(iso(x).alias("said"), iso(x).alias("iso"), x["y"].alias("year"), F.lit(confidence).alias("confidence"), none.alias("first"), none.alias("last"), place(said).alias("place"))))

            return F.transform(all_(pattern), one)

        def range_(said: Column) -> Column:
            a, b = (F.regexp_extract(said, r"^(\d{4})\s*[-–]\s*(\d{2}|\d{4})$", i) for i in (1, 2))
            end = F.when(F.length(b) == 4, b.try_cast("int")).otherwise(F.floor(a.try_cast("int") / 100).cast("int") * 100 + b.try_cast("int"))
            read = F.struct(a.try_cast("int").alias("a"), end.alias("b"))
            return let(read, lambda x: F.when((x["a"] <= x["b"]) & (x["b"] <= x["a"] + LONGEST), F.struct(F.format_string("%d-%d (range)", x["a"], x["b"]).alias("said"), F.lit(None).cast("string").alias("iso"), none.alias("year"), F.lit("range").alias("confidence"), x["a"].alias("first"), x["b"].alias("last"), place(said).alias("place"))))

        def bare(said: Column) -> Column:
            return F.when(F.array_contains(hints, said.try_cast("int")), F.struct(said.alias("said"), said.alias("iso"), said.try_cast("int").alias("year"), F.lit("year").alias("confidence"), none.alias("first"), none.alias("last"), place(said).alias("place")))

        def pair(said: Column) -> Column:
            a, b = (F.regexp_extract(said, r"^(\d{1,2})[./](\d{1,2})$", i).try_cast("int") for i in (1, 2))
            hit = F.get(F.filter(days, lambda h: F.array_sort(F.array(a, b)) == F.array_sort(F.array(h["d"], h["m"]))), 0)
            iso = lambda h: F.concat_ws("-", F.lpad(h["y"].cast("string"), 4, "0"), _two(h["m"]), _two(h["d"]))
            return let(hit, lambda h: F.when(h.isNotNull(), F.struct(iso(h).alias("said"), iso(h).alias("iso"), h["y"].alias("year"), F.lit("high").alias("confidence"), none.alias("first"), none.alias("last"), place(said).alias("place"))))

        found = [form(*f) for f in _FORMS]
        found += [F.transform(all_(r"\b\d{4}\s*[-–]\s*(?:\d{4}|\d{2})\b"), range_), F.transform(all_(r"\b\d{4}\b"), bare), F.transform(all_(r"\b\d{1,2}[./]\d{1,2}\b"), pair)]
        return F.filter(F.concat(*[f.cast(_CANDIDATE) for f in found]), lambda x: x.isNotNull())

    clean = F.array_distinct(F.array_compact(F.coalesce(years, F.array().cast("array<int>"))))
    return let(F.struct(low.alias("t"), clean.alias("h")), lambda x: search(x["t"], x["h"]))


def best(found: Column, years: Column) -> Column:
    """The candidate of a hinted year (for a range: one within it) first, then the surer kind, then the earlier; null without any."""
    rank = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    hinted = lambda x: F.when(x["confidence"] == "range", F.exists(years, lambda h: h.between(x["first"], x["last"]))).otherwise(F.array_contains(years, x["year"]))
    ranked = F.transform(found, lambda x, i: F.struct((~F.coalesce(hinted(x), F.lit(False))).alias("other"), (-F.try_element_at(rank, x["confidence"])).alias("rank"), i.alias("at"), x.alias("it")))
    return F.get(F.array_sort(ranked), 0)["it"]


def range_accuracy(first: Column, last: Column, value: Column) -> Column:
    """1 if a year that a text names lies between two years, else 0."""
    named = F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"\b(\d{4})\b"), 1), lambda y: y.cast("int"))
    return F.when(F.exists(named, lambda y: y.between(first, last)), 1.0).otherwise(0.0)


def resolve(truth: Column, found: Column, label: Column, this_year: int = 2026) -> Column:
    """struct(verdict, value, confidence, vs_found, vs_truth, corrected) of two dates that differ and a label's text.

    Null where there is no text or the dates agree. The text's best date is scored against either side; only where it
    supports the transcription, or both, is there a corrected score.
    """
    read = lambda c: let(F.trim(F.get(F.split(F.coalesce(c, F.lit("")), "T"), 0)), lambda x: F.coalesce(components(x), free_components(x)))
    sides = F.struct(read(truth).alias("t"), read(found).alias("f"))

    def judge(x: Column) -> Column:
        years = F.array_compact(F.array(x["t"]["y"], x["f"]["y"]))
        day = lambda s: F.when(s["precision"] == 3, F.struct(s["y"].alias("y"), s["m"].alias("m"), s["d"].alias("d")))
        hit = let(years, lambda h: best(candidates(label, h, F.array_compact(F.array(day(x["t"]), day(x["f"]))), this_year), h))
        return let(hit, weigh)

    def weigh(hit: Column) -> Column:
        against = lambda side: F.when(hit["confidence"] == "range", range_accuracy(hit["first"], hit["last"], side)).otherwise(date_accuracy(hit["iso"], side))
        return let(F.struct(hit.alias("h"), against(found).alias("f"), against(truth).alias("t")), tell)

    def tell(x: Column) -> Column:
        f, t = x["f"], x["t"]
        verdict = F.when(x["h"].isNull(), NO_DATE).when(f > t, FOR_FOUND).when(t > f, FOR_TRUTH).when(f >= 1, FOR_BOTH).otherwise(FOR_NONE)
        seen = lambda c: F.when(x["h"].isNotNull(), c)
        return F.struct(verdict.alias("verdict"), x["h"]["said"].alias("value"), x["h"]["confidence"].alias("confidence"), seen(f).alias("vs_found"), seen(t).alias("vs_truth"), seen(F.when((f > t) | ((f == t) & (f >= 1)), f)).alias("corrected"))

    return F.when((F.trim(label) != "") & (date_accuracy(truth, found) < 1), let(sides, judge))
