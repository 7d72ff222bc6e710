"""Dates as they were written, read by a table of forms. All are Catalyst expressions, meant for distinct texts.

A text is tidied, its month words of many languages become English ones, then the forms are tried in order; each has
a pattern and a reader of its groups, and the first that yields a date decides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from voucherlens.functions import intervals
from voucherlens.functions.dates import MONTHS, ROMAN
from voucherlens.functions.text import let

ENGLISH = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: languages whose month names the Java runtime knows, beyond those listed with MONTHS
LANGUAGES = "bg ca cs da el en es et fi fr ga de hr hu is it lt lv mk nb nl pl pt ro ru sk sl sq sr sv tr uk af eu gl".split()
_NO_MONTHS = {"to", "and", "et", "und", "of", "xx", "xxx", "st", "nd", "rd", "th", "s", "t", "mon", "tue", "wed", "thu", "fri", "sat", "sun"}
_MON = "|".join(ENGLISH)
_ROM = "|".join(sorted((r.lower() for r in ROMAN), key=len, reverse=True))
_ORD = r"(?:st|nd|rd|th|\.)?"
_YEAR = r"(\d{4})"
_CENTURY = rf"([12][07-9]) (\d{{1,2}})/(\d{{1,2}}|{_ROM}) (\d{{2}})"


@lru_cache(maxsize=4)
def month_names(languages: tuple[str, ...] = tuple(LANGUAGES)) -> dict[str, int]:
    """Month names and abbreviations by number: those of MONTHS, and those of the Java runtime's locale data in every case
    that dates use. A name that means different months in different languages is none, unless MONTHS has it.
    """
    time, locale = SparkSession.active()._jvm.java.time, SparkSession.active()._jvm.java.util.Locale
    fixed = {name: n for n, names in MONTHS.items() for name in names.split()}
    found: dict[str, set[int]] = {}
    for tag in languages:
        for n in range(1, 13):
            for style in ("FULL", "FULL_STANDALONE", "SHORT", "SHORT_STANDALONE"):
                name = time.Month.of(n).getDisplayName(getattr(time.format.TextStyle, style), locale.forLanguageTag(tag)).lower().rstrip(".")
                if name.isalpha() and len(name) > 1 and name not in _NO_MONTHS:
                    found.setdefault(name, set()).add(n)
    return {name: min(ns) for name, ns in found.items() if len(ns) == 1} | fixed


def clean_months(c: Column, languages: tuple[str, ...] = tuple(LANGUAGES)) -> Column:
    """A lower-case text with every month word, of whatever language and with or without a point, as an English abbreviation."""
    names = F.str_to_map(F.lit(",".join(f"{name}:{ENGLISH[n - 1]}" for name, n in month_names(languages).items())), F.lit(","), F.lit(":"))
    words = F.regexp_extract_all(c, F.lit(r"\p{L}[\p{L}\p{M}]*\.?|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(names, F.regexp_replace(w, r"\.$", "")), w)), "")


def _month(text: Column) -> Column:
    """The number of a month written as a number, an English abbreviation or a roman numeral; else null."""
    known = F.str_to_map(F.lit(",".join(f"{name}:{i + 1}" for i in range(12) for name in (ENGLISH[i], ROMAN[i].lower()))), F.lit(","), F.lit(":"))
    return let(text, lambda m: F.coalesce(m.try_cast("int"), F.try_element_at(known, m).try_cast("int")))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _say(state: str, result: Column) -> Column:
    return let(result, lambda r: F.when(r.isNotNull(), F.struct(F.lit(state).alias("state"), r.alias("result"))))


def _iso(y: Column, m: Column, d: Column) -> Column:
    """YYYY-MM-DD of three texts, null if there is no such day."""
    read = F.struct(y.try_cast("int").alias("y"), _month(m).alias("m"), d.try_cast("int").alias("d"))  # each is stated once
    fine = lambda x: (x["y"] >= 1) & x["m"].between(1, 12) & x["d"].between(1, intervals.month_length(x["y"], x["m"]))
    return let(read, lambda x: F.when(fine(x), F.concat_ws("-", F.lpad(x["y"].cast("string"), 4, "0"), _two(x["m"]), _two(x["d"]))))


def _one(order: str) -> Callable[..., Column]:
    return lambda *g: _say("DATE", _iso(*[g[order.index(k)] for k in "ymd"]))


def _span(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when(x["a"] <= x["b"], F.concat(x["a"], F.lit("/"), x["b"])))


def _either(a: Column, b: Column, y: Column) -> Column:
    """Day and month in unknown order."""
    days = F.array_sort(F.array_distinct(F.array_compact(F.array(_iso(y, a, b), _iso(y, b, a)))))
    return let(days, lambda x: F.when(F.size(x) == 1, _say("DATE", F.get(x, 0))).when(F.size(x) == 2, _say("AMBIGUOUS", F.array_join(x, "/"))))


def _dotted(y: Column, a: Column, b: Column) -> Column:
    """Year, then month and day in unknown order; a month of two digits is one."""
    return F.coalesce(F.when(F.length(a) == 2, _say("DATE", _iso(y, a, b))), _either(a, b, y))


def _weekday(name: Column, d: Column, m: Column, y: Column) -> Column:
    """A date whose day of the week is right."""
    return let(_iso(y, m, d), lambda iso: F.when(F.lower(F.date_format(iso.try_cast("date"), "EEEE")).startswith(name), _say("DATE", iso)))


def _monthly(y: Column, m: Column) -> Column:
    return let(_month(m), lambda n: F.when(n.between(1, 12), _say("RANGE", F.concat_ws("-", y, _two(n)))))


def _ordinal(y: Column, n: Column) -> Column:
    nth = F.date_add(F.concat(y, F.lit("-01-01")).try_cast("date"), n.try_cast("int") - 1)
    return let(nth, lambda d: F.when((n != "000") & (F.year(d) == y.try_cast("int")), d.cast("string")))


def _days(a: Column, word: Column, b: Column, m: Column, y: Column) -> Column:
    """Two days of one month; "and" between days that aren't neighbours is no range."""
    apart = F.trim(word).isin("and", "et", "&", "und") & (b.try_cast("int") - a.try_cast("int") > 1)
    return let(_span(_iso(y, m, a), _iso(y, m, b)), lambda s: F.when(apart, _say("DISJUNCT_RANGE", s)).otherwise(_say("RANGE", s)))


def _months(a: Column, word: Column, b: Column, y: Column) -> Column:
    def read(x: Column) -> Column:
        result = F.when(x["a"] <= x["b"], F.concat(y, F.lit("-"), _two(x["a"]), F.lit("/"), y, F.lit("-"), _two(x["b"])))
        apart = F.trim(word).isin("and", "et", "&", "und") & (x["b"] - x["a"] > 1)
        return let(result, lambda r: F.when(apart, _say("DISJUNCT_RANGE", r)).otherwise(_say("RANGE", r)))

    return let(F.struct(_month(a).alias("a"), _month(b).alias("b")), read)


def _range(*parts: Column | str) -> Column:
    return _say("RANGE", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


#: Forms in the order they are tried, with a reader of their groups; month words are English by then, letters small.
FORMS: list[tuple[str, Callable[..., Column]]] = [
    (rf"{_YEAR}[-/](\d{{1,2}})[-/](\d{{1,2}})(?:t.*)?", _one("ymd")),
    (rf"{_YEAR}[-/ ]({_MON})[-/ ](\d{{1,2}})(?:t.*)?", _one("ymd")),
    (rf"{_YEAR}[-.,](1[3-9]|[23]\d)[-.,](\d{{1,2}})", _one("ydm")),
    (rf"{_YEAR}[.,](\d{{1,2}})[.,](\d{{1,2}})", _dotted),
    (rf"(0?[1-9]|1[0-2])[-/. ]{_YEAR}", lambda m, y: _monthly(y, m)),
    (r"(\d{4})年(\d{1,2})月(\d{1,2})[日号]", _one("ymd")),
    (rf"{_YEAR}-(\d{{3}})/{_YEAR}-(\d{{3}})", lambda y, n, z, o: _say("RANGE", _span(_ordinal(y, n), _ordinal(z, o)))),
    (r"(\d{4})0000", lambda y: _range(y)),
    (_YEAR, lambda y: _range(y)),
    (r"(\d{2})00'?s", lambda c: _range(c, "00-01-01/", c, "99-12-31")),
    (r"(\d{3})0'?s", lambda c: _range(c, "0-01-01/", c, "9-12-31")),
    (rf"({_MON}|{_ROM})[-/ ,.]+{_YEAR}", lambda m, y: _monthly(y, m)),
    (rf"{_YEAR}[-/ ,.]+({_MON})", _monthly),
    (rf"(\d{{1,2}})[-/. ]+(\d{{1,2}})[-/. ]+{_YEAR}", _either),
    (rf"((?:mon|tues|wednes|thurs|fri|satur|sun)day|mon|tue|wed|thu|fri|sat|sun),? (\d{{1,2}})(?:st|nd|rd|th) ({_MON}),? {_YEAR}", _weekday),
    (rf"(\d{{1,2}}){_ORD}[-/., ]*(?:of )?({_MON}|{_ROM})[-/., ]+{_YEAR}", _one("dmy")),
    (rf"({_MON}|{_ROM})[-/. ]*(\d{{1,2}}){_ORD}[-/, ]+{_YEAR}", _one("mdy")),
    (rf"(?:xx|\?\?|--?)[-/. ](\d{{1,2}})[-/. ]{_YEAR}", lambda m, y: _monthly(y, m)),
    (rf"(?:xx|\?\?)[-/. ](?:xxx?|\?\??\??)[-/. ]{_YEAR}", lambda y: _range(y)),
    (rf"(\d{{2}})[-. ]xxx[-. ]{_YEAR}", lambda d, y: _say("RANGE", _span(_iso(y, F.lit("1"), d), _iso(y, F.lit("12"), d)))),
    (_CENTURY, lambda c, d, m, y: _one("dmy")(d, m, F.concat(c, y))),
    (rf"{_YEAR}-(\d{{3}})", lambda y, n: _say("DATE", _ordinal(y, n))),
    (rf"{_YEAR}-(0[1-9]|1[0-2])", lambda y, m: F.when(F.substring(y, 3, 2) < m, _say("SUSPECT", F.concat_ws("-", y, m))).otherwise(_say("RANGE", F.concat_ws("-", y, m)))),
    (r"(\d{2})(\d{2})-(\d{2})", lambda c, a, b: F.when(b > a, _range(c, a, "/", c, b))),
    (r"(\d{4})(\d{2})(\d{2})", _one("ymd")),
    (rf"{_YEAR} ?(?:-|to|–) ?{_YEAR}", lambda a, b: _say("RANGE", _span(a, b))),
    (rf"({_MON}) ?(to|-|and|et|&) ?({_MON}),? {_YEAR}", _months),
    (rf"(\d{{1,2}})[-/ ]({_MON})[-/ ]{_YEAR} ?- ?(\d{{1,2}})[-/ ]({_MON})[-/ ]{_YEAR}", lambda d, m, y, e, n, z: _say("RANGE", _span(_iso(y, m, d), _iso(z, n, e)))),
    (rf"({_MON}) (\d{{1,2}}) ?- ?({_MON}) (\d{{1,2}}),? {_YEAR}", lambda m, d, n, e, y: _say("RANGE", _span(_iso(y, m, d), _iso(y, n, e)))),
    (rf"(\d{{1,2}}) ({_MON}) ?- ?(\d{{1,2}}) ({_MON}),? {_YEAR}", lambda d, m, e, n, y: _say("RANGE", _span(_iso(y, m, d), _iso(y, n, e)))),
    (rf"(\d{{1,2}})( ?- ?| ?& ?| and | et | und | to )(\d{{1,2}})[. ]+({_MON}|{_ROM}),? {_YEAR}", _days),
    (rf"({_MON}),? ?(\d{{1,2}})( ?- ?| ?& ?| and | et | to )(\d{{1,2}}),? {_YEAR}", lambda m, a, w, b, y: _days(a, w, b, m, y)),
    (rf"{_YEAR}-(\d{{2}})/{_YEAR}-(\d{{2}})", lambda y, m, z, n: F.when(m.between("01", "12") & n.between("01", "12"), _say("RANGE", _span(F.concat_ws("-", y, m), F.concat_ws("-", z, n))))),
]


def tidied(c: Column) -> Column:
    """A text without notes that there is no date, brackets, quotes and a last point, in single blanks; said twice, once."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\[no (?:date|year)\]|[\[\]\"]", "")
    out = F.trim(F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"\.+$", ""))
    half = lambda v: F.floor(F.length(v) / 2).cast("int")
    twice = lambda v: (F.length(v) > 8) & (F.length(v) % 2 == 1) & F.substring(v, half(v) + 1, F.lit(1)).isin(" ", "/") & (F.substring(v, F.lit(1), half(v)) == F.substring(v, half(v) + 2, half(v)))
    return let(out, lambda v: F.when(twice(v), F.substring(v, F.lit(1), half(v))).otherwise(v))


def verbatim_date(c: Column, suspect_before: int = 1000) -> Column:
    """struct(state, result): DATE, RANGE, AMBIGUOUS, SUSPECT or DISJUNCT_RANGE with an ISO date or interval, or NOT_RUN and null.

    A text needs a year of four digits, or a century and a year around day and month. What lies before the year
    `suspect_before` is suspect. Any ISO interval is read as well, abbreviated ends among them.
    """
    nothing = F.struct(F.lit("NOT_RUN").alias("state"), F.lit(None).cast("string").alias("result"))

    def read(x: Column) -> Column:
        v = x["clean"]
        found = [F.when(v.rlike(f"^(?:{p})$"), reader(*[F.regexp_extract(v, f"^(?:{p})$", i + 1) for i in range(p.count("(") - p.count("(?") - p.count(r"\("))])) for p, reader in FORMS]
        whole = intervals.interval(F.upper(x["plain"]))
        say = lambda i: F.struct(F.when(i["first"] == i["last"], "DATE").otherwise("RANGE").alias("state"), intervals.to_text(i).alias("result"))
        iso = let(whole, lambda i: F.when(i.isNotNull(), say(i)))
        return let(F.coalesce(*found, F.when(x["plain"].rlike(r"\d{4}"), iso), nothing), sane)

    def sane(r: Column) -> Column:
        early = r["result"].startswith("-") | (F.substring(r["result"], 1, 4).try_cast("int") < suspect_before)
        return F.when(early, F.struct(F.lit("SUSPECT").alias("state"), r["result"].alias("result"))).otherwise(r)

    plain = let(F.lower(tidied(c)), lambda v: F.struct(v.alias("plain"), clean_months(v).alias("clean")))
    dated = lambda x: x["plain"].rlike(rf"\d{{4}}|^{_CENTURY}$")
    return let(plain, lambda x: F.when(dated(x), read(x)).otherwise(nothing))
