"""Intervals of days beyond the date type: years before the common era, abbreviated ends, times read over. All are Catalyst expressions.

An interval is struct(first, last) of day numbers (0 is 1970-01-01) in the proleptic Gregorian calendar, both included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voucherlens.functions.text import let

_OFFSET = r"(?:Z|[+-](?:0\d|1[0-8])(?::?[0-5]\d(?::?[0-5]\d)?)?)"
_CLOCK = rf"T(?:[01]\d|2[0-4])(?::[0-5]\d(?::[0-5]\d)?)?(?:[.,]\d+)?{_OFFSET}?"
_SLASH = "/"


def _div(a: Column, b: int) -> Column:
    """Whole quotient, rounded down."""
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


def day_number(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 to a day of the proleptic calendar; years from 0 down are before the common era."""

    def count(x: Column) -> Column:
        # years begin in March, so that the leap day comes last
        y, n = x["y"] - (x["m"] <= 2).cast("long"), F.pmod(x["m"] + 9, F.lit(12))
        return 365 * y + _div(y, 4) - _div(y, 100) + _div(y, 400) + _div(153 * n + 2, 5) + x["d"] - 1 - 719468

    return let(F.struct(y.cast("long").alias("y"), m.cast("long").alias("m"), d.cast("long").alias("d")), count)


def civil(day: Column) -> Column:
    """struct(y, m, d) of a day number."""

    def era(z: Column) -> Column:
        return F.struct(_div(z, 146097).alias("era"), F.pmod(z, F.lit(146097)).alias("rest"))

    def year(x: Column) -> Column:
        r = x["rest"]
        in_era = _div(r - _div(r, 1460) + _div(r, 36524) - _div(r, 146096), 365)
        return F.struct(x["era"].alias("era"), r.alias("rest"), in_era.alias("y"))

    def month(x: Column) -> Column:
        day_of = x["rest"] - (365 * x["y"] + _div(x["y"], 4) - _div(x["y"], 100))
        return F.struct((x["y"] + 400 * x["era"]).alias("y"), day_of.alias("n"), _div(5 * day_of + 2, 153).alias("p"))

    def told(x: Column) -> Column:
        m = F.pmod(x["p"] + 2, F.lit(12)) + 1
        return F.struct((x["y"] + (m <= 2).cast("long")).alias("y"), m.alias("m"), (x["n"] - _div(153 * x["p"] + 2, 5) + 1).alias("d"))

    return let(let(let(let(day.cast("long") + 719468, era), year), month), told)


def month_length(y: Column, m: Column) -> Column:
    leap = (F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0))
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _pair(first: Column, last: Column) -> Column:
    return F.struct(first.alias("first"), last.alias("last"))


def _bit(text: Column) -> Column:
    """The days of one side: YYYY-MM-DD, YYYY-DDD, YYYY-MM, YYYY, YYYYMMDD, any with a time or an offset, or -YYYY and -YYY."""
    shapes = (("y", r"^(\d{4})"), ("m", r"^\d{4}-(\d{2})(?:-\d{2})?$"), ("d", r"^\d{4}-\d{2}-(\d{2})$"), ("n", r"^\d{4}-(\d{3})$"), ("b", r"^-(\d{3,4})$"), ("p", r"^(\d{8})$"))

    def read(t: Column) -> Column:
        x = {n: F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for n, p in shapes}
        number = lambda c: c.try_cast("int")
        packed = x["p"].isNotNull()
        y = number(x["y"])
        m = F.when(packed, number(F.substring(x["p"], 5, 2))).otherwise(number(x["m"]))
        d = F.when(packed, number(F.substring(x["p"], 7, 2))).otherwise(number(x["d"]))
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"), number(x["n"]).alias("n"), number(x["b"]).alias("b"), t.rlike(r"^\d{4}$").alias("whole"))

    def days(x: Column) -> Column:
        one = F.lit(1)
        year = lambda y: _pair(day_number(y, one, one), day_number(y, F.lit(12), F.lit(31)))
        length = month_length(x["y"], x["m"])
        day = let(day_number(x["y"], x["m"], x["d"]), lambda n: _pair(n, n))
        nth = let(day_number(x["y"], one, one) + x["n"] - 1, lambda n: _pair(n, n))
        fits = x["n"].between(1, 337 + month_length(x["y"], F.lit(2)))
        # a year n before the common era stands for the year -n
        early = F.when(x["b"] >= 1, year(-x["b"]))
        month = _pair(day_number(x["y"], x["m"], one), day_number(x["y"], x["m"], length))
        return F.when(x["b"].isNotNull(), early).when(x["n"].isNotNull(), F.when(fits, nth)).when(x["d"].isNotNull(), F.when(x["m"].between(1, 12) & x["d"].between(1, length), day)).when(x["m"].isNotNull(), F.when(x["m"].between(1, 12), month)).when(x["whole"], year(x["y"]))

    plain = F.regexp_replace(F.regexp_replace(text, rf"{_CLOCK}$", ""), rf"(?<=^\d{{4}}-\d{{2}}-\d{{2}}|^\d{{8}}){_OFFSET}$", "")
    return let(let(plain, read), days)


def interval(c: Column) -> Column:
    """struct(first, last) of day numbers of an ISO date or of two joined by a slash, or null.

    The end may leave out what it shares with the start (2020-01-05/07, 2020-01-05/02-07, 2020-01/03); it can't lie before
    it. A time is checked and read over. -0044 is a year before the common era.
    """

    def halves(parts: Column) -> Column:
        a, b = F.get(parts, 0), F.get(parts, 1)
        full, month = a.rlike(r"^\d{4}-\d{2}-\d{2}$"), a.rlike(r"^\d{4}-\d{2}$")
        end = F.when(full & b.rlike(r"^\d{2}$"), F.concat(F.substring(a, 1, 8), b)).when((full & b.rlike(r"^\d{2}-\d{2}$")) | (month & b.rlike(r"^\d{2}$")), F.concat(F.substring(a, 1, 5), b)).otherwise(b)
        return F.struct(F.size(parts).alias("n"), _bit(a).alias("a"), _bit(end).alias("b"))

    def joined(x: Column) -> Column:
        both = F.when(x["a"]["first"] <= x["b"]["last"], _pair(x["a"]["first"], x["b"]["last"]))
        return F.when(x["n"] == 1, x["a"]).when(x["n"] == 2, both)

    return let(let(F.split(c, _SLASH), halves), joined)


def _year_text(y: Column) -> Column:
    return F.when(y < 0, F.concat(F.lit("-"), F.lpad((-y).cast("string"), 4, "0"))).otherwise(F.lpad(y.cast("string"), 4, "0"))


def to_text(i: Column) -> Column:
    """An interval as shortly as ISO can: a day, a year, years, a month, or two days joined by a slash."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = lambda x: F.concat_ws("-", _year_text(x["y"]), two(x["m"]), two(x["d"]))

    def told(x: Column) -> Column:
        a, b = x["a"], x["b"]
        years = (a["m"] == 1) & (a["d"] == 1) & (b["m"] == 12) & (b["d"] == 31)
        month = (a["y"] == b["y"]) & (a["m"] == b["m"]) & (a["d"] == 1) & (b["d"] == month_length(b["y"], b["m"]))
        out = F.when(x["same"], day(a)).when(years & (a["y"] == b["y"]), _year_text(a["y"])).when(years, F.concat(_year_text(a["y"]), F.lit(_SLASH), _year_text(b["y"])))
        return out.when(month, F.concat_ws("-", _year_text(a["y"]), two(a["m"]))).otherwise(F.concat(day(a), F.lit(_SLASH), day(b)))

    ends = lambda x: F.struct(civil(x["first"]).alias("a"), civil(x["last"]).alias("b"), (x["first"] == x["last"]).alias("same"))
    return let(i, lambda x: F.when(x.isNotNull(), let(ends(x), told)))


def seconds(i: Column) -> Column:
    """How long an interval of whole days is."""
    return let(i, lambda x: (x["last"] - x["first"] + 1) * 86_400)


def is_valid(c: Column) -> Column:
    """Whether a text is a date or an interval that needs no correction; not so for null and blank."""
    return F.coalesce(interval(c).isNotNull(), F.lit(False))
