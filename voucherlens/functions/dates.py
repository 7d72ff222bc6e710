"""Dates: ISO spans, the partial-credit score, durations. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voucherlens.functions.text import CLEAN_NULLS, let

_TIME = r"(?:T(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?)?(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?)?"
_SINGLE = rf"^(\d{{4}})(?:-(\d{{2}})(?:-(\d{{2}}))?|-(\d{{3}}))?{_TIME}$"


def _part_span(text: Column) -> Column:
    """struct(first, last) of one ISO date (YYYY, YYYY-MM, YYYY-MM-DD, YYYY-DDD, with or without a time), or null."""

    def span(x: Column) -> Column:
        y, m, d, o = x["y"], x["m"], x["d"], x["o"]
        day = F.concat_ws("-", y, m, d).try_cast("date")
        month = F.concat(y, F.lit("-"), m, F.lit("-01")).try_cast("date")
        year = F.concat(y, F.lit("-01-01")).try_cast("date")
        nth = let(F.date_add(year, o.cast("int") - 1), lambda n: F.when((o.cast("int") > 0) & (F.year(n) == y.cast("int")), n))
        first = F.when(d.isNotNull(), day).when(m.isNotNull(), month).when(o.isNotNull(), nth).otherwise(year)
        last = F.when(d.isNotNull(), F.lit(None).cast("date")).when(m.isNotNull(), F.last_day(month)).when(o.isNull(), F.concat(y, F.lit("-12-31")).try_cast("date"))
        both = F.struct(first.alias("first"), last.alias("last"))
        both = let(both, lambda b: F.when(b["first"].isNotNull(), F.struct(b["first"].alias("first"), F.coalesce(b["last"], b["first"]).alias("last"))))
        return F.when(y.isNotNull() & (y != "0000"), both)

    parts = [F.nullif(F.regexp_extract(text, _SINGLE, i), F.lit("")).alias(n) for i, n in ((1, "y"), (2, "m"), (3, "d"), (4, "o"))]
    return let(F.struct(*parts), span)


def iso_span(c: Column) -> Column:
    """struct(first, last) of an ISO date or of two joined by a slash, the end not before the start; else null."""

    def span(parts: Column) -> Column:
        ends = F.struct(F.size(parts).alias("n"), _part_span(F.trim(F.get(parts, 0))).alias("a"), _part_span(F.trim(F.element_at(parts, -1))).alias("b"))
        return let(ends, lambda x: F.when((x["n"] <= 2) & (x["a"]["first"] <= x["b"]["last"]), F.struct(x["a"]["first"].alias("first"), x["b"]["last"].alias("last"))))

    return let(F.split(F.trim(c), "/"), span)


def components(c: Column) -> Column:
    """struct(precision, y, m, d) of YYYY or YYYY-M[-D] (no calendar check, a zero part is absent), or null."""
    text = F.get(F.split(F.trim(c), "T"), 0)
    part = lambda i: F.regexp_extract(text, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$", i).try_cast("int")

    def told(x: Column) -> Column:
        m = F.when(x["m"] != 0, x["m"])
        d = F.when((x["m"] != 0) & (x["d"] != 0), x["d"])
        p = F.when(d.isNotNull(), 3).when(m.isNotNull(), 2).otherwise(1)
        return F.struct(p.alias("precision"), F.when(x["y"] != 0, x["y"]).alias("y"), m.alias("m"), d.alias("d"))

    # each part is cut out once
    return F.when(text.rlike(r"^\d{4}(-\d{1,2}){0,2}$"), let(F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")), told))


def free_components(c: Column) -> Column:
    """`components` of English free forms (May 1854; 12 Jun 1923; 06/12/1923, month first where it can be), or null."""
    return let(F.lower(F.trim(c)), lambda text: F.when(text.rlike(r"[a-z]{3}.*\d{4}|\d{4}.*[a-z]{3}"), _named(text)).otherwise(_numeric(text)))


def _named(text: Column) -> Column:
    part = F.struct(
        F.regexp_extract(text, r"(?<!\d)(\d{4})(?!\d)", 1).try_cast("int").alias("y"),
        F.instr(F.lit("..janfebmaraprmayjunjulaugsepoctnovdec"), F.regexp_extract(text, r"(?<![a-z])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*", 1)).alias("at"),
        F.regexp_extract(text, r"(?<!\d)(0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?(?![\da-z])", 1).try_cast("int").alias("d"),
    )
    return let(part, lambda x: F.when((x["at"] > 2) & x["y"].isNotNull(), F.struct(F.when(x["d"].isNull(), 2).otherwise(3).alias("precision"), x["y"].alias("y"), F.floor(x["at"] / 3).cast("int").alias("m"), x["d"].alias("d"))))


def _numeric(text: Column) -> Column:
    """Month first where it can be; a day that looks like the month is no sign of a day."""
    part = F.struct(*[F.regexp_extract(text, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", i).try_cast("int").alias(n) for i, n in enumerate("aby", 1)])
    ordered = lambda x: F.struct(x["y"].alias("y"), F.when(x["a"] > 12, x["b"]).otherwise(x["a"]).alias("m"), F.when(x["a"] > 12, x["a"]).otherwise(x["b"]).alias("d"))
    told = lambda x: F.when(x["m"].between(1, 12) & x["d"].between(1, 31), F.struct(F.when(x["m"] == x["d"], 2).otherwise(3).alias("precision"), x["y"].alias("y"), x["m"].alias("m"), F.when(x["m"] != x["d"], x["d"]).alias("d")))
    return let(part, lambda x: let(ordered(x), told))


def date_score(truth: Column, found: Column) -> Column:
    """Partial credit between two `components` structs; 0 where either is null."""
    near = F.abs(truth["d"] - found["d"])
    swapped = (truth["m"] == found["d"]) & (truth["d"] == found["m"])
    day = F.when(truth["m"] != found["m"], F.when(swapped, 0.9).otherwise(0.5)).when(found["d"].isNull(), 0.75).when(near == 0, 1.0).when(near == 1, 0.95).when(near <= 7, 0.85).otherwise(0.75)
    day = F.when(found["m"].isNull(), 0.5).otherwise(day)
    month = F.when(found["m"].isNull() | (truth["m"] != found["m"]), 0.5).otherwise(1.0)
    return F.when(truth.isNull() | found.isNull(), 0.0).when(truth["y"] != found["y"], 0.0).when(truth["precision"] == 1, 1.0).when(truth["precision"] == 2, month).otherwise(day)


def date_accuracy(truth: Column, found: Column) -> Column:
    """`date_score` of two texts; missing ones score 0."""
    gone = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(CLEAN_NULLS)
    any_ = lambda c: let(c, lambda x: F.coalesce(components(x), free_components(x)))
    both = F.struct(any_(truth).alias("t"), any_(found).alias("e"))
    return F.when(gone(truth) | gone(found), 0.0).otherwise(let(both, lambda x: date_score(x["t"], x["e"])))


# Month names by number, in the languages labels are written in; roman months.
MONTHS = {
    1: "january jan januar jänner janvier janv januarii gennaio enero ionawr janauary jnry 一月",
    2: "february feb febr februar février fevrier februarii febbraio febrero chwefror febuary 二月",
    3: "march mar märz maerz mars martii marzo marts mawrth mrch 三月", 4: "april apr avril aprilis aprile abril ebrill 四月",
    5: "may mai maii maggio mayo maj 五月", 6: "june jun juni juin junii giugno junio mehefin 六月",
    7: "july jul jly jully juli juillet julii luglio julio gorffennaf 七月", 8: "august aug août aout augusti agosto awst 八月",
    9: "september sept sep septembre septembris settembre septiembre setiembre medi septmber 九月",
    10: "october oct oktober okt octobre octobris ottobre octubre hydref 十月", 11: "november nov novembre novembris noviembre tachwedd 十一月",
    12: "december dec dezember dez décembre decembre decembris dicembre diciembre rhagfyr 十二月",
}
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]


def timed_seconds(c: Column) -> Column:
    """Seconds between two date-times joined by a slash, 0 for a single one; null where a part has no time or the end is before the start.

    The end may leave out the date. Offsets are read over.
    """

    def moment(bit: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(bit, r"(?<=T.{2,20})(?:Z|[+-]\d{2}(?::?\d{2})?)$", ""), ",", ".")
        plain = F.regexp_replace(plain, "T24", "T00")  # clock hour 24 is midnight at the start of the day
        whole = F.when(plain.rlike(r"T\d{2}$"), F.concat(plain, F.lit(":00"))).otherwise(plain)
        return F.when(whole.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:"), whole.try_cast("timestamp_ntz"))

    parts = F.split(F.trim(c), "/")
    a, b = F.get(parts, 0), F.element_at(parts, -1)
    end = moment(F.when(b.startswith("T"), F.concat(F.substring(a, 1, 10), b)).otherwise(b))
    seconds = F.timestamp_diff("SECOND", moment(a), end)
    return F.when((F.size(parts) <= 2) & (seconds >= 0), seconds)


def duration_seconds(c: Column) -> Column:
    """Seconds of an ISO date or interval of whole days, before the common era too, or between its times; null if it is neither."""
    from voucherlens.functions import intervals

    return F.when(c.contains("T"), timed_seconds(c)).otherwise(intervals.seconds(intervals.interval(F.trim(c))))
