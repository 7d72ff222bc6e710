import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voucherlens.functions import intervals, labels, text
from voucherlens.operators import chunks

INTERVALS = [
    ("2020-01-05", "2020-01-05", 1), ("2020-02-30", None, None), ("2020-366", "2020-12-31", 1), ("2021-366", None, None), ("2020-02", "2020-02", 29), ("1999", "1999", 365), ("20200105", "2020-01-05", 1), ("20201305", None, None),
    ("2020-01-05/07", "2020-01-05/2020-01-07", 3), ("2020-01-05/02-07", "2020-01-05/2020-02-07", 34), ("2020-01/03", "2020-01-01/2020-03-31", 91), ("2020-01-05/2019", None, None), ("-0044", "-0044", 366), ("-044", "-0044", 366),
    ("-0044/0010", "-0044/0010", 20089), ("-0001/2000", "-0001/2000", 731216), ("-0000", None, None), ("123", None, None), ("2020-01-05T10:00Z", "2020-01-05", 1), ("2020-01-05T25:00", None, None), ("2020-01-05T24", "2020-01-05", 1),
    ("2020-01-05T10:00:00.5+02:00/2020-01-06T10", "2020-01-05/2020-01-06", 2), ("2020-01-05Z", "2020-01-05", 1), ("1885/1886", "1885/1886", 730), ("", None, None), ("x", None, None), ("2020/2021/2022", None, None), (None, None, None),
    ("2020-01-01/2020-12-31", "2020", 366), ("2020-03-01/2020-03-31", "2020-03", 31), ("0000", "0000", 366), ("2020-1-5", None, None), ("1900-02-29", None, None), ("2000-02-29", "2000-02-29", 1),
]


def test_intervals(spark):
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x, *_ in INTERVALS], "t string").select("t", intervals.interval(t).alias("i"))
    got = {x.t: (x.s, x.n) for x in df.select("t", intervals.to_text(F.col("i")).alias("s"), (intervals.seconds(F.col("i")) / 86_400).cast("int").alias("n")).collect()}
    assert got == {t: (s, n) for t, s, n in INTERVALS}


def test_day_numbers_against_the_calendar(spark):
    r = random.Random(1)
    days = [(r.randint(-2_000_000, 2_000_000),) for _ in range(400)] + [(0,), (-719528,), (-719529,), (-719162,)]
    parts = intervals.civil(F.col("n"))
    df = spark.createDataFrame(days, "n long").select("n", parts.alias("c"))
    for x in df.select("n", "c", intervals.day_number(F.col("c.y"), F.col("c.m"), F.col("c.d")).alias("back")).collect():
        assert x.back == x.n
        if 1 <= x.n + 719163 <= dt.date.max.toordinal():
            d = dt.date.fromordinal(x.n + 719163)
            assert tuple(x.c) == (d.year, d.month, d.day)


LABELS = [
    # label, truth, found, value, confidence, verdict
    ("Annis 1836-38. leg. X", "1837-05-01", "1857-05-01", "1836-1838 (range)", "range", labels.FOR_TRUTH),
    ("No 1801-95, 1990", "1990-05", "1991", "1990", "year", labels.FOR_TRUTH),
    ("11 Sep. 80", "1980-09-12", "1980-09-11", "1980-09-11", "high", labels.FOR_FOUND),
    ("3.4.03", "1903-04-03", "1904", "1903-04-03", "high", labels.FOR_TRUTH),
    ("no 6/4, Kew", "1926-04-06", "1927-04-06", "1926-04-06", "high", labels.FOR_TRUTH),
    ("24th-VI-1901", "1901", "1901-06-24", None, None, None),
    ("VI.1901", "1901-07", "1901-06", "1901-06", "medium", labels.FOR_FOUND),
    ("1 I 1800; May 3rd, 1901", "1901-05-03", "1901-05", "1901-05-03", "high", labels.FOR_TRUTH),
    ("Mai 1901 and 2 Mai 1902", "1902-05-02", "1903", "1902-05-02", "high", labels.FOR_TRUTH),
    ("1900", "1901", "1902", None, None, labels.NO_DATE),
    ("12 März 1850", "1901", "1902", "1850-03-12", "high", labels.FOR_NONE),
    ("", "1901", "1902", None, None, None),
    (None, "1901", "1902", None, None, None),
]


def test_label_verdicts(spark):
    df = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(LABELS)], "i int, label string, truth string, found string")
    for x in df.select("i", labels.resolve(F.col("truth"), F.col("found"), F.col("label")).alias("v")).collect():
        *_, value, confidence, verdict = LABELS[x.i]
        assert (x.v and x.v.value, x.v and x.v.confidence, x.v and x.v.verdict) == (value, confidence, verdict), LABELS[x.i]
        assert x.v is None or (x.v.corrected is not None) == (verdict in (labels.FOR_FOUND, labels.FOR_BOTH))


def test_label_candidates_keep_all_matches(spark):
    years, days = F.array(F.lit(1901)), F.array(F.struct(F.lit(1901).alias("y"), F.lit(4).alias("m"), F.lit(6).alias("d")))
    df = spark.createDataFrame([("6/4 1901; 3 IV 1899, 1898-1901",)], "t string").select(labels.candidates(F.col("t"), years, days).alias("c"))
    got = [(x.said, x.confidence, x.place) for x in df.first().c]
    assert got == [("1899-04-03", "high", 11), ("1898-1901 (range)", "range", 22), ("1901", "year", 5), ("1901", "year", 5), ("1901-04-06", "high", 1)]
    assert spark.createDataFrame([(None,)], "t string").select(labels.candidates(F.col("t"), years)).first()[0] == []


def rule(sizes, budget):
    out, chunk, held = [], 0, None
    for s in sizes:
        if held is not None and held + s > budget:
            chunk, held = chunk + 1, None
        held = (held or 0) + s
        out.append(chunk)
    return out


def test_chunk_functions_compose():
    r = random.Random(1)
    for _ in range(1500):
        budget = r.choice([0, 5, 20, 50])
        parts = [[r.choice([0, 0, 1, 2, 5, 9, 30, 60]) for _ in range(r.randint(0, 12))] for _ in range(r.randint(1, 6))]
        functions = [chunks.summed_up(np.array(p, dtype=np.int64), budget) for p in parts]
        coming, closed = budget + 1, -1
        for f in functions:
            more, coming = chunks.applied(f, coming, budget)
            closed += more
        whole = functions[0]
        for f in functions[1:]:
            whole = chunks.composed(whole, f, budget)
        want = rule([x for p in parts for x in p], budget)
        assert closed == chunks.applied(whole, budget + 1, budget)[0] - 1 == (want[-1] if want else -1)


@pytest.mark.parametrize(("budget", "n", "ranges"), [(20, 300, 5), (100, 900, 40), (0, 50, 3), (7, 0, 2), (10**6, 200, 4)])
def test_byte_chunks_against_the_rule(spark, budget, n, ranges):
    r = random.Random(budget)
    sizes = [r.choice([None, 0, 1, 3, 8, 15, 30]) for _ in range(n)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "pos int, size int")
    got = [x.chunk for x in chunks.byte_chunks(df, budget, ranges=ranges).orderBy("pos").collect()]
    assert got == rule([s or 0 for s in sizes], budget)


def test_plain_texts_take_the_short_way_to_the_same_result(spark):
    """What the short ways of `strip_authors` and `clean_text` say is what the long ways say, odd blanks and signs included."""
    said = ["Quercus robur", "Quercus robur L. ß", "Quercus  robur L.", " Quercus robur", "Quercus, robur", "Quercus\trobur x", "Quercus robur\tL.", "Abies\n", "Abies alba\n", "Abies", "", " ", "a b ", "É a", "N/A", "na ", "NaN", "Ab: c", ";", "a ; b c", None]
    df = spark.createDataFrame([(x,) for x in said], "c string")
    rows = df.select("c", text.strip_authors(F.col("c")).alias("short"), text._stripped(F.col("c")).alias("long"), text.clean_text(F.col("c")).alias("clean")).collect()
    assert [x["short"] for x in rows] == [x["long"] for x in rows]
    plain = lambda x: " ".join((x or "").lower().split()).replace("ß", "ss").replace("é", "e")
    assert [x["clean"] for x in rows] == [("na" if plain(x) in text.CLEAN_NULLS else plain(x)) for x in said]
