import datetime as dt
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from voucherlens.functions import dates, geo, text, verbatim
from voucherlens.operators import checks, lookups, rollup, scoring
from voucherlens.plans import catalog
from voucherlens.sources import readers, sinks
from voucherlens.streaming import windows


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def pair_score(t, e, free_truth, by_truth):
    pairs = sorted((lev(a, b) / max(len(a), len(b), 1), i, j) for i, a in enumerate(t) for j, b in enumerate(e))
    ti, ej, m, total, cost = set(), set(), 0.0, 0, 0
    for k, i, j in pairs:
        if i in ti or j in ej:
            continue
        ti.add(i)
        ej.add(j)
        n = len(t[i]) + len(e[j])
        m += n * (1 - k)
        total += n
        free = (len(t[i]) == 1 and e[j][:1] == t[i]) or (len(e[j]) == 1 and t[i][:1] == e[j])
        cost += 0 if free else lev(t[i], e[j])
    rest_t, rest_e = (sum(len(w) for i, w in enumerate(ws) if i not in used) for ws, used in ((t, ti), (e, ej)))
    if by_truth:
        n = sum(map(len, t))
        return max(0.0, 1 - (cost + rest_t + rest_e) / n) if n else 0.0
    total += rest_e + (0 if free_truth else rest_t)
    return m / total if total else 0.0


@pytest.mark.parametrize(("free_truth", "by_truth"), [(False, False), (True, False), (False, True)])
def test_token_pairing_against_brute_force(spark, free_truth, by_truth):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    rows = [([word() for _ in range(r.randint(0, 4))], [word() for _ in range(r.randint(0, 4))]) for _ in range(150)]
    got = values(spark, rows, "t array<string>, e array<string>", text.token_pair_cer(F.col("t"), F.col("e"), free_truth, by_truth))
    assert [x[0] for x in got] == pytest.approx([pair_score(t, e, free_truth, by_truth) for t, e in rows])


def test_query_of_token_pairs_against_brute_force(spark):
    rows = catalog.token_pairing(spark, "/root/testdata/sf0.001").collect()
    assert all(x.similarity == pytest.approx(pair_score(x.a, x.b, False, False), abs=1e-6) for x in rows)
    assert len(rows) == 1500 and max(len(x.a) for x in rows) >= 6 and len({x.similarity for x in rows}) > 50


def test_clean_text(spark):
    rows = [(" N/A ",), (None,), ("",), ("Ca\u0301fé  STRAßE",), ("CafÃ© ",), ("Иванов",), ("Ελλάς",), ("北京",)]
    got = [x[0] for x in values(spark, rows, "x string", text.clean_text(F.col("x")))]
    assert got[:3] == ["na"] * 3 and got[4] == "cafe" and got[5] == "ivanov" and got[6] == "ellas" and got[7] == "北京"


def test_names(spark):
    rows = [("Quercus robur L.",), ("Quercus, robur",), ("Asplenium sp.",), ("sp.",)]
    assert [x[0] for x in values(spark, rows, "x string", text.strip_authors(F.col("x")))] == ["quercus robur", "quercus robur", "asplenium sp.", "sp."]
    assert [x[0] for x in values(spark, rows, "x string", text.drop_placeholder(F.col("x")))] == ["Quercus robur L.", "Quercus, robur", "Asplenium", "sp."]


@pytest.mark.parametrize(
    ("truth", "found", "score"),
    [
        ("1948-04-06", "1948-06-04", 0.9), ("1966-05", "1966", 0.5), ("1966", "1966-03-01", 1.0), ("1966-05-10", "1966-05", 0.75),
        ("1966-05-10", "1966-05-11", 0.95), ("1966-05-10", "1966-05-17", 0.85), ("1966-05-10", "1966-05-25", 0.75), ("1966-05-10", "1967-05-10", 0.0),
        ("1854-05-00", "1854-05", 1.0), ("1966-05-10", "nan", 0.0), ("n/a", "1966", 0.0), ("1966-05-10T12:00", "1966-05-10", 1.0),
    ],
)
def test_date_score(spark, truth, found, score):
    assert values(spark, [(truth, found)], "a string, b string", dates.date_accuracy(F.col("a"), F.col("b"))) == [(score,)]


def test_iso_spans(spark):
    good = {"2020-366": 1, "1964": 366, "1964-12": 31, "1964-12-13T10:30Z": 1, "1964-12/1965": 396}
    bad = ["1963-02-29", "0000", "2021-366", "2020-01/2019", "a/b/c", "2020-01-01T25", "", None, "2020-13"]
    span = dates.iso_span(F.col("x"))
    got = values(spark, [(x,) for x in [*good, *bad]], "x string", "x", (F.datediff(span["last"], span["first"]) + 1).alias("n"))
    assert dict(got) == good | dict.fromkeys(bad)


VERBATIM = [
    ("1982-02-05", "DATE", "1982-02-05"),
    ("04/03/1994", "AMBIGUOUS", "1994-03-04/1994-04-03"),
    ("14/03/1994", "DATE", "1994-03-14"),
    ("19.IV.1964", "DATE", "1964-04-19"),
    ("Jan 03, 1982", "DATE", "1982-01-03"),
    ("Friday 29th Oct. 2021", "DATE", "2021-10-29"),
    ("1970s", "RANGE", "1970-01-01/1979-12-31"),
    ("1900s", "RANGE", "1900-01-01/1999-12-31"),
    ("02/1982", "RANGE", "1982-02"),
    ("1972年03月25日", "DATE", "1972-03-25"),
    ("1884-85", "RANGE", "1884/1885"),
    ("11 et 14 VII 1910", "DISJUNCT_RANGE", "1910-07-11/1910-07-14"),
    ("Aug. 5 - Sept. 8, 1943", "RANGE", "1943-08-05/1943-09-08"),
    ("1994-128", "DATE", "1994-05-08"),
    ("XX-04-1982", "RANGE", "1982-04"),
    ("1882 to 1885", "RANGE", "1882/1885"),
    ("19950315", "DATE", "1995-03-15"),
    ("1983-15", "NOT_RUN", None),
    ("no date", "NOT_RUN", None),
    (None, "NOT_RUN", None),
    ("0982-02-05", "SUSPECT", "0982-02-05"),
    ("June, 1980", "RANGE", "1980-06"),
    ("1982.02.05", "DATE", "1982-02-05"),
    ("1982,22,5", "DATE", "1982-05-22"),
    ("1982.2.5", "AMBIGUOUS", "1982-02-05/1982-05-02"),
    ("Friday 29th Oct. 2021", "DATE", "2021-10-29"),
    ("Monday 29th Oct. 2021", "NOT_RUN", None),
    ("05-XXX-1884", "RANGE", "1884-01-05/1884-12-05"),
    ("19 3/viii 25", "DATE", "1925-08-03"),
    ("3 agosto 1925", "DATE", "1925-08-03"),
    ("3 Rhagfyr 1925", "DATE", "1925-12-03"),
    ("1972年3月25号", "DATE", "1972-03-25"),
    ("02-1982", "RANGE", "1982-02"),
    ("[no year]", "NOT_RUN", None),
    (None, "NOT_RUN", None),
    ("", "NOT_RUN", None),
    ("15 maja 1901", "DATE", "1901-05-15"),
    ("12 января 1901", "DATE", "1901-01-12"),
    ("3 srpna 1899", "DATE", "1899-08-03"),
    ("5. března 1910", "DATE", "1910-03-05"),
    ("7 tammikuuta 1933", "DATE", "1933-01-07"),
    ("1 Μαΐου 1950", "DATE", "1950-05-01"),
    ("8 sierpień 1920", "DATE", "1920-08-08"),
    ("listopada 1901", "NOT_RUN", None),
    ("1982-02-05/1982-02-07", "RANGE", "1982-02-05/1982-02-07"),
    ("1885/1886", "RANGE", "1885/1886"),
    ("2020-01-05/07", "RANGE", "2020-01-05/2020-01-07"),
    ("2020-01-01/2020-12-31", "RANGE", "2020"),
    ("-0044", "SUSPECT", "-0044"),
    ("1885-03/1886-04", "RANGE", "1885-03/1886-04"),
    ("1885-13/1886-14", "NOT_RUN", None),
    ("19800000", "RANGE", "1980"),
    ("1980-145/1980-200", "RANGE", "1980-05-24/1980-07-18"),
    ("2021-366", "NOT_RUN", None),
    ("1805-06", "SUSPECT", "1805-06"),
    ("1933-Mar", "RANGE", "1933-03"),
    ("jan.-1992", "RANGE", "1992-01"),
    ("Jan to Feb 1882", "RANGE", "1882-01/1882-02"),
    ("Jan and Mar 1882", "DISJUNCT_RANGE", "1882-01/1882-03"),
    ("05/Jan/1882-03/Feb/1885", "RANGE", "1882-01-05/1885-02-03"),
    ("5 Aug. - 8 Sept, 1943", "RANGE", "1943-08-05/1943-09-08"),
    ("Jan,15-18 1882", "RANGE", "1882-01-15/1882-01-18"),
    ("Jan. 17 and 18 1882", "RANGE", "1882-01-17/1882-01-18"),
    ("12 Jan 1900 12 Jan 1900", "DATE", "1900-01-12"),
    ("[\"3 May 1900\"].", "DATE", "1900-05-03"),
    ("1994-05-06T10:00", "DATE", "1994-05-06"),
    ("XX-XXX-1995", "RANGE", "1995"),
    ("1882-1995", "RANGE", "1882/1995"),
    ("1995-1882", "NOT_RUN", None),
    ("31 April 1900", "NOT_RUN", None),
    ("29 Feb 1900", "NOT_RUN", None),
    ("12 xx 19", "NOT_RUN", None),
]


def test_verbatim_dates(spark):
    df = spark.createDataFrame([(x,) for x, *_ in VERBATIM], "t string").select("t", verbatim.verbatim_date(F.col("t")).alias("d"))
    got = {x.t: tuple(x.d) for x in df.collect()}
    assert got == {t: (state, iso) for t, state, iso in VERBATIM}


def test_coordinates(spark):
    rows = [(0.0, 0.0089), (0.0, 0.0899), (0.0, 0.44), (0.0, 0.89), (0.0, 1.0)]
    km = geo.haversine_km(F.lit(0.0), F.lit(0.0), F.col("a"), F.col("b"))
    assert [x[0] for x in values(spark, rows, "a double, b double", geo.coordinate_score(km))] == [1.0, 0.9, 0.3, 0.1, 0.0]
    texts = ["1.5", "1d", "1.0f", "1_000", "inf", "1e400", " -3 ", ".5", "", None, "41.05 N"]
    assert [x[0] for x in values(spark, [(t,) for t in texts], "x string", geo.number(F.col("x")))] == [1.5, None, None, 1000.0, None, None, -3.0, 0.5, None, None, None]


def test_field_scores(spark):
    def one(kind, truth, found, **more):
        df = spark.createDataFrame([(truth, found)], "t string, e string")
        return tuple(df.select(scoring.score_field(kind, F.col("t"), F.col("e"), **more).alias("s")).select("s.score", "s.method").first())

    assert one("geo", "Viet Nam", "Vietnam") == (1.0, "geo-nospace-match")
    assert one("geo", "Chinese Taipei", "Taiwan") == (1.0, "geo-hdx-match")
    assert one("geo", "France", "") == (None, "N/A") and one("taxon", "Abies alba", "nan") == (0.0, "missing") and one("date", "N/A", "1990") == (None, "N/A")
    assert one("collector", "Jacques Dupont", "J. Dupont") == (1.0, "coll-cer")
    assert one("taxon", "Quercus robur", "Quercus robor")[0] == pytest.approx(1 - 1 / 12)
    assert one("date", "1964-04-19", "1964-04-20", label=F.lit("leg. X 20.IV.1964")) == (1.0, "cer-manual-text")
    assert one("geo", "Lyon, Rhône", "Lyon", label=F.lit("Lyon 1900"))[1] in ("geo-cer-bag", "cer-manual-text")


def test_quality_tests(spark):
    rows = [
        ("a", "1964-02-30", "1,200-1,000 m", "", "", "Holo.| Isotype", "Quercus robur L.", "Quercus", "robur", "1_000", "95"),
        ("b", "1964-02", "10 yards", "", "", "Iso.", "Quercus ruber", "Quercus", "robur", "10", "20"),
        ("c", "", "200 – 300 m", "", "", "Holotype", None, None, None, "", None),
        ("d", "1500", "5700 ft", "1", "", " Holotype", "Abies x alba", "Abies", "alba", "0", "0"),
    ]
    df = spark.createDataFrame(rows, "id string, eventDate string, verbatimElevation string, minimumElevationInMeters string, maximumElevationInMeters string, typeStatus string, scientificName string, genericName string, specificEpithet string, decimalLatitude string, decimalLongitude string")
    out = {(r.id, r.test): (r.status, r.result) for r in checks.evaluate(checks.with_verbatim_dates(df), "id", "2026-01-01").collect()}
    assert len(checks.TESTS) == 37 and len(out) == 4 * 37
    get = lambda i, t: out[i, t]
    assert get("a", "VALIDATION_EVENTDATE_STANDARD")[1] == "NOT_COMPLIANT" and get("b", "MEASURE_EVENTDATE_DURATIONINSECONDS") == ("RUN_HAS_RESULT", str(29 * 86400))
    assert get("d", "VALIDATION_EVENTDATE_INRANGE")[1] == "NOT_COMPLIANT" and get("c", "VALIDATION_EVENTDATE_INRANGE")[0] == checks.PREREQ
    assert get("b", "AMENDMENT_EVENT_FROM_EVENTDATE")[1] == "dwc:year=1964; dwc:month=2; dwc:startDayOfYear=32; dwc:endDayOfYear=60"
    e = "AMENDMENT_MINELEVATIONMAXELEVATION_FROM_VERBATIM"
    assert get("a", e)[0] == "NOT_AMENDED" and get("b", e)[1] == "dwc:minimumElevationInMeters=9.144; dwc:maximumElevationInMeters=9.144"
    assert get("c", e)[1] == "dwc:minimumElevationInMeters=200; dwc:maximumElevationInMeters=300" and get("d", e)[0] == checks.PREREQ
    t = "AMENDMENT_TYPESTATUS_STANDARDIZED"
    assert get("a", t)[1] == "dwc:typeStatus=Holotype| Isotype" and get("b", t)[0] == "NOT_AMENDED" and get("c", t)[0] == "NOT_AMENDED"
    assert get("c", "VALIDATION_TYPESTATUS_STANDARD")[1] == "COMPLIANT" and get("d", "VALIDATION_TYPESTATUS_STANDARD")[1] == "NOT_COMPLIANT"
    p = "VALIDATION_POLYNOMIAL_CONSISTENT"
    assert [get(i, p)[1] for i in "abcd"] == ["COMPLIANT", "NOT_COMPLIANT", "", "COMPLIANT"]
    assert get("a", "VALIDATION_DECIMALLATITUDE_INRANGE")[1] == "NOT_COMPLIANT" and get("d", "VALIDATION_COORDINATES_NOTZERO")[1] == "NOT_COMPLIANT"
    wide = checks.pivot(checks.evaluate(df, "id", "2026-01-01"), "id")
    assert wide.columns[:3] == ["id", "PASS", "FAIL"] and len(wide.columns) == 40 and wide.count() == 4


def test_places(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    borders = spark.createDataFrame([(0, "AA", ["Aland"], [ring, hole])], "feature_pos int, iso_a2 string, names array<string>, rings array<array<struct<lon:double,lat:double>>>")
    rows = [(1, "5.0", "2.0", "AA"), (2, "5.0", "5.0", "AA"), (3, "-5.0", "2.0", "AA"), (4, "-0.01", "5.0", "AA"), (5, "50", "50", "AA"), (6, "x", "2", "AA"), (7, "8", "2", None)]
    got = {r.id: r for r in lookups.places(spark.createDataFrame(rows, "id int, lat string, lon string, country_code string"), "id", borders).collect()}
    assert got[1].place_near and got[1].place_code == "AA" and 2 not in got
    assert got[3].place_better == "dwc:decimalLatitude=5.0; dwc:decimalLongitude=2.0" and got[4].place_near and 5 not in got and 6 not in got and got[7].place_code == "AA"


def test_lookups(spark):
    df = spark.createDataFrame([(1, "Quercus robur alba"), (2, "Abies")], "id int, name string")
    hits = spark.createDataFrame([("quercus", "Quercus"), ("quercus robur", "Quercus robur L.")], "query string, name string")
    assert [tuple(r) for r in lookups.longest_prefix(df, "id", "name", hits).collect()] == [(1, "quercus robur", "Quercus robur L.", 2)]
    places = spark.createDataFrame([("France", "46", "2"), ("Lyon, France", "45", "4")], "query string, lat string, lon string")
    cascade = lookups.place_queries(F.lit("Rue X, Lyon"), F.lit(""), F.lit(None).cast("string"), F.lit("France"))
    assert [tuple(r) for r in lookups.first_hit(df.limit(1), "id", cascade, places).collect()] == [(1, "Lyon, France", "45", "4")]
    req = spark.createDataFrame([("j", 0, "a"), ("j", 1, "b"), ("j", 2, "c")], "job string, line_no int, key string")
    ans = spark.createDataFrame([("j", 9, "a", "A", None), ("j", 1, None, "B", None)], "job string, line_no int, key string, response string, error string")
    assert {r.key: (r.response, r.error) for r in lookups.batch_answers(req, ans).collect()} == {"a": ("A", None), "b": ("B", None), "c": (None, "missing from results")}


def test_collectors(spark):
    occ = [("x", "FR", 1900 + i % 10) for i in range(40)] + [("y", "FR", 1900)]
    profiles = rollup.collector_profiles(spark.createDataFrame(occ, "collector string, country string, year int"))
    rows = [(1, "x", "FR", 1905), (2, "x", "DE", 1905), (3, "x", "FR", 1950), (4, "y", "FR", 1900), (5, "z", "FR", 1900)]
    got = rollup.collector_verdicts(spark.createDataFrame(rows, "id int, collector string, country string, year int"), profiles).collect()
    assert {r.id: r.verdict for r in got} == {1: "ok", 2: "country", 3: "year", 4: "unknown", 5: "unreachable"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("filename;collectedBy\n007.jpg;X, Y\n")
    df = readers.read_input(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["filename", "recordedBy"] and tuple(df.first()) == ("007.jpg", "X, Y")
    (tmp_path / "l.txt").write_text('# note\n"C:\\pics\\a.jpg"\n/x/b.png\n\n/x/b.png\n')
    assert [r.path for r in readers.read_image_list(spark, str(tmp_path / "l.txt")).orderBy("pos").collect()] == ["/mnt/c/pics/a.jpg", "/x/b.png"]
    lines = spark.createDataFrame([(0, "12"), (1, "see https://www.gbif.org/occurrence/99 and gbif.org/en/occurrence/12"), (2, "no 5")], "pos int, line string")
    assert [r.id for r in readers.parse_ids(lines, "line").collect()] == ["12", "99"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text(json.dumps({"darwin_core": {"genus": "Abies", "specificEpithet": "alba", "country": "unknown"}, "meta": {"model": "m"}}))
    (tmp_path / "r" / "2.json").write_text(json.dumps({"error": "no"}))
    (tmp_path / "r" / "3.json").write_text(json.dumps({"collector": "Y", "tokens_in": 3}))
    got = {r.scientificName: r for r in readers.core_columns(readers.read_records(spark, str(tmp_path / "r"))).collect()}
    assert set(got) == {"Abies alba", ""} and got["Abies alba"].country == "" and got[""].recordedBy == "Y"
    (tmp_path / "n.json").write_text(json.dumps({"_about": "x", "a": "text", "b": {"transcription": "t", "fields": {"country": "FR"}}}))
    got = {r.annotation_id: (r.transcription, r.fields) for r in readers.read_annotations(spark, str(tmp_path / "n.json")).collect()}
    assert got == {"a": ("text", None), "b": ("t", {"country": "FR"})}
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>filename</t></si><si><t>country</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2" t="inlineStr"><is><t>FR</t></is></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.read_workbook(spark, str(tmp_path / "b.xlsx")).collect()] == [(None, "FR")]
    sinks.write_frames({"f": df}, str(tmp_path / "out"), "csv")
    assert "007.jpg" in sinks.page("t", spark.read.option("header", True).csv(str(tmp_path / "out" / "f")))
    assert not sinks.write_failures(spark.createDataFrame([("a", "ok")], "id string, status string"), str(tmp_path / "fail"))


def test_streaming_replay(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 5), "a", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        windows.incremental(spark, str(tmp_path / "in"), df.schema, lambda b: b.where("value >= 10"), str(tmp_path / "out"), str(tmp_path / "ck"), 1).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windows.failures_by_window(stream, 10.0).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {tuple(r) for r in windows.failures_by_window(df, 10.0, watermark=None).collect()}
    assert {tuple(r) for r in spark.sql("select * from w").collect()} == batch


def test_entry_has_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "field_scores" in e.queries()


def test_durations_free_dates_and_schema(spark):
    rows = [("2020-01-01", 86400), ("2020-01-01T10:00:00Z", 0), ("2020-01-01T10:00/2020-01-01T11:00", 3600), ("2020-01-01T10:00:00/T11:00:00", 3600), ("2020-01-01T10:00/2020-01-02", None), (None, None), ("2020", 366 * 86400)]
    df = spark.createDataFrame(rows, "t string, want long")
    assert [x.got for x in df.select(dates.duration_seconds(F.col("t")).alias("got")).collect()] == [w for _, w in rows]
    pairs = [("May 1854", "1854-05", 1.0), ("12 Jun 1923", "1923-06-12", 1.0), ("06/12/1923", "1923-06-12", 1.0), ("25/12/1923", "1923-12-25", 1.0), ("about", "1923", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    assert [x.got for x in df.select(dates.date_accuracy(F.col("a"), F.col("b")).alias("got")).collect()] == [w for *_, w in pairs]
    df = spark.createDataFrame([({"collectorName": "X", "elevation": "120", "location": "not recorded", "taxon_name": "Abies alba"},)], "core map<string,string>")
    got = readers.core_columns(df).first()
    assert (got.recordedBy, got.minimumElevationInMeters, got.locality, got.scientificName) == ("X", "120", "", "Abies alba")
    got = checks.prepare(spark.createDataFrame([("Picea", "", "1966-05-00"), ("Picea", "Abies", None)], "genus string, genericName string, eventDate string")).collect()
    assert [(x.genericName, x.eventDate) for x in got] == [("Picea", "1966-05"), ("Abies", None)]
    many = spark.range(12).selectExpr("concat('m', id) model", "10L tokens_in", "10L tokens_out", "false is_batch", "false is_local")
    assert rollup.cost(many, many.selectExpr("model", "1.0D in_per_m", "1.0D out_per_m")).where("cost_usd is null").count() == 0
    assert "first 3 rows only" in sinks.page("t", many, 3) and "rows only" not in sinks.page("t", many, 12)


def test_places_against_brute_force(spark):
    import math

    rng = random.Random(5)
    star = [(10 + (4 if i % 2 else 9) * math.cos(i * math.pi / 8) + 0.013 * i, 3 + (3 if i % 2 else 7) * math.sin(i * math.pi / 8)) for i in range(16)]
    hole = [(9.5, 2.5), (11.0, 2.5), (10.0, 4.25), (9.5, 2.5)]
    rings = {"AA": [star + star[:1], hole], "BB": [[(-5.0, -5.0), (20.0, -5.0), (20.0, -4.0), (-5.0, -4.0), (-5.0, -5.0)]], "CC": [hole]}
    rows = [(i, code, [code], [[(float(x), float(y)) for x, y in ring] for ring in own]) for i, (code, own) in enumerate(rings.items())]
    borders = spark.createDataFrame(rows, "feature_pos int, iso_a2 string, names array<string>, rings array<array<struct<lon:double,lat:double>>>")

    def inside(x, y, own):
        hits = 0
        for ring in own:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                hits += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return hits % 2 == 1

    def near(x, y, own, d):
        for ring in own:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
                if math.hypot(x1 + t * (x2 - x1) - x, y1 + t * (y2 - y1) - y) <= d:
                    return True
        return inside(x, y, own)

    points = [(i, f"{rng.uniform(-6, 11):.3f}", f"{rng.uniform(-7, 21):.3f}", rng.choice(["AA", "BB", "CC", None])) for i in range(1500)]
    df = spark.createDataFrame([*points, (1500, None, "3", "AA"), (1501, "", "", None)], "id long, lat string, lon string, country_code string")
    found = {r["id"]: r for r in lookups.places(df, "id", borders, km=30.0).collect()}
    for i, lat, lon, code in points:
        x, y, row = float(lon), float(lat), found.get(i)
        assert (row is not None and row["place_near"]) == (code is not None and near(x, y, rings[code], 30 / 111)), (i, lat, lon, code)
        holders = [c for c, own in rings.items() if inside(x, y, own)]
        assert (row and row["place_code"]) == (holders[0] if len(holders) == 1 else None), (i, lat, lon)
        forms = [(y, x), *([(x, y)] if abs(x) <= 90 else []), (-y, x), (y, -x), (-y, -x)]
        better = next(((a, b) for a, b in forms[1:] if code and near(b, a, rings[code], 30 / 111)), None)
        said = row and row["place_better"]
        assert (said is None) == (better is None), (i, lat, lon, code)
        if said:
            assert [float(t.split("=")[1]) for t in said.split("; ")] == pytest.approx(better)
    assert 1500 not in found and 1501 not in found


def test_month_words_share_their_beginnings():
    """The pattern of month words reads what the plain alternative of them reads, and no two of its ways begin alike."""
    import re

    from voucherlens.functions import labels

    words = sorted(labels._NAMES, key=len, reverse=True)
    assert re.fullmatch(labels._choice(["sept", "sep", "se", "mai"]), "sep") and labels._choice(["sept", "sep", "mai"]) == "s(?:e(?:p(?:t|)))|mai"
    plain, shared = re.compile(rf"({'|'.join(words)})\.?,?\s*\d"), re.compile(rf"({labels._MONTH})\.?,?\s*\d")
    for w in words:
        for said in (f"{w} 12", f"{w}. 1", f"{w}x 3", f"{w[:-1]} 4", f"no {w}12"):
            a, b = plain.search(said), shared.search(said)
            assert (a and a.groups()) == (b and b.groups())
    assert len({x[:1] for x in words}) > 10


def test_shared_texts_are_scored_once(spark, monkeypatch):
    from voucherlens.plans import specimens

    tables = {}
    real = scoring.written
    monkeypatch.setattr(scoring, "written", lambda df, name: tables.setdefault(name, real(df, name)))
    folder = "/root/testdata/sf0.001"
    got = catalog.all_field_scores(spark, folder)
    # the work on names, dates and places grows with their pairs of texts, not with the records
    assert tables["scores"].count() == tables["scores"].dropDuplicates(["kind", "truth", "found"]).count() == tables["pairs"].count()
    assert tables["scores"].where("kind in ('taxon', 'epithet', 'geo')").count() < specimens.specimens(spark, folder).count()
    # each record scored by itself
    df = specimens.specimens(spark, folder)
    names = specimens.backbone(df)
    for column, match in (("truth_scientificName", "truth_match"), ("scientificName", "found_match")):
        df = lookups.match_names(df, column, names, match, "name", cleaned=True)
    relation = lookups.name_relation(F.col("truth_match"), F.col("found_match"), F.lit(""), text.strip_authors(F.col("scientificName")))
    df = scoring.score_fields(df, relation={"scientificName": relation})
    df = df.withColumn("coordinates_score", scoring.score_coordinates(*map(F.col, ("truth_decimalLatitude", "truth_decimalLongitude", "decimalLatitude", "decimalLongitude"))))
    said = scoring.long_results(df, "specimen_id").drop("note")
    assert got.columns == said.columns and got.dtypes == said.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, said.collect()))


def test_pairs_with_nulls_keep_their_rows(spark):
    rows = [(1, "Peru", "Peru"), (2, "Peru", None), (3, None, "Peru"), (4, None, None), (5, "Peru", "Peru"), (6, "Chile", "Chili"), (7, "", "")]
    df = spark.createDataFrame(rows, "id long, truth_country string, country string").withColumns({"truth_genus": F.lit("Abies"), "genus": F.lit("Abis")})
    fields = {"country": "geo", "genus": "epithet"}
    pairs = scoring.distinct_pairs(df, fields)
    assert pairs.count() == 7
    got = scoring.join_scores(df, fields, scoring.score_pairs(pairs)).select("id", "country_score", "genus_score")
    said = scoring.score_fields(df, fields).select("id", "country_score", "genus_score")
    assert sorted(got.collect()) == sorted(said.collect())
