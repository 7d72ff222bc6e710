import gzip
import json

import pytest
from pyspark.sql import functions as F

from voucherlens.operators import checks, extraction, lookups, rollup
from voucherlens.sources import readers


def test_providers_usage_and_answers(spark):
    df = spark.createDataFrame([("Gemini-2.5",), ("o3-mini",), ("text-davinci",), ("llama3",)], "m string")
    assert [x[0] for x in df.select(extraction.provider(F.col("m"))).collect()] == ["gemini", "openai", "openai", "ollama"]
    docs = [
        {"usageMetadata": {"promptTokenCount": 10, "candidatesTokenCount": 5, "thoughtsTokenCount": 7}, "candidates": [{"content": {"parts": [{"text": "a"}, {"x": 1}, {"text": "b"}]}}]},
        {"usage_metadata": {"prompt_token_count": 3}, "candidates": []}, {"candidates": [{"content": {"parts": [{"text": ""}]}}]}, {"candidates": [{}]}, {},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, None)], "i int, r string").orderBy("i")
    got = df.select(extraction.usage(F.col("r")).alias("u"), extraction.response_text(F.col("r")).alias("t")).collect()
    assert [tuple(x.u) for x in got] == [(10, 12, 7), (3, 0, 0)] + [(0, 0, 0)] * 4
    no, empty = "batch response has no candidates", "batch response candidate has no text part"
    assert [tuple(x.t) for x in got] == [("ab", None), (None, no), (None, empty), (None, empty), (None, no), (None, no)]
    keys = spark.createDataFrame([(["b", "c", "x"],)], "k array<string>").select(extraction.field_difference(F.col("k"), "abc").alias("d")).first().d
    assert (keys.missing, keys.unknown) == (["a"], ["x"])


def test_costs_need_a_price(spark):
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, in_per_m double, out_per_m double")
    rows = lambda *models: spark.createDataFrame([(m, 1_000_000, 500_000, b, loc) for m, b, loc in models], "model string, tokens_in long, tokens_out long, is_batch boolean, is_local boolean")
    got = rollup.cost(rows(("m", False, False), ("m", True, False), ("own", False, True)), prices).collect()
    assert sorted(x.cost_usd for x in got) == [0.0, 1.0, 2.0]
    with pytest.raises(Exception, match="no price for model new"):
        rollup.cost(rows(("new", False, False)), prices).collect()
    models = spark.createDataFrame([("a", 50.0), ("b", None), ("c", 70.0)], "model string, accuracy double")
    assert [x.model for x in rollup.ranked(models).collect()] == ["c", "a", "b"]


def test_borders_with_holes_and_both_sides_of_the_antimeridian(spark, tmp_path):
    box = lambda w, s, e, n: [[w, s], [e, s], [e, n], [w, n], [w, s]]
    features = [
        {"g": {"type": "Polygon", "coordinates": [box(0, 0, 10, 10), box(4, 4, 6, 6)]}, "p": {"ISO_A2_EH": "AA", "ISO_A2": "-99", "NAME": "Aland", "ADMIN": " ALAND Islands"}},
        {"g": {"type": "MultiPolygon", "coordinates": [[box(170, -10, 180, 0)], [box(-180, -10, -175, 0), box(-179, -5, -178, -4)]]}, "p": {"ISO_A2": "BB", "NAME": "Bee"}},
        {"g": {"type": "Point", "coordinates": [1, 2]}, "p": {"NAME": "none"}},
    ]
    with gzip.open(tmp_path / "borders.json.gz", "wt") as f:
        json.dump(features, f)
    borders = readers.read_borders(spark, str(tmp_path / "borders.json.gz"))
    assert {x.iso_a2: x.names for x in borders.collect()} == {"AA": ["aland", "aland islands"], "BB": ["bee"]}
    points = [(1, "5", "2"), (2, "5", "5"), (3, "-5.5", "175"), (4, "-5.5", "-179.5"), (5, "-4.5", "-178.5"), (6, "-5", "-170")]
    rows = spark.createDataFrame([(*p, None) for p in points], "id int, lat string, lon string, country_code string")
    assert {x.id: x.place_code for x in lookups.places(rows, "id", borders).collect() if x.place_code} == {1: "AA", 3: "BB", 4: "BB"}
    named = lookups.country_codes(spark.createDataFrame([("ALAND",), ("x",)], "country string"), "country", borders).collect()
    assert {x.country: (x.country_code, x.country_known) for x in named} == {"ALAND": ("AA", True), "x": (None, None)}


def test_lists_and_aliases(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# ids\nhttps://www.gbif.org/en/occurrence/12\n7\nhttps://api.gbif.org/v1/occurrence/12\ngbif.org/a/b/occurrence/99\n")
    assert [x.id for x in readers.read_input(spark, str(tmp_path / "ids.txt")).collect()] == ["12", "7"]
    (tmp_path / "images.txt").write_text("/a/b.jpg\n")
    assert readers.read_input(spark, str(tmp_path / "images.txt")).columns == ["path", "pos"]
    df = spark.createDataFrame([('{"recordedBy": "A", "collector": "B"}',), ('{"collector": "B", "recordedBy": "A"}',)], "j string").select(F.from_json("j", "map<string,string>").alias("core"))
    assert [x.recordedBy for x in readers.core_columns(df).collect()] == ["B", "A"]


def test_categories_and_tallies(spark):
    labels = spark.createDataFrame([(x,) for x in ("VALIDATION_DATEIDENTIFIED_STANDARD", "VALIDATION_EVENTDATE_STANDARD", "VALIDATION_CLASSIFICATION_CONSISTENT", "VALIDATION_MINELEVATION_INRANGE", "VALIDATION_TYPESTATUS_STANDARD")], "t string")
    assert [tuple(x.c) for x in labels.select(checks.category(F.col("t")).alias("c")).collect()] == [(0, "Identification"), (1, "Date of collection"), (5, "Other"), (4, "Location, coordinates and elevation"), (2, "Type status")]
    rows = [("a", "1964-02-30", "Holo.", "1_000"), ("b", "1964-02", "Isotype", "10"), ("c", "", "", None), ("d", "2020-01-05/07", "x", "0")]
    df = spark.createDataFrame(rows, "id string, eventDate string, typeStatus string, decimalLatitude string")
    wanted = ["VALIDATION_EVENTDATE_STANDARD", "MEASURE_EVENTDATE_DURATIONINSECONDS", "AMENDMENT_TYPESTATUS_STANDARDIZED", "VALIDATION_DECIMALLATITUDE_INRANGE"]
    one = sorted(map(tuple, checks.tally(df, "2026-01-01", wanted).collect()))
    two = sorted(map(tuple, checks.by_test(checks.evaluate(df, "id", "2026-01-01", wanted)).select("position", "test", "n_passed", "n_failed", "n_proposed", "n_unchanged", "n_not_run").collect()))
    assert one == two and one[0][2:4] == (1, 2)
    seconds = {x.id: x.result for x in checks.evaluate(df, "id", "2026-01-01", ["MEASURE_EVENTDATE_DURATIONINSECONDS"]).collect()}
    assert seconds["d"] == str(3 * 86_400) and seconds["b"] == str(29 * 86_400)


def test_records_are_pivoted_and_summed_within_themselves(spark):
    """What the rows of all tests roll up to comes out of the record itself, without a row for each test."""
    rows = [("a", "1964-02-30", "Holo.", "1_000"), ("b", "1964-02", "Isotype", "10"), ("c", "", "", None), ("d", "2020-01-05/07", "x", "0")]
    df = spark.createDataFrame(rows, "id string, eventDate string, typeStatus string, decimalLatitude string")
    wanted = ["VALIDATION_EVENTDATE_STANDARD", "MEASURE_EVENTDATE_DURATIONINSECONDS", "AMENDMENT_TYPESTATUS_STANDARDIZED", "VALIDATION_DECIMALLATITUDE_INRANGE"]
    long, wide = checks.evaluate(df, "id", "2026-01-01", wanted), checks.wide(df, "id", "2026-01-01", wanted)
    assert wide.dtypes == checks.pivot(long, "id", wanted).dtypes and sorted(map(tuple, wide.collect())) == sorted(map(tuple, checks.pivot(long, "id", wanted).collect()))
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    short = checks.summary(df, "id", "2026-01-01", wanted)
    assert short.dtypes == checks.headline(long, "id").dtypes and short.collect() == checks.headline(long, "id").collect()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_outcomes_are_columns_before_they_become_rows(spark):
    from voucherlens.operators import checks

    df = spark.createDataFrame([(1, "1998-02-03", "12.5", "Epi.")], "id int, eventDate string, decimalLatitude string, typeStatus string")
    labels = ["VALIDATION_EVENTDATE_STANDARD", "VALIDATION_DECIMALLATITUDE_INRANGE", "AMENDMENT_TYPESTATUS_STANDARDIZED"]
    # an array inside explode would be interpreted
    assert "explode(array(" not in _optimized(checks.evaluate(df, "id", "2026-01-01", labels))
    # records are counted before their outcomes are taken apart
    lines = _optimized(checks.tally(df, "2026-01-01", labels)).splitlines()
    generate = next(i for i, x in enumerate(lines) if "Generate" in x)
    assert any("Aggregate" in x for x in lines[generate:])


def test_a_places_numbers_are_read_before_it_becomes_rows(spark):
    from voucherlens.operators import lookups
    from voucherlens.plans.specimens import borders

    df = spark.createDataFrame([(1, "-50.5", "-170.25", "NF")], "id int, lat string, lon string, country_code string")
    plan = _optimized(lookups.places(df, "id", borders(spark)))
    assert not [x for x in plan.splitlines() if "Filter" in x and "RLIKE" in x]
