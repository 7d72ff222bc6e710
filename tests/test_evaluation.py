import json

import pytest
from pyspark.sql import functions as F

from voucherlens.operators import evaluation, names

DOCUMENTS = "key long, fragment string, verbatim string, occurrence string"
NOTES = "annotation_id string, transcription string, fields map<string,string>"


def documents(spark, *rows):
    return spark.createDataFrame([(k, *[x if x is None or isinstance(x, str) else json.dumps(x) for x in docs]) for k, *docs in rows], DOCUMENTS)


def test_truth_from_documents(spark):
    rows = documents(
        spark, (1, {"a": {"genus": "Quercus"}}, {"x": [{"verbatimLocality": "by the lake"}]}, {"gbifID": "77", "eventDate": "1900-01-02", "scientificName": "Quercus robur", "locality": "lake", "decimalLatitude": 1.5, "occurrenceID": "B 1"}),
        (2, None, None, {"verbatimEventDate": "2 Jan 1900", "year": 1900, "genus": "Ficus", "locality": "town"}), (3, "{}", "{}", {"year": 1900, "day": 5}), (4, None, None, None), (5, None, None, {"key": 9, "eventDate": ""}),
    )
    got = {x.key: x for x in evaluation.truth_from_documents(rows).collect()}
    assert got.keys() == {1, 2, 3, 5}
    assert (got[1].truth_gbif_id, got[1].truth_genus, got[1].truth_locality, got[1].truth_decimalLatitude, got[1].occurrenceID) == ("77", "Quercus", "by the lake", "1.5", "B 1")
    assert (got[2].truth_eventDate, got[2].truth_genus, got[2].truth_locality, got[2].truth_gbif_id) == ("2 Jan 1900", "Ficus", "town", "2")
    assert got[3].truth_eventDate == "1900-5" and got[5].truth_eventDate == "N/A" and got[5].truth_gbif_id == "9" and got[3].truth_recordedBy == "N/A"


@pytest.fixture(scope="module")
def frames(spark):
    base = {"eventDate": "1900-01-02", "scientificName": "Quercus robur L.", "genus": "Quercus", "specificEpithet": "robur", "recordedBy": "Smith, J.", "country": "Germany", "locality": "Old Mill", "catalogNumber": "7", "stateProvince": "Hesse", "decimalLatitude": "10", "decimalLongitude": "20"}
    docs = documents(
        spark, (1, {}, {}, base), (2, {}, {}, base | {"scientificName": "Quercus pedunculata"}), (3, {}, {"old": {"name": "det. ficus alba 1901"}}, base), (4, {}, {}, base), (5, {}, {}, base | {"genus": "Brunneo-villosa", "scientificName": "Brunneovillosa alba"}),
    )
    said = {k: v for k, v in base.items() if k not in ("decimalLatitude", "decimalLongitude")}
    rows = [
        {"specimen_id": 1, **said, "lat": "10", "lon": "20", "cost_usd": 0.5},
        {"specimen_id": 2, **said, "scientificName": "Quercus robur", "cost_usd": 0.25},
        {"specimen_id": 3, **said, "scientificName": "Ficus alba"},
        {"specimen_id": 4, **said, "scientificName": "Quercus robor", "country": "Deutschland", "eventDate": "1901", "recordedBy": ""},
        {"specimen_id": 5, **said, "genus": "Brunneovillosa", "scientificName": "Brunneovillosa alba"},
        {"specimen_id": 6, **said, "locality": "Old", "stateProvince": ""},
        {"specimen_id": 8, **said},
    ]
    columns = ["specimen_id", *said, "lat", "lon", "cost_usd"]
    df = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"{c} {'long' if c == 'specimen_id' else 'double' if c == 'cost_usd' else 'string'}" for c in columns))
    df = df.withColumns({"decimalLatitude": F.lit(""), "decimalLongitude": F.lit("n/a")})
    notes = spark.createDataFrame([("6", None, {"locality": "Old Mill", "stateProvince": "Hesse"}), ("8", "text only", None), ("1", None, {"locality": "elsewhere"})], NOTES)
    labels = spark.createDataFrame([(4, "Quercus robor, Deutschland, 2 I 1901")], "id long, label string")
    usages = spark.createDataFrame([("quercus robur", "P/Fagaceae/Quercus/robur"), ("quercus pedunculata", "P/Fagaceae/Quercus/robur$Q. pedunculata")], "name string, placement string")
    ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]
    borders = spark.createDataFrame([(0, "DE", ["Germany", "Deutschland"], ring)], "feature_pos int, iso_a2 string, names array<string>, rings array<array<struct<lon:double,lat:double>>>")
    known = spark.createDataFrame([("quercus robur",)], "name string")
    scored = evaluation.evaluated(df, evaluation.truth_from_documents(docs), evaluation.truth_from_annotations(notes), labels, usages=usages, known=known, borders=borders)
    statuses = spark.createDataFrame([("Quercus robur", ("accepted", "quercus robur", "WFO"))], "name string, taxonomic struct<status:string,accepted:string,source:string>")
    return evaluation.evaluate(scored, statuses)


def test_evaluation_of_names_places_and_labels(frames):
    found = {(x.filename, x.field): x for x in frames[0]["evaluation"].collect()}
    assert found["1", "scientificName"].score == 1.0 and found["1", "coordinates"].method == "coord-eval" and found["1", "coordinates"].ai == "10, 20"
    assert (found["2", "scientificName"].method, found["2", "scientificName"].score, found["2", "genus"].method) == ("synonym-excluded", None, "synonym-excluded") and found["2", "scientificName"].note == "WFO-rev"
    assert found["3", "scientificName"].note == "GBIF" and found["3", "scientificName"].score is None
    assert found["4", "country"].score == 1.0 and found["4", "country"].method == "geo-hdx-match" and found["4", "recordedBy"].method == "missing"
    assert found["4", "scientificName"].score == 1.0 and found["4", "scientificName"].method == "cer-manual-text"
    assert found["5", "genus"].score == 1.0 and found["5", "genus"].truth == "brunneovillosa"
    assert found["6", "locality"].score == pytest.approx(3 / 7, abs=1e-4) and found["6", "stateProvince"].method == "N/A" and found["6", "eventDate"].method == "N/A"
    assert ("8", "genus") not in found


def test_frames_and_totals(frames):
    tables, seen = frames
    rows = evaluation.in_order(tables["darwin_core"]).collect()
    assert [x.status for x in rows] == ["matched"] * 6 + ["unmatched"] and rows[-1].filename == "8" and rows[-1].overall_score is None and rows[0].overall_score == 1.0
    assert [x.overall_score for x in rows[:-1]] == sorted((x.overall_score for x in rows[:-1]), reverse=True)
    by_id = {x.filename: x for x in rows}
    assert (by_id["2"].taxonomicStatus, by_id["2"].acceptedNameUsage, by_id["1"].taxonomicStatus, by_id["1"].decimalLatitude) == ("accepted", "quercus robur", "", "10")
    assert (seen["n_specimens"], seen["n_matched"], seen["n_unmatched"], seen["n_synonyms"], seen["cost_total"]) == (7, 6, 1, 6, 0.75)
    assert seen["accuracy"] == pytest.approx(sum(x.accuracy for x in tables["scored"].collect() if x.accuracy is not None) / 6)
    summary = [(x.field, x.mean_accuracy, x.n_scored) for x in tables["field_summary"].orderBy("position").collect()]
    assert [x[0] for x in summary][-1] == "coordinates" and summary[-1][2] == 1 and dict((a, c) for a, _, c in summary)["scientificName"] == 3


def test_empty_evaluation_and_frame_without_reference(spark):
    empty = spark.createDataFrame([], "specimen_id long, eventDate string, decimalLatitude string, decimalLongitude string")
    scored = evaluation.evaluated(empty, evaluation.truth_from_documents(documents(spark)), evaluation.truth_from_annotations(spark.createDataFrame([], NOTES)), fields={"eventDate": "date"})
    tables, seen = evaluation.evaluate(scored, fields=["eventDate"])
    assert tables["darwin_core"].collect() == [] and (seen["n_specimens"], seen["accuracy"]) == (0, 0.0)
    assert [(x.field, x.mean_accuracy, x.n_scored) for x in tables["field_summary"].orderBy("position").collect()] == [("eventDate", None, 0), ("coordinates", None, 0)]
    rows = spark.createDataFrame([(1, "Quercus robor", "m", 10, None), (2, None, "m", None, 0.5)], "specimen_id long, scientificName string, model string, tokens_in long, cost_usd double")
    near = names.nearest_names(rows.select(F.lower("scientificName").alias("name")), spark.createDataFrame([("quercus robur",)], "name string"))
    got = {x.filename: x for x in evaluation.without_reference(rows, near).collect()}
    assert (got["1"].gbifFuzzySuggestion, got["1"].gbifFuzzySimilarity, got["1"].inputTokens, got["2"].costUSD, got["2"].scientificName) == ("quercus robur", 0.923, 10, 0.5, "")


def test_only_the_truth_that_is_read_is_made(spark):
    """Documents without an occurrence id don't meet in one group, and a field that nobody reads isn't taken from its documents."""
    from voucherlens.operators import evaluation, lookups

    docs = spark.createDataFrame([(k, "{}", "{}", f'{{"gbifID": "g{k}", "genus": "Rosa", "eventDate": "1998-02-0{k}"}}') for k in (1, 2)] + [(3, "{}", "{}", '{"occurrenceID": "9", "eventDate": "1999"}')], "key int, fragment string, verbatim string, occurrence string")
    notes = evaluation.truth_from_annotations(spark.createDataFrame([("4", {"eventDate": "2001"})], "annotation_id string, fields map<string,string>"))
    rows = lookups.attach_truth(spark.createDataFrame([(i,) for i in (1, 2, 4, 5, 9)], "specimen_id int"), evaluation.truth_from_documents(docs), notes)
    got = rows.select("specimen_id", "truth_eventDate", "truth_source")
    assert sorted(map(tuple, got.collect())) == [(1, "1998-02-01", "key"), (2, "1998-02-02", "key"), (4, "2001", "annotation"), (5, None, None), (9, "1999", "occurrenceID")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull" in plan[plan.index("Aggregate") :]
    assert "genus" not in next(x for x in plan.splitlines() if "key_truth_eventDate" in x)
