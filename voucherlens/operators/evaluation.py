"""One evaluation of transcriptions: truth from three JSON documents or an annotation, all fields scored in the row, frames and totals from one written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from voucherlens.functions import geo, jsontext, text
from voucherlens.operators import lookups, names, scoring
from voucherlens.sources.readers import CORE
from voucherlens.sources.shared import written

TRUTH = ["scientificName", "genus", "specificEpithet", "recordedBy", "eventDate", "catalogNumber", "country", "stateProvince", "locality", "decimalLatitude", "decimalLongitude", "verbatim"]
#: names that a coordinate may have in a transcription, the first that says something counts
LATITUDES, LONGITUDES = ["decimalLatitude", "latitude", "lat"], ["decimalLongitude", "longitude", "lon"]
_NA = "N/A"


def _top(doc: Column, key: str) -> Column:
    """A value at the top of a JSON document; null if it says nothing."""
    return F.nullif(F.get_json_object(doc, f"$.{key}"), F.lit(""))


def truth_from_documents(documents: DataFrame) -> DataFrame:
    """(key, occurrenceID, gbif_id, truth_*) of (key, fragment, verbatim, occurrence): a record's three JSON texts.

    The date is eventDate, else verbatimEventDate, else what there is of year, month and day; the locality is the
    verbatim one wherever it is found. A record without an occurrence document is left out.
    """
    frag, verb, occ = map(F.col, ("fragment", "verbatim", "occurrence"))
    pick = lambda key: jsontext.pick_value(key, frag, verb, occ)
    parts = F.array_compact(F.array(*[F.nullif(_top(occ, x), F.lit("0")) for x in ("year", "month", "day")]))
    date = F.coalesce(_top(occ, "eventDate"), _top(occ, "verbatimEventDate"), F.nullif(F.array_join(parts, "-"), F.lit("")), F.lit(_NA))
    place = text.let(pick("verbatimLocality"), lambda v: F.when(v == _NA, pick("locality")).otherwise(v))
    picked = {"genus": pick("genus"), "specificEpithet": pick("specificEpithet"), "eventDate": date, "locality": place, "verbatim": F.coalesce(verb, F.lit(""))}
    fields = [picked.get(f, F.coalesce(_top(occ, f), F.lit(_NA))).alias(f"truth_{f}") for f in TRUTH]
    own_id = F.coalesce(_top(occ, "gbifID"), _top(occ, "key"), F.col("key").cast("string"))
    return documents.where(occ.isNotNull()).select("key", F.get_json_object(occ, "$.occurrenceID").alias("occurrenceID"), own_id.alias("truth_gbif_id"), *fields)


def truth_from_annotations(annotations: DataFrame) -> DataFrame:
    """(annotation_id, truth_*) of annotations with fields; what a field map lacks is N/A."""
    said = lambda f: F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit(_NA))
    fields = [(F.lit("manual annotation") if f == "verbatim" else said(f)).alias(f"truth_{f}") for f in TRUTH]
    return annotations.where(F.size("fields") > 0).select("annotation_id", F.lit(None).cast("string").alias("truth_gbif_id"), *fields)


def with_derived_parts(df: DataFrame) -> DataFrame:
    """Genus and epithet of the truth as its scientific name has them, where that and not its own part agrees with the transcription."""
    words = F.split(text.strip_authors(F.col("truth_scientificName")), " ")
    for i, part in enumerate(("genus", "specificEpithet")):
        own, found, derived = text.strip_authors(F.col(f"truth_{part}")), text.strip_authors(F.col(part)), F.get(words, i)
        df = df.withColumn(f"truth_{part}", F.when((F.size(words) >= 2) & (own != found) & (derived == found), derived).otherwise(F.col(f"truth_{part}")))
    return df


def first_said(df: DataFrame, columns: list[str]) -> Column:
    """The first of the columns, as far as there are such, with a value."""
    values = [F.trim(F.col(c).cast("string")) for c in columns if c in df.columns]
    return F.coalesce(*[F.when(~F.lower(v).isin(text.VALID_NULLS), v) for v in values], F.lit(None).cast("string"))


def evaluated(
    transcriptions: DataFrame, truth: DataFrame, annotations: DataFrame, labels: DataFrame | None = None, backbone: DataFrame | None = None,
    usages: DataFrame | None = None, known: DataFrame | None = None, borders: DataFrame | None = None, fields: dict[str, str] | None = None, id_col: str = "specimen_id",
) -> DataFrame:
    """`transcriptions` with truth_*, truth_source, status, results and accuracy: a row each, nothing exploded.

    `truth` and `annotations`: as the two functions above make them; the truth is found by key, else occurrence id, else
    annotation (then places are scored strictly). `labels`: (id, label) texts that may settle a disagreement. `backbone`
    and `usages` (an authority's) relate names to each other, `known` names give the nearest, `borders` country codes.
    results: array of (field, truth, found, score, method, note), coordinates last; empty for an unmatched row. accuracy:
    the mean of the scores that count, 0 if none does, null for an unmatched row.
    """
    fields = fields or scoring.FIELDS
    rows = lookups.attach_truth(transcriptions, truth, annotations, id_col)
    rows = rows.withColumns({"decimalLatitude": first_said(rows, LATITUDES), "decimalLongitude": first_said(rows, LONGITUDES)})
    if "genus" in fields:
        rows = with_derived_parts(rows)
    strict = F.coalesce(F.col("truth_source") == "annotation", F.lit(False))
    options: dict[str, dict[str, Column]] = {"strict": {f: strict for f, kind in fields.items() if kind == "geo"}}
    if labels is not None:
        rows = rows.join(labels.select(F.col("id").cast("string").alias("label_id"), F.col("label").alias("label_text")), F.col(id_col).cast("string") == F.col("label_id"), "left").drop("label_id")
        options["label"] = {f: F.col("label_text") for f in fields}
    if borders is not None and "country" in fields:
        for side in ("truth_country", "country"):
            rows = lookups.country_codes(rows, side, borders, f"{side}_code").drop("country_known")
        options["codes"] = {"country": (F.col("truth_country_code"), F.col("country_code"))}
    if "scientificName" in fields and (backbone is not None or usages is not None):
        rows, notes = _relations(rows, backbone, usages)
        options["relation"] = {"scientificName": F.coalesce(*notes)}
    rows = scoring.score_fields(rows, fields, **options)
    if known is not None and "scientificName" in fields:
        rows = names.with_nearest(rows, "scientificName", known)
        own = F.col("scientificName_score")
        rows = rows.withColumn("scientificName_score", F.when(own["method"] == "cer", own.withField("note", F.col("nearest_note"))).otherwise(own))
    sides = ("truth_decimalLatitude", "truth_decimalLongitude", "decimalLatitude", "decimalLongitude")
    rows = rows.withColumn("coordinates_score", scoring.score_coordinates(*map(F.col, sides)))
    pair = lambda a, b: F.concat_ws(", ", F.format_string("%.5f", geo.number(F.col(a))), F.format_string("%.5f", geo.number(F.col(b))))
    item = lambda f, t, e, s: F.struct(F.lit(f).alias("field"), t.cast("string").alias("truth"), e.cast("string").alias("found"), s["score"].alias("score"), s["method"].alias("method"), s["note"].alias("note"))
    items = [item(f, F.col(f"truth_{f}"), F.col(f), F.col(f"{f}_score")) for f in fields]
    items.append(item("coordinates", pair(*sides[:2]), F.concat_ws(", ", *sides[2:]), F.col("coordinates_score")))
    matched = F.col("truth_source").isNotNull()
    none = F.array().cast("array<struct<field:string,truth:string,found:string,score:double,method:string,note:string>>")
    rows = rows.withColumn("results", F.when(matched, F.array(*items)).otherwise(none)).drop(*[f"{f}_score" for f in [*fields, "coordinates"]])
    counted = F.filter(F.transform("results", lambda x: x["score"]), lambda s: s.isNotNull())
    mean = text.let(counted, lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, s: a + s) / F.size(c)).otherwise(0.0))
    return rows.withColumn("status", F.when(matched, "matched").otherwise("unmatched")).withColumn("accuracy", F.when(matched, mean))


def _relations(rows: DataFrame, backbone: DataFrame | None, usages: DataFrame | None) -> tuple[DataFrame, list[Column]]:
    """Rows with what an authority and a backbone say of their two names, and the notes of relations, the most trusted first."""
    notes = []
    if usages is not None:
        rows = names.authority_relation(rows, usages, "truth_scientificName", "scientificName").withColumnRenamed("relation", "authority_note")
        notes.append(F.col("authority_note"))
    found = text.strip_authors(F.col("scientificName"))
    said = F.concat_ws(" ", "truth_verbatim", "truth_scientificName")
    if backbone is not None:
        rows = lookups.match_names(rows, "truth_scientificName", backbone, "truth_match", "name", cleaned=True)
        rows = lookups.match_names(rows, "scientificName", backbone, "found_match", "name", cleaned=True)
        notes.append(lookups.name_relation(F.col("truth_match"), F.col("found_match"), said, found))
    else:
        notes.append(F.when((F.length(found) >= 2) & F.lower(said).contains(found), "GBIF"))
    return rows, notes


def in_order(df: DataFrame) -> DataFrame:
    """Matched rows by falling accuracy, then the unmatched; ties by id."""
    return df.orderBy(F.col("status"), F.desc("overall_score"), "filename")


def _terms(df: DataFrame, statuses: DataFrame | None, id_col: str, *more: Column) -> DataFrame:
    """filename, the terms as read, the name's taxonomic status, and more columns."""
    terms = [(F.trim(F.coalesce(F.col(t).cast("string"), F.lit(""))) if t in df.columns else F.lit("")).alias(t) for t in CORE]
    rows = df if statuses is None else df.join(statuses.select(F.col("name").alias("status_name"), "taxonomic"), F.trim("scientificName") == F.col("status_name"), "left")
    tax = lambda part: F.coalesce(F.col(f"taxonomic.{part}"), F.lit("")) if statuses is not None else F.lit("")
    own = F.col(id_col).cast("string").alias("filename")
    return rows.select(own, *terms, tax("status").alias("taxonomicStatus"), tax("accepted").alias("acceptedNameUsage"), tax("source").alias("nameAccordingTo"), *more)


def darwin_core(scored: DataFrame, statuses: DataFrame | None = None, id_col: str = "specimen_id") -> DataFrame:
    """The frame of one row a specimen: its terms as read, taxonomic status, gbifID, status, overall_score.

    `statuses`: (name, taxonomic struct(status, accepted, source)) by scientific name as read; without it these are empty.
    """
    return _terms(scored, statuses, id_col, F.coalesce("truth_gbif_id", F.col(id_col).cast("string")).alias("gbifID"), F.col("status"), F.round("accuracy", 4).alias("overall_score"))


def evaluation(scored: DataFrame, id_col: str = "specimen_id") -> DataFrame:
    """The frame of one row a specimen and field."""
    own = F.col(id_col).cast("string")
    # a plain explode would have the results worked out once more, to leave out rows without any
    rows = scored.select(own.alias("filename"), F.coalesce("truth_gbif_id", own).alias("gbifID"), F.explode_outer("results").alias("x")).where("x.field is not null")
    return rows.select("filename", "gbifID", "x.field", "x.truth", F.col("x.found").alias("ai"), F.round("x.score", 4).alias("score"), "x.method", F.substring_index("x.note", "||", -1).alias("note"))


def field_summary(scored: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Mean and count of each field's scores, in the fields' order; a mean of nothing is null."""
    fields = [*(fields or scoring.FIELDS), "coordinates"]
    sums = scored.select(F.explode_outer("results").alias("x")).where("x.field is not null").groupBy("x.field").agg(F.round(F.avg("x.score"), 4).alias("mean_accuracy"), F.count("x.score").alias("n_scored"))
    order = scored.sparkSession.createDataFrame(list(enumerate(fields)), "position int, field string")
    return order.join(sums, "field", "left").select("position", "field", "mean_accuracy", F.coalesce("n_scored", F.lit(0)).alias("n_scored"))


def totals(scored: DataFrame) -> list[Column]:
    """Sums of a run, to be taken by a query or observed while a table is written."""
    a = F.col("accuracy")
    cost = [F.sum(F.coalesce(F.col("cost_usd"), F.lit(0.0))).alias("cost_total"), F.avg(F.coalesce(F.col("cost_usd"), F.lit(0.0))).alias("cost_mean")] if "cost_usd" in scored.columns else []
    excluded = F.sum(F.size(F.filter("results", lambda x: x["method"] == scoring.SYNONYM))).cast("long")
    return [
        F.count(F.lit(1)).alias("n_specimens"), F.count(a).alias("n_matched"), F.count_if(a.isNull()).alias("n_unmatched"), F.coalesce(F.avg(a), F.lit(0.0)).alias("accuracy"),
        F.count_if(a >= 0.85).alias("n_high"), F.count_if((a >= 0.6) & (a < 0.85)).alias("n_middle"), F.count_if(a < 0.6).alias("n_low"), F.coalesce(excluded, F.lit(0).cast("long")).alias("n_synonyms"), *cost,
    ]


def evaluate(scored: DataFrame, statuses: DataFrame | None = None, fields: list[str] | None = None, id_col: str = "specimen_id") -> tuple[dict[str, DataFrame], dict]:
    """The frames of an evaluation and its totals: `scored` (of `evaluated`) is written once, and observed as it is.

    Frames: scored, darwin_core, evaluation, field_summary. They all read the written table; scores are worked out once.
    """
    seen = Observation("evaluation")
    table = written(scored.observe(seen, *totals(scored)), "scored")
    frames = {"scored": table, "darwin_core": darwin_core(table, statuses, id_col), "evaluation": evaluation(table, id_col), "field_summary": field_summary(table, fields)}
    return frames, seen.get


def without_reference(records: DataFrame, nearest: DataFrame | None = None, statuses: DataFrame | None = None, id_col: str = "specimen_id") -> DataFrame:
    """The frame of records without a truth: terms, taxonomic status, the nearest name and what the extraction took.

    `nearest`: (name, nearest, similarity) by the two words of a name; model, tokens and cost are columns of `records`, null where they aren't.
    """
    taken = {"model": "model", "inputTokens": "tokens_in", "outputTokens": "tokens_out", "costUSD": "cost_usd"}
    out = _terms(records, statuses, id_col, *[(F.col(c) if c in records.columns else F.lit(None).cast("string")).alias(n) for n, c in taken.items()])
    if nearest is None:
        return out
    found = nearest.select(F.col("name").alias("asked"), F.col("nearest").alias("gbifFuzzySuggestion"), F.round("similarity", 3).alias("gbifFuzzySimilarity"))
    return out.join(found, text.strip_authors(F.col("scientificName")) == F.col("asked"), "left").drop("asked")
