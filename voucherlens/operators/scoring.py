"""Field accuracy: how well a transcription agrees with its truth, field by field.

`score_fields` adds one struct(score, method, note) column per field; `long_results` turns them into rows. Reference
data that a field needs (country codes, name relations) are columns joined on before (see lookups).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.functions import dates, geo, labels, text
from voucherlens.sources.shared import written

#: field -> kind, in the order of reports
FIELDS = {
    "scientificName": "taxon", "genus": "epithet", "specificEpithet": "epithet", "recordedBy": "collector", "eventDate": "date",
    "catalogNumber": "text", "country": "geo", "stateProvince": "geo", "locality": "geo",
}
SYNONYM = "synonym-excluded"


def _say(score: Column | float | None, method: str, note: Column | str = "") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(score).cast("double").alias("score"), F.lit(method).alias("method"), lit(note).alias("note"))


def country_key(c: Column, code: Column | None) -> Column:
    """A country's code if one was joined on, else its name without punctuation, aliases resolved."""
    aliases = F.create_map(*[F.lit(x) for pair in text.COUNTRY_ALIASES.items() for x in pair])
    name = text.let(F.lower(F.trim(c)), lambda x: F.coalesce(F.try_element_at(aliases, x), x))
    name = F.regexp_replace(name, r"(?U)[^\w\s]", "")
    return name if code is None else F.coalesce(code, name)


def score_geo(t: Column, e: Column, strict: Column, codes: tuple[Column, Column] | None = None) -> Column:
    same = country_key(t, codes and codes[0]) == country_key(e, codes and codes[1])
    a, b = text.geo_words(t), text.geo_words(e)
    ratio = F.when(strict, text.token_pair_cer(a, b, by_truth=True)).otherwise(text.token_pair_cer(a, b, free_truth=True))
    return F.when(same, _say(1.0, "geo-hdx-match")).when(text.unspaced(t) == text.unspaced(e), _say(1.0, "geo-nospace-match")).otherwise(_say(ratio, "geo-cer-bag"))


def score_taxon(t: Column, e: Column, truth: Column, found: Column, epithet: bool, relation: Column | None, infraspecific: Column | None) -> Column:
    """`relation`: a note of lookups.name_relation, null if unrelated; `infraspecific`: the backbone confirms the found rank."""
    out = F.when(t == e, _say(1.0, "Taxon-Match", "Exact match"))
    if not epithet and relation is not None:
        other = text.strip_authors(truth) != text.strip_authors(found)
        out = out.when(other & relation.isNotNull(), _say(None, SYNONYM, relation))
    ranked = lambda c: F.arrays_overlap(F.split(c, " "), F.array(*map(F.lit, text.RANK_MARKERS)))
    if infraspecific is not None:
        out = out.when(ranked(e) & ~ranked(t) & F.coalesce(infraspecific, F.lit(False)), _say(1.0, "cer"))
    return out.otherwise(_say(text.cer(text.letters_only(t), text.letters_only(e), by_truth=True), "cer"))


def score_collector(t: Column, e: Column) -> Column:
    words = F.struct(text.collector_words(t).alias("a"), text.collector_words(e).alias("b"))
    return text.let(words, lambda w: F.when((F.size(w["a"]) > 0) & (F.size(w["b"]) > 0), _say(text.token_pair_cer(w["a"], w["b"], by_truth=True), "coll-cer")).otherwise(_say(text.cer(t, e), "cer")))


def score_field(kind: str, truth: Column, found: Column, strict: Column | None = None, codes: tuple[Column, Column] | None = None, relation: Column | None = None, infraspecific: Column | None = None, label: Column | None = None) -> Column:
    """struct(score, method, note) of one field; a null score isn't counted. `label`: the label's text, which may settle a disagreement."""
    strict = F.lit(False) if strict is None else strict
    if kind in ("taxon", "epithet"):
        truth, found = text.drop_placeholder(F.coalesce(truth, F.lit(""))), text.drop_placeholder(F.coalesce(found, F.lit("")))

    def score(v: Column) -> Column:
        return _score_clean(kind, v["t"], v["e"], truth, found, strict, codes, relation, infraspecific)

    out = text.let(F.struct(text.clean_text(truth).alias("t"), text.clean_text(found).alias("e")), score)
    if label is not None:
        out = text.let(out, lambda s: settle(s, kind, truth, found, label))
    return out


def _score_clean(kind: str, t: Column, e: Column, truth: Column, found: Column, strict: Column, codes, relation, infraspecific) -> Column:
    """The score by kind of two cleaned texts."""
    kinds: dict[str, Callable[[], Column]] = {
        "geo": lambda: score_geo(t, e, strict, codes),
        "taxon": lambda: score_taxon(t, e, truth, found, False, relation, infraspecific),
        "epithet": lambda: score_taxon(t, e, truth, found, True, None, None),
        "date": lambda: _say(dates.date_accuracy(truth, found), "date-eval"),
        "collector": lambda: score_collector(t, e),
        "text": lambda: _say(text.cer(t, e), "cer"),
    }
    missing = _say(None, "N/A") if kind == "geo" else kinds[kind]() if kind == "text" else _say(0.0, "missing")
    return F.when(t == "na", _say(None, "N/A")).when(e == "na", missing).otherwise(kinds[kind]())


def settle(scored: Column, kind: str, truth: Column, found: Column, label: Column) -> Column:
    """A score below 1 is put against the label's text: what the label supports counts as right.

    Dates: the score of what the label's best date supports, or that of the two dates. Other kinds: both sides or the
    found one word for word on the label count 1; only the true one, the likeness of the found words to it.
    """
    open_ = scored["score"].isNotNull() & (scored["score"] < 1) & text.present(label)
    if kind == "date":
        verdict = labels.resolve(truth, found, label)
        new = text.let(verdict, lambda v: F.coalesce(v["corrected"], dates.date_accuracy(truth, found)))
        return F.when(open_, _say(new, "cer-manual-text")).otherwise(scored)
    pool = text.label_words(label)
    a, b = text.label_words(truth), text.label_words(found)
    ours, theirs = text.all_words_in(b, pool), text.all_words_in(a, pool)
    plain = lambda c: F.array_remove(F.split(F.trim(F.regexp_replace(c, r"(?U)[^\w\s]", " ")), r"\s+"), "")
    words = text.geo_words if kind == "geo" else plain
    own = lambda c: F.filter(plain(text.clean_text(c)), lambda w: ~w.isin(text.COLLECTOR_NOISE)) if kind == "collector" else words(text.clean_text(c))
    new = F.when(ours, 1.0).when(theirs, text.token_pair_cer(own(truth), own(found)))
    return F.when(open_ & (ours | theirs), _say(new, "cer-manual-text")).otherwise(scored)


def score_coordinates(lat: Column, lon: Column, found_lat: Column, found_lon: Column, inferred: Column | None = None) -> Column:
    """The ninth field: coord-eval if both sides have real coordinates; only that counts."""
    figures = F.struct(*[geo.number(c).alias(n) for c, n in ((lat, "a"), (lon, "b"), (found_lat, "c"), (found_lon, "d"))])
    real = lambda a, b, x, y: geo.given(a, b) & ~F.coalesce((x == 0) & (y == 0), F.lit(False))
    read = text.let(figures, lambda p: F.struct(real(lat, lon, p["a"], p["b"]).alias("t"), real(found_lat, found_lon, p["c"], p["d"]).alias("e"), geo.haversine_km(p["a"], p["b"], p["c"], p["d"]).alias("km")))

    def told(x: Column) -> Column:
        out = F.when(x["t"] & x["e"], _say(geo.coordinate_score(x["km"]), "coord-eval", F.format_string("%.3f km", x["km"]))).when(x["t"], _say(None, "inferred-gbif"))
        if inferred is not None:
            out = out.when(inferred.isNotNull() & x["e"], _say(None, "geocoded-inferred"))
        return out.when(x["e"], _say(None, "ai-extracted-unref")).otherwise(_say(None, "N/A"))

    # the distance stands in every branch of the score: it is worked out once a row, not once a branch
    return text.let(read, told)


def exclude_parts(df: DataFrame) -> DataFrame:
    """Where the name was excluded as a synonym, genus and epithet are too, but a missing genus scores 0."""
    gone = F.col("scientificName_score.method") == SYNONYM
    for part in ("genus", "specificEpithet"):
        own = F.col(f"{part}_score")
        keep = (own["method"] == "missing") if part == "genus" else F.lit(False)
        df = df.withColumn(f"{part}_score", F.when(gone & ~keep, _say(None, SYNONYM, F.col("scientificName_score.note"))).otherwise(own))
    return df


def score_fields(df: DataFrame, fields: dict[str, str] | None = None, **joined: dict[str, Column]) -> DataFrame:
    """`df` (truth_x and x columns) with x_score structs; keyword maps give field -> column for score_field's options."""
    fields = fields or FIELDS
    for f, kind in fields.items():
        options = {name: columns[f] for name, columns in joined.items() if f in columns}
        df = df.withColumn(f"{f}_score", score_field(kind, F.col(f"truth_{f}"), F.col(f), **options))
    if {"scientificName", "genus", "specificEpithet"} <= set(fields):
        df = exclude_parts(df)
    return df


def distinct_pairs(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(kind, truth, found): the distinct pairs of texts of each kind among the truth_x and x columns of `fields`; written."""
    items = [F.struct(F.lit(kind).alias("kind"), F.col(f"truth_{f}").cast("string").alias("truth"), F.col(f).cast("string").alias("found")) for f, kind in fields.items()]
    return written(df.select(F.inline(F.array(*items))).distinct(), "pairs")


def score_pairs(pairs: DataFrame, **joined: dict[str, Column]) -> DataFrame:
    """`pairs` (kind, truth, found) with their score structs; written. Keyword maps give kind -> column of `pairs` for score_field's options."""
    kinds = list(dict.fromkeys(FIELDS.values()))
    options = lambda kind: {name: columns[kind] for name, columns in joined.items() if kind in columns}
    scores = [F.when(F.col("kind") == kind, score_field(kind, F.col("truth"), F.col("found"), **options(kind))) for kind in kinds]
    return written(pairs.select("kind", "truth", "found", F.coalesce(*scores).alias("score")), "scores")


def join_scores(df: DataFrame, fields: dict[str, str], scores: DataFrame) -> DataFrame:
    """`df` with x_score of `fields` by their pair of texts; of few pairs, Spark sends the table to every task."""
    for f, kind in fields.items():
        own = scores.where(F.col("kind") == kind).select(F.col("truth").alias("pair_truth"), F.col("found").alias("pair_found"), F.col("score").alias(f"{f}_score"))
        same = F.col(f"truth_{f}").cast("string").eqNullSafe(F.col("pair_truth")) & F.col(f).cast("string").eqNullSafe(F.col("pair_found"))
        df = df.join(own, same, "left").drop("pair_truth", "pair_found")
    return df


def long_results(df: DataFrame, id_col: str, fields: list[str] | None = None) -> DataFrame:
    """(id, position, field, truth, found, score, method, note), coordinates last if they were scored."""
    fields = fields or list(FIELDS)
    items = [F.struct(F.lit(i).alias("position"), F.lit(f).alias("field"), F.col(f"truth_{f}").cast("string").alias("truth"), F.col(f).cast("string").alias("found"), F.col(f"{f}_score").alias("s")) for i, f in enumerate(fields)]
    if "coordinates_score" in df.columns:
        pair = lambda a, b: F.concat_ws(", ", F.format_string("%.5f", geo.number(F.col(a))), F.format_string("%.5f", geo.number(F.col(b))))
        items.append(F.struct(F.lit(len(fields)).alias("position"), F.lit("coordinates").alias("field"), pair("truth_decimalLatitude", "truth_decimalLongitude").alias("truth"), pair("decimalLatitude", "decimalLongitude").alias("found"), F.col("coordinates_score").alias("s")))
    rows = df.select(id_col, F.explode(F.array(*items)).alias("x"))
    return rows.select(id_col, "x.position", "x.field", "x.truth", "x.found", "x.s.score", "x.s.method", "x.s.note")
