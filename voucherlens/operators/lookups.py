"""Joins to reference tables: truth, names, places. Lookups run once per distinct value; small tables are left to Spark's own size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.functions import geo, text


def attach_truth(specimens: DataFrame, occurrences: DataFrame, annotations: DataFrame, id_col: str = "specimen_id") -> DataFrame:
    """Truth by numeric key, else by occurrence id (first record), else by annotation; truth_source says which, null if none.

    `occurrences`: key, occurrenceID, truth_* columns; `annotations`: annotation_id and the same truth_* columns.
    """
    fields = [c for c in occurrences.columns if c.startswith("truth_")]
    # columns, not structs, so that a field that nobody reads isn't made
    by_key = occurrences.select(F.col("key").cast("string").alias("k"), F.lit(True).alias("by_key"), *[F.col(f).alias(f"key_{f}") for f in fields])
    # a record without an occurrence id is found by none: all of these would meet in one group
    by_id = occurrences.where("occurrenceID is not null").groupBy(F.col("occurrenceID").alias("o")).agg(F.min_by(F.struct(*fields), "key").alias("by_id"))
    notes = annotations.select(F.col("annotation_id").alias("a"), F.lit(True).alias("by_note"), *[F.col(f).alias(f"note_{f}") for f in fields])
    own = F.col(id_col).cast("string")
    rows = specimens.join(by_key, own == F.col("k"), "left").join(by_id, own == F.col("o"), "left").join(notes, own == F.col("a"), "left")
    source = F.when(F.col("by_key").isNotNull(), "key").when(F.col("by_id").isNotNull(), "occurrenceID").when(F.col("by_note").isNotNull(), "annotation")
    best = lambda f: F.when(F.col("by_key").isNotNull(), F.col(f"key_{f}")).when(F.col("by_id").isNotNull(), F.col(f"by_id.{f}")).otherwise(F.col(f"note_{f}"))
    return rows.select(*specimens.columns, *[best(f).alias(f) for f in fields], source.alias("truth_source"))


def pick(*candidates: Column) -> Column:
    """The first candidate that says something, else N/A."""
    return F.coalesce(*[F.when(~F.lower(F.trim(c.cast("string"))).isin(text.VALID_NULLS), c.cast("string")) for c in candidates], F.lit("N/A"))


def deep_values(doc: Column, key: str) -> Column:
    """All values of a key at any depth of a JSON text, in document order."""
    return F.regexp_extract_all(doc, F.lit(rf'"{key}"\s*:\s*"?([^",}}\]]*)'), 1)


def match_names(df: DataFrame, names: str, backbone: DataFrame, joined: str, rank: str | None = None, cleaned: bool = False) -> DataFrame:
    """`df` with the backbone's answer for a name column as the struct `joined` (null where it has none)."""
    answers = backbone if rank is None else backbone.where(F.col("params") == rank)
    answers = answers.groupBy("query").agg(F.min(F.struct(*[c for c in backbone.columns if c not in ("query", "params")])).alias(joined))
    key = F.coalesce(F.nullif(text.strip_authors(F.col(names)), F.lit("")), F.trim(names)) if cleaned else F.trim(names)
    return df.join(answers.withColumnRenamed("query", f"{joined}_query"), key == F.col(f"{joined}_query"), "left").drop(f"{joined}_query")


def name_relation(truth: Column, found: Column, verbatim: Column, found_name: Column) -> Column:
    """The note of a relation between two names by their backbone answers, in order of trust, or null.

    The found name must match exactly. Equal accepted keys: GBIFbb and its variants; found in the verbatim record: GBIF;
    the same family only: NOREL.
    """
    key = lambda m: F.coalesce(m["acceptedUsageKey"], m["usageKey"])
    exact, t_syn, f_syn = found["matchType"] == "EXACT", truth["status"] == "SYNONYM", found["status"] == "SYNONYM"
    backbone = F.when(t_syn & f_syn, "GBIFbb-sib").when(t_syn, "GBIFbb-rev").when(f_syn, "GBIFbb").otherwise("GBIFbb-eq")
    inside = (F.length(found_name) >= 2) & F.lower(verbatim).contains(found_name)
    return F.when(exact & (key(truth) == key(found)), backbone).when(inside, "GBIF").when(exact & (truth["family"] == found["family"]), "NOREL")


def path_relation(truth_path: Column, found_path: Column, truth_is_synonym: Column, found_is_accepted: Column) -> Column:
    """WFO-rev, WFO-sib, WFO or null, from two classification paths: equal, or one a prefix of the other by one step."""
    a, b = F.split(truth_path, r"\$?/"), F.split(found_path, r"\$?/")
    short = F.least(F.size(a), F.size(b))
    related = (F.abs(F.size(a) - F.size(b)) <= 1) & (F.slice(a, F.lit(1), short) == F.slice(b, F.lit(1), short))
    return F.when(truth_is_synonym & found_is_accepted, "WFO-rev").when(related, F.when(truth_is_synonym, "WFO-sib").otherwise("WFO"))


def nearest(df: DataFrame, id_col: str, name_col: str, candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, nearest, similarity): the most similar of a name's own candidates (query, candidate, pos), the first on a tie."""
    rows = df.select(id_col, F.col(name_col).alias("query")).join(candidates, "query")
    rows = rows.withColumn("similarity", text.cer(F.lower("query"), F.lower("candidate"))).where(F.col("similarity") >= least)
    best = rows.groupBy(id_col).agg(F.max_by(F.struct("candidate", "similarity"), F.struct("similarity", -F.col("pos"))).alias("best"))
    return best.select(id_col, F.col("best.candidate").alias("nearest"), F.round("best.similarity", 3).alias("similarity"))


def longest_prefix(df: DataFrame, id_col: str, name_col: str, usages: DataFrame) -> DataFrame:
    """(id, prefix, name, n): the longest word prefix of a name whose words all stand in its checklist hit (query, name)."""
    words = F.split(F.trim(F.lower(name_col)), r"\s+")
    rows = df.select(id_col, F.explode(F.transform(words, lambda _, i: F.struct((i + 1).alias("n"), F.array_join(F.slice(words, F.lit(1), i + 1), " ").alias("prefix")))).alias("p")).select(id_col, "p.*")
    rows = rows.join(usages.select(F.lower("query").alias("prefix"), "name"), "prefix")
    rows = rows.where(F.size(F.array_except(F.split("prefix", " "), F.split(F.lower("name"), r"\s+"))) == 0)
    return rows.groupBy(id_col).agg(F.max_by(F.struct("prefix", "name", "n"), "n").alias("x")).select(id_col, "x.*")


def first_hit(df: DataFrame, id_col: str, queries: Column, gazetteer: DataFrame) -> DataFrame:
    """(id, query, lat, lon): the first query of a cascade that the gazetteer knows."""
    rows = df.select(id_col, F.posexplode(queries).alias("pos", "query")).join(gazetteer, "query")
    return rows.groupBy(id_col).agg(F.min_by(F.struct("query", "lat", "lon"), "pos").alias("x")).select(id_col, "x.*")


def place_queries(locality: Column, county: Column, state: Column, country: Column) -> Column:
    """Queries from the most to the least specific; a locality's comma parts from the last to the first."""
    said = lambda c: F.when(~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(text.VALID_NULLS), F.trim(c))
    area = F.concat_ws(", ", said(county), said(state), said(country))
    parts = F.reverse(F.filter(F.split(F.coalesce(said(locality), F.lit("")), r"\s*,\s*"), lambda x: x != ""))
    queries = F.concat(F.array(F.concat_ws(", ", said(locality), area)), F.transform(parts, lambda x: F.concat_ws(", ", x, area)), F.array(area, F.concat_ws(", ", said(state), said(country)), said(country)))
    return F.array_distinct(F.filter(queries, lambda q: q.isNotNull() & (q != "")))


def country_codes(df: DataFrame, country: str, borders: DataFrame, out: str = "country_code") -> DataFrame:
    """`df` with the code of an exact country name (the first feature with a real code) and country_known."""
    names = borders.select("feature_pos", "iso_a2", F.explode("names").alias("n")).groupBy(F.lower(F.trim("n")).alias("country_name"))
    names = names.agg(F.min_by("iso_a2", F.when(F.col("iso_a2") != "-99", F.col("feature_pos"))).alias(out), F.lit(True).alias("country_known"))
    return df.join(names, F.lower(F.trim(country)) == F.col("country_name"), "left").drop("country_name")


def _cell(x: Column, y: Column) -> Column:
    """The one-degree cell of whole degrees, as one number."""
    return ((x + 180) * 1000 + y + 90).cast("long")


def gridded(borders: DataFrame, buffer: float = 0.0) -> DataFrame:
    """(feature_pos, iso_a2, cell, base, rays, edges): borders cut to one-degree cells, for an equi-join with points.

    `rays`: edges that a ray from the cell to the east may cross; `base`: how many it crosses wherever it starts there;
    `edges`: those within `buffer` degrees of the cell. A cell inside an area has no edges at all, so a point meets the
    few edges of its cell instead of a whole border.
    """
    point = F.col("ring")
    pairs = F.transform(F.slice(point, F.lit(2), F.greatest(F.size(point) - 1, F.lit(0))), lambda q, i: F.struct(F.get(point, i).alias("p"), q.alias("q")))
    lines = borders.select("feature_pos", "iso_a2", F.explode("rings").alias("ring")).select("feature_pos", "iso_a2", F.explode(pairs).alias("e"))
    # the upper end first, so that neighbours state their border alike
    up = F.struct(F.col("e.p.lat"), F.col("e.p.lon")) >= F.struct(F.col("e.q.lat"), F.col("e.q.lon"))
    ends = [F.when(up, F.col(f"e.{a}.{c}")).otherwise(F.col(f"e.{b}.{c}")).alias(n) for a, b, c, n in (("p", "q", "lon", "x1"), ("p", "q", "lat", "y1"), ("q", "p", "lon", "x2"), ("q", "p", "lat", "y2"))]
    lines = lines.select("feature_pos", "iso_a2", *ends)
    west = lines.groupBy("feature_pos").agg(F.floor(F.min(F.least("x1", "x2")) - buffer).alias("west"))
    lines = lines.join(west, "feature_pos").withColumn("left", F.least("x1", "x2")).withColumn("right", F.greatest("x1", "x2"))
    # a row for each cell from the area's west end, buffer included, to the edge's east end, over the edge's bands of latitude
    spread = F.explode(F.sequence(F.floor(F.col("y2") - buffer), F.floor(F.col("y1") + buffer)))
    rows = lines.withColumn("cy", spread).withColumn("cx", F.explode(F.sequence(F.col("west"), F.floor(F.col("right") + buffer))))
    cx, cy = F.col("cx"), F.col("cy")
    ray = (F.col("y1") > cy) & (F.col("y2") < cy + 1) & (F.col("right") >= cx) & (F.col("y1") != F.col("y2"))
    always = ray & (F.col("y1") >= cy + 1) & (F.col("y2") <= cy) & (F.col("left") >= cx + 1)
    close = (F.col("right") + buffer >= cx) & (F.col("left") - buffer <= cx + 1) & (F.col("y1") + buffer >= cy) & (F.col("y2") - buffer <= cy + 1)
    edge = F.struct("x1", "y1", "x2", "y2")
    cut = rows.groupBy("feature_pos", "iso_a2", _cell(cx, cy).alias("cell")).agg(
        F.count_if(always).alias("base"), F.collect_list(F.when(ray & ~always, edge)).alias("rays"), F.collect_list(F.when(close, edge)).alias("edges"),
    )
    return cut.where((F.col("base") % 2 == 1) | (F.size("rays") > 0) | (F.size("edges") > 0))


def places(df: DataFrame, id_col: str, borders: DataFrame, km: float = 3.0) -> DataFrame:
    """(id, place_near, place_better, place_code) of (id, lat, lon, country_code) texts.

    place_near: within `km` of the country named; place_better: the first of the swapped and sign-flipped forms that is;
    place_code: the one country that holds the point. Points meet borders by one-degree cell and code, not pairwise.
    """
    texts = df.select(id_col, "country_code", F.trim("lat").alias("lat"), F.trim("lon").alias("lon"))
    texts = texts.select("*", geo.flipped(F.col("lat")).alias("flat"), geo.flipped(F.col("lon")).alias("flon"))
    read = texts.select("*", *[geo.number(F.col(c)).alias(f"{c}_n") for c in ("lat", "lon", "flat", "flon")])

    def form(pos: int, la: str, lo: str) -> Column:
        y, x = F.col(f"{la}_n"), F.col(f"{lo}_n")
        return F.when((F.abs(y) <= 90) & (F.abs(x) <= 360), F.struct(F.lit(pos).alias("pos"), F.col(la).alias("la"), F.col(lo).alias("lo"), y.alias("y"), x.alias("x"), _cell(F.floor(x), F.floor(y)).alias("cell")))

    # numbers are read before a row becomes several: of what follows an explode, filters would read them over and over
    forms = F.when(F.col("country_code").isNull(), F.array(form(0, "lat", "lon"))).otherwise(F.array(form(0, "lat", "lon"), form(1, "lon", "lat"), form(2, "flat", "lon"), form(3, "lat", "flon"), form(4, "flat", "flon")))
    points = read.select(id_col, "country_code", F.when(F.col("lat_n").isNotNull() & F.col("lon_n").isNotNull(), forms).alias("forms"))
    points = points.select(id_col, "country_code", F.explode_outer("forms").alias("f")).where("f.pos is not null").select(id_col, "country_code", "f.*")
    own = F.col("iso_a2") == F.col("country_code")
    # other forms than the first are asked of the country named only
    met = points.join(gridded(borders, km / 111), "cell").where((F.col("pos") == 0) | own)
    met = met.withColumn("within", geo.inside_cell(F.col("x"), F.col("y"), F.col("base"), F.col("rays")))
    near = met.where(F.col("within") | geo.near_edge(F.col("x"), F.col("y"), F.col("edges"), km / 111))
    inside = F.when((F.col("pos") == 0) & (F.col("iso_a2") != "-99") & F.col("within"), F.col("iso_a2"))
    found = near.groupBy(id_col).agg(
        F.coalesce(F.bool_or(own & (F.col("pos") == 0)), F.lit(False)).alias("place_near"),
        F.min_by(F.concat(F.lit("dwc:decimalLatitude="), F.col("la"), F.lit("; dwc:decimalLongitude="), F.col("lo")), F.when(own & (F.col("pos") > 0), F.col("pos"))).alias("better"),
        F.min(inside).alias("lowest"), F.max(inside).alias("highest"), F.min(F.when(own & (F.col("pos") > 0), 1)).alias("any"),
    )
    return found.select(id_col, "place_near", F.when(F.col("any") == 1, F.col("better")).alias("place_better"), F.when(F.col("lowest") == F.col("highest"), F.col("lowest")).alias("place_code"))


def pending(images: DataFrame, done: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Images (stem) without a result of this model; all of them if forced."""
    return images if force else images.join(done.where(F.col("model") == model).select("stem").distinct(), "stem", "left_anti")


def batch_answers(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests (job, line_no, key) with their answers by key, else by line; those without have an error."""
    by_key = answers.where(F.col("key").isNotNull()).select("job", "key", F.struct("response", "error").alias("k"))
    by_line = answers.where(F.col("key").isNull()).select("job", "line_no", F.struct("response", "error").alias("l"))
    rows = requests.join(by_key, ["job", "key"], "left").join(by_line, ["job", "line_no"], "left")
    best = F.coalesce("k", "l")
    return rows.select("job", "line_no", "key", best["response"].alias("response"), F.coalesce(best["error"], F.when(best.isNull(), "missing from results")).alias("error"))


def last_wins(df: DataFrame, id_col: str, pos_col: str) -> DataFrame:
    """The last row of each id."""
    rest = [c for c in df.columns if c != id_col]
    return df.groupBy(id_col).agg(F.max_by(F.struct(*rest), pos_col).alias("x")).select(id_col, "x.*")
