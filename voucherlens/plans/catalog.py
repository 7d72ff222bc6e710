"""The registered queries of the record-audit operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherlens.functions import geo, intervals, labels, text
from voucherlens.operators import checks, lookups, rollup, scoring
from voucherlens.plans.specimens import backbone, borders, specimens, table

TODAY = "2026-01-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Specimens as DuckDB makes them; the frames of `specimens`, for the fields the SQL below needs.
_SPECIMENS = """
WITH base AS (SELECT o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS d, o.o_custkey AS ck, c.c_name AS nm, n.n_name AS nn, r.r_name AS rn, p.p_name AS pn,
 CAST(trunc(c.c_acctbal) AS INTEGER) AS el, ((o.o_custkey * 7919) % 18000) / 100.0::DOUBLE - 90 AS lat, ((o.o_custkey * 104729) % 36000) / 100.0::DOUBLE - 180 AS lon
 FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN part p ON o.o_orderkey % 200 = p.p_partkey AND p.p_partkey < 200),
rom AS (SELECT ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII'] AS r),
sp AS (SELECT k AS specimen_id, d, strftime(d, '%Y-%m-%d') AS truth_eventdate,
 CASE k % 8 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d + INTERVAL 1 DAY, '%Y-%m-%d') WHEN 2 THEN strftime(d, '%Y-%d-%m') WHEN 3 THEN strftime(d, '%Y-%m') WHEN 4 THEN strftime(d, '%Y') WHEN 5 THEN CAST(year(d) - 1 AS VARCHAR) WHEN 6 THEN '' ELSE day(d) || '.' || r[month(d)] || '.' || year(d) END AS eventdate,
 strftime(d + INTERVAL 1 DAY * (k % 900 - CASE WHEN k % 10 = 0 THEN 1000 ELSE 0 END), '%Y-%m-%d') AS dateidentified,
 nm, nn, rn, pn, el, el + CAST(k % 7 AS INTEGER) - 2 AS el2, round(lat, 3) AS tlat, round(lon, 3) AS tlon,
 CASE WHEN k % 8 = 7 THEN NULL WHEN k % 8 = 6 THEN round(lon, 3) ELSE round(lat + CASE k % 8 WHEN 1 THEN 0.001 WHEN 2 THEN 0.05 WHEN 3 THEN 0.3 WHEN 4 THEN 0.8 WHEN 5 THEN 2.0 ELSE 0 END, 3) END AS alat,
 CASE WHEN k % 8 = 7 THEN NULL WHEN k % 8 = 6 THEN round(lat, 3) ELSE round(lon, 3) END AS alon,
 CASE k % 4 WHEN 0 THEN nn WHEN 1 THEN replace(nn, '_', '') WHEN 2 THEN substr(nn, 1, 4) ELSE '' END AS country,
 CASE k % 5 WHEN 0 THEN 'Holotype' WHEN 1 THEN 'holotype' WHEN 2 THEN 'Epi.' WHEN 3 THEN 'Iso.' ELSE '' END AS typestatus,
 CASE WHEN k % 5 = 0 THEN '0' || k ELSE CAST(k AS VARCHAR) END AS catalognumber
 FROM base, rom)"""

_PARTS = """, ev AS (SELECT *, CASE WHEN eventdate = '' OR k8 = 7 THEN NULL ELSE CAST(substr(eventdate, 1, 4) AS INTEGER) END AS ay,
 CASE WHEN length(eventdate) >= 7 AND k8 <> 7 THEN CAST(substr(eventdate, 6, 2) AS INTEGER) END AS am, CASE WHEN length(eventdate) = 10 AND k8 <> 7 THEN CAST(substr(eventdate, 9, 2) AS INTEGER) END AS ad FROM (SELECT *, specimen_id % 8 AS k8 FROM sp)),
sc AS (SELECT *, CASE WHEN ay IS NULL OR ay <> year(d) THEN 0.0 WHEN am IS NULL THEN 0.5 WHEN am <> month(d) THEN CASE WHEN month(d) = ad AND day(d) = am THEN 0.9 ELSE 0.5 END WHEN ad IS NULL THEN 0.75 WHEN ad = day(d) THEN 1.0 WHEN abs(ad - day(d)) = 1 THEN 0.95 WHEN abs(ad - day(d)) <= 7 THEN 0.85 ELSE 0.75 END AS date_score,
 round(2 * 6371.0 * atan2(sqrt(pow(sin(radians(alat - tlat) / 2), 2) + cos(radians(tlat)) * cos(radians(alat)) * pow(sin(radians(alon - tlon) / 2), 2)), sqrt(greatest(0, 1 - (pow(sin(radians(alat - tlat) / 2), 2) + cos(radians(tlat)) * cos(radians(alat)) * pow(sin(radians(alon - tlon) / 2), 2))))), 3) AS km FROM ev),
res AS (SELECT specimen_id, date_score, CASE WHEN km IS NULL OR (tlat = 0 AND tlon = 0) OR (alat = 0 AND alon = 0) THEN NULL WHEN km < 1 THEN 1.0 WHEN km < 10 THEN 0.9 WHEN km < 50 THEN 0.3 WHEN km < 100 THEN 0.1 ELSE 0.0 END AS coord_score FROM sc)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that says what it returns."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event date and coordinates, the fields whose scores SQL can state."""
    df = scoring.score_fields(specimens(spark, sf_dir), {"eventDate": "date"})
    df = df.withColumn("coordinates_score", scoring.score_coordinates(*map(F.col, ("truth_decimalLatitude", "truth_decimalLongitude", "decimalLatitude", "decimalLongitude"))))
    return scoring.long_results(df, "specimen_id", ["eventDate"])


@query(_SPECIMENS + _PARTS + " SELECT field, round(avg(s), 4) AS mean_accuracy, count(s) AS n_scored FROM (SELECT 'eventDate' AS field, date_score AS s FROM res UNION ALL SELECT 'coordinates', coord_score FROM res) GROUP BY field")
def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.field_summary(_scored(spark, sf_dir), ["eventDate", "coordinates"]).select("field", F.round("mean_accuracy", 4).alias("mean_accuracy"), "n_scored")


@query(_SPECIMENS + _PARTS + " SELECT specimen_id, CAST(date_score AS DOUBLE) AS date_score, CAST(coord_score AS DOUBLE) AS coord_score FROM res")
def date_and_coordinate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return rows.groupBy("specimen_id").agg(F.max(F.when(F.col("field") == "eventDate", F.col("score"))).alias("date_score"), F.max(F.when(F.col("field") == "coordinates", F.col("score"))).alias("coord_score"))


@query(_SPECIMENS + _PARTS + ", m AS (SELECT specimen_id, CASE WHEN coord_score IS NULL THEN date_score ELSE (date_score + coord_score) / 2 END AS a FROM res) SELECT count(*) AS n_specimens, round(avg(a), 4) AS accuracy, count(*) FILTER (a >= 0.85) AS n_high, count(*) FILTER (a >= 0.6 AND a < 0.85) AS n_middle, count(*) FILTER (a < 0.6) AS n_low FROM m")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.run_summary(rollup.specimen_accuracy(_scored(spark, sf_dir), "specimen_id")).withColumn("accuracy", F.round("accuracy", 4))


@query()
def all_field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field by its own kind, collectors, places and taxa among them; names, dates and places, which many records share, once for each pair of texts."""
    df = specimens(spark, sf_dir)
    shared = {f: kind for f, kind in scoring.FIELDS.items() if kind in ("taxon", "epithet", "date", "geo")}
    pairs = scoring.distinct_pairs(df, shared)
    taxa = F.col("kind") == "taxon"
    names = backbone(pairs.where(taxa).withColumnRenamed("truth", "truth_scientificName"))
    named = lookups.match_names(pairs.where(taxa), "truth", names, "truth_match", "name", cleaned=True)
    named = lookups.match_names(named, "found", names, "found_match", "name", cleaned=True)
    relation = lookups.name_relation(F.col("truth_match"), F.col("found_match"), F.lit(""), text.strip_authors(F.col("found")))
    pairs = named.select("kind", "truth", "found", relation.alias("relation")).unionByName(pairs.where(~taxa), allowMissingColumns=True)
    df = scoring.join_scores(df, shared, scoring.score_pairs(pairs, relation={"taxon": F.col("relation")}))
    df = scoring.exclude_parts(scoring.score_fields(df, {f: kind for f, kind in scoring.FIELDS.items() if f not in shared}))
    df = df.withColumn("coordinates_score", scoring.score_coordinates(*map(F.col, ("truth_decimalLatitude", "truth_decimalLongitude", "decimalLatitude", "decimalLongitude"))))
    return scoring.long_results(df, "specimen_id").drop("note")


@query(_SPECIMENS + " SELECT specimen_id, CASE WHEN CAST(specimen_id AS VARCHAR) = catalognumber THEN 1.0 ELSE greatest(0.0, 1 - levenshtein(CAST(specimen_id AS VARCHAR), catalognumber) / greatest(length(CAST(specimen_id AS VARCHAR)), length(catalognumber))) END AS score FROM sp")
def catalog_number_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = specimens(spark, sf_dir)
    return df.select("specimen_id", scoring.score_field("text", F.col("truth_catalogNumber"), F.col("catalogNumber"))["score"].alias("score"))


@query()
def token_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy pairing of all words of each specimen's true and found name, place and collector; tests hold it against brute force."""
    df = specimens(spark, sf_dir)
    words = lambda prefix: text.geo_words(F.translate(F.concat_ws(" ", *[F.col(f"{prefix}{c}") for c in ("scientificName", "locality", "recordedBy")]), "_#", "  "))
    rows = df.select("specimen_id", words("truth_").alias("a"), words("").alias("b"))
    return rows.select("specimen_id", "a", "b", F.round(text.token_pair_cer(F.col("a"), F.col("b")), 6).alias("similarity"))


#: Tests whose outcome SQL states: status and result of each specimen.
_RUN = "'RUN_HAS_RESULT'"
_CHECK_SQL = {
    "VALIDATION_EVENTDATE_NOTEMPTY": ("TRUE", "eventdate <> ''"),
    "VALIDATION_EVENTTEMPORAL_NOTEMPTY": ("TRUE", "TRUE"),
    "VALIDATION_EVENTDATE_STANDARD": ("eventdate <> ''", "specimen_id % 8 <> 7 AND (length(eventdate) <> 10 OR try_cast(eventdate AS DATE) IS NOT NULL)"),
    "VALIDATION_EVENTDATE_INRANGE": ("eventdate <> '' AND specimen_id % 8 <> 7 AND (length(eventdate) <> 10 OR try_cast(eventdate AS DATE) IS NOT NULL)", "CAST(substr(eventdate, 1, 4) AS INTEGER) BETWEEN 1583 AND 2026"),
    "VALIDATION_DATEIDENTIFIED_STANDARD": ("TRUE", "TRUE"),
    "VALIDATION_COUNTRY_NOTEMPTY": ("TRUE", "country <> ''"),
    "VALIDATION_DECIMALLATITUDE_NOTEMPTY": ("TRUE", "specimen_id % 8 <> 7"),
    "VALIDATION_DECIMALLONGITUDE_NOTEMPTY": ("TRUE", "specimen_id % 8 <> 7"),
    "VALIDATION_DECIMALLATITUDE_INRANGE": ("specimen_id % 8 <> 7", "alat BETWEEN -90 AND 90"),
    "VALIDATION_DECIMALLONGITUDE_INRANGE": ("specimen_id % 8 <> 7", "alon BETWEEN -180 AND 180"),
    "VALIDATION_COORDINATES_NOTZERO": ("specimen_id % 8 <> 7", "NOT (alat = 0 AND alon = 0)"),
    "VALIDATION_MINELEVATION_INRANGE": ("TRUE", "el BETWEEN -430 AND 8850"),
    "VALIDATION_MAXELEVATION_INRANGE": ("TRUE", "el2 BETWEEN -430 AND 8850"),
    "VALIDATION_MINELEVATION_LESSTHAN_MAXELEVATION": ("TRUE", "el <= el2"),
    "VALIDATION_SCIENTIFICNAME_NOTEMPTY": ("TRUE", "TRUE"),
    "VALIDATION_TAXON_NOTEMPTY": ("TRUE", "TRUE"),
    "VALIDATION_LOCATION_NOTEMPTY": ("TRUE", "TRUE"),
    "VALIDATION_SCIENTIFICNAMEAUTHORSHIP_NOTEMPTY": ("TRUE", "FALSE"),
    "VALIDATION_TYPESTATUS_STANDARD": ("typestatus <> ''", "typestatus = 'Holotype'"),
}


def _check(label: str) -> None:
    ran, ok = _CHECK_SQL[label]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return checks.evaluate(checks.prepare(specimens(spark, sf_dir)), "specimen_id", TODAY, [label]).select("specimen_id", "test", "status", "result")

    run.__name__ = "check_" + label.removeprefix("VALIDATION_").lower()
    query(_SPECIMENS + f" SELECT specimen_id, '{label}' AS test, CASE WHEN {ran} THEN {_RUN} ELSE 'INTERNAL_PREREQUISITES_NOT_MET' END AS status, CASE WHEN NOT ({ran}) THEN '' WHEN {ok} THEN 'COMPLIANT' ELSE 'NOT_COMPLIANT' END AS result FROM sp")(run)


for _label in _CHECK_SQL:
    _check(_label)


@query(_SPECIMENS + " SELECT specimen_id, CASE WHEN typestatus = '' THEN 'INTERNAL_PREREQUISITES_NOT_MET' WHEN typestatus IN ('holotype', 'Epi.') THEN 'AMENDED' ELSE 'NOT_AMENDED' END AS status, CASE typestatus WHEN 'holotype' THEN 'dwc:typeStatus=Holotype' WHEN 'Epi.' THEN 'dwc:typeStatus=Epitype' ELSE '' END AS result FROM sp")
def amend_type_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.evaluate(specimens(spark, sf_dir), "specimen_id", TODAY, ["AMENDMENT_TYPESTATUS_STANDARDIZED"]).select("specimen_id", "status", "result")


@query(_SPECIMENS + " SELECT specimen_id, CASE WHEN ok THEN 'RUN_HAS_RESULT' ELSE 'INTERNAL_PREREQUISITES_NOT_MET' END AS status, CASE WHEN NOT ok THEN 'NOT_REPORTED' ELSE CAST(86400 * CASE length(eventdate) WHEN 4 THEN CASE WHEN (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 THEN 366 ELSE 365 END WHEN 7 THEN day(last_day(CAST(eventdate || '-01' AS DATE))) ELSE 1 END AS VARCHAR) END AS result FROM (SELECT *, eventdate <> '' AND specimen_id % 8 <> 7 AND (length(eventdate) <> 10 OR try_cast(eventdate AS DATE) IS NOT NULL) AS ok, try_cast(substr(eventdate, 1, 4) AS INTEGER) AS y FROM sp)")
def measure_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.evaluate(specimens(spark, sf_dir), "specimen_id", TODAY, ["MEASURE_EVENTDATE_DURATIONINSECONDS"]).select("specimen_id", "status", "result")


def _all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tests' outcomes, a row each."""
    return checks.evaluate(_test_ready(spark, sf_dir), "specimen_id", TODAY)


def _test_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specimens with borders, backbone and parsed verbatim dates joined on."""
    df = checks.prepare(specimens(spark, sf_dir))
    lines = borders(spark)
    df = lookups.country_codes(df, "country", lines)
    spots = lookups.places(df.select("specimen_id", F.col("decimalLatitude").alias("lat"), F.col("decimalLongitude").alias("lon"), "country_code"), "specimen_id", lines)
    names = backbone(df)
    # the dates come last: what places and names are made of doesn't meet them
    df = checks.with_verbatim_dates(df.join(spots, "specimen_id", "left"))
    df = lookups.match_names(df, "scientificName", names, "name_match", "name", cleaned=True)
    return lookups.match_names(df, "genus", names, "genus_match", "genus")


@query()
def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_checks(spark, sf_dir).drop("position", "comment")


@query()
def quality_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.wide(_test_ready(spark, sf_dir), "specimen_id", TODAY)


@query()
def quality_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.summary(_test_ready(spark, sf_dir), "specimen_id", TODAY)


@query()
def quality_by_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.tally(_test_ready(spark, sf_dir), TODAY)


@query(_SPECIMENS + """, g AS (SELECT specimen_id, tlon, tlat, CAST(floor((tlon + 180) / 72) AS INTEGER) AS i, CAST(least(floor((tlat + 90) / 36), 4) AS INTEGER) AS j FROM sp)
SELECT specimen_id, CASE WHEN tlon >= -180 + 72 * i AND tlon < -180 + 72 * i + 14 AND tlat >= -90 + 36 * j AND tlat < -54 + 36 * j AND NOT (5 * j + i = 7 AND tlon >= -180 + 72 * i + 4 AND tlon < -180 + 72 * i + 8 AND tlat >= -90 + 36 * j + 10 AND tlat < -90 + 36 * j + 20) THEN 'N' || chr(65 + 5 * j + i) END AS place_code
FROM g""")
def country_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country that holds each true point; a point on a border belongs to the area east and north of it."""
    df = specimens(spark, sf_dir).select("specimen_id", F.col("truth_decimalLatitude").alias("lat"), F.col("truth_decimalLongitude").alias("lon"), F.lit(None).cast("string").alias("country_code"))
    return df.select("specimen_id").join(lookups.places(df, "specimen_id", borders(spark)).select("specimen_id", "place_code"), "specimen_id", "left")


@query("""WITH o AS (SELECT c.c_name AS collector, n.n_name AS country, year(o.o_orderdate) AS year FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT collector, count(*) AS total, count(DISTINCT country) AS n_countries, count(DISTINCT year) AS n_years, min(year) AS first_year, max(year) AS last_year FROM o GROUP BY collector""")
def collector_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollup.collector_profiles(_occurrences(spark, sf_dir))
    years = F.map_keys("years")
    return found.select("collector", "total", F.size("countries").cast("long").alias("n_countries"), F.size("years").cast("long").alias("n_years"), F.array_min(years).cast("long").alias("first_year"), F.array_max(years).cast("long").alias("last_year"))


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_name").alias("collector"), F.col("n_name").alias("country"), F.year("o_orderdate").alias("year"))


@query("""WITH o AS (SELECT c.c_nationkey AS collector, year(o.o_orderdate) AS year FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
s AS (SELECT collector, list(year ORDER BY year) AS ys FROM o GROUP BY collector)
SELECT 'nation ' || collector AS collector, CAST(ys[1 + CAST(floor(0.05 * (len(ys) - 1)) AS INTEGER)] AS INTEGER) AS low, CAST(ys[1 + CAST(floor(0.95 * (len(ys) - 1)) AS INTEGER)] AS INTEGER) AS high FROM s""")
def trimmed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("nation "), F.col("c_nationkey")).alias("collector"), F.lit(None).cast("string").alias("country"), F.year("o_orderdate").alias("year"))
    found = rollup.collector_profiles(rows).withColumn("t", rollup.trimmed_years(F.col("years")))
    return found.select("collector", "t.low", "t.high")


@query("""WITH o AS (SELECT o.o_orderkey AS specimen_id, c.c_name AS collector, n.n_name AS country, CAST(year(CAST(o.o_orderdate AS DATE)) AS INTEGER) AS year FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
t AS (SELECT collector, count(*) AS total, list(year ORDER BY year) AS ys FROM o GROUP BY collector), cc AS (SELECT collector, country, count(*) AS n FROM o GROUP BY collector, country),
r AS (SELECT collector, total, ys[1 + CAST(floor(0.05 * (len(ys) - 1)) AS INTEGER)] AS low, ys[1 + CAST(floor(0.95 * (len(ys) - 1)) AS INTEGER)] AS high FROM t)
SELECT o.collector, o.specimen_id, o.country, o.year, r.total, CASE WHEN r.total < 5 THEN 'unknown' WHEN o.year < low - 5 OR o.year > high + 5 THEN 'year' ELSE 'ok' END AS verdict, cc.n AS in_country FROM o JOIN r ON r.collector = o.collector JOIN cc ON cc.collector = o.collector AND cc.country = o.country""")
def collector_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = specimens(spark, sf_dir).select("specimen_id", F.col("truth_recordedBy").alias("collector"), F.col("truth_country").alias("country"), F.year(F.col("truth_eventDate").cast("date")).alias("year"))
    return rollup.collector_verdicts(df, rollup.collector_profiles(_occurrences(spark, sf_dir)), min_records=5)


_RUNS = """WITH r AS (SELECT l_returnflag || l_linestatus || (l_linenumber % 4) AS model, 1000000 AS n_images, CASE WHEN l_discount > 0.01 THEN round(1 - l_discount * 5, 4) END AS accuracy, l_extendedprice / 1e6 AS cost_usd, CAST(l_quantity AS BIGINT) AS tokens_in, CAST(l_partkey AS BIGINT) AS tokens_out, CASE WHEN l_linenumber > 2 THEN CAST(l_suppkey AS BIGINT) END AS tokens_thinking, CASE WHEN l_tax > 0.04 THEN l_tax END AS seconds FROM lineitem)"""
_SUMMARY = _RUNS + """, m AS (SELECT model, count(*) AS n_extracted, greatest(0, max(n_images) - count(*)) AS n_failed, count(accuracy) AS n_scored, round(avg(accuracy) * 100, 4) AS accuracy, round(avg(cost_usd) * 1000, 4) AS cost_per_1000, round(avg(tokens_in), 4) AS tokens_in_avg, round(avg(tokens_out), 4) AS tokens_out_avg, round(avg(tokens_thinking), 4) AS tokens_thinking_avg, round(avg(seconds), 4) AS sec_per_specimen, count(seconds) AS n_timed FROM r GROUP BY model)"""


def _model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 4).cast("string")).alias("model"), F.lit(1_000_000).cast("long").alias("n_images"),
        F.when(F.col("l_discount") > 0.01, F.round(1 - F.col("l_discount") * 5, 4)).alias("accuracy"), (F.col("l_extendedprice") / 1e6).alias("cost_usd"), F.col("l_quantity").cast("long").alias("tokens_in"),
        F.col("l_partkey").alias("tokens_out"), F.when(F.col("l_linenumber") > 2, F.col("l_suppkey")).alias("tokens_thinking"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("seconds"), F.lit(None).cast("double").alias("wall_s"),
    )


def _rounded_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rollup.model_summary(_model_runs(spark, sf_dir))
    return df.select("model", "n_extracted", "n_failed", "n_scored", *[F.round(c, 4).alias(c) for c in ("accuracy", "cost_per_1000", "tokens_in_avg", "tokens_out_avg", "tokens_thinking_avg", "sec_per_specimen")], "n_timed")


@query(_SUMMARY + " SELECT * FROM m")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_summary(spark, sf_dir)


@query(_SUMMARY + " SELECT model, accuracy, cost_per_1000 FROM (SELECT *, coalesce(max(accuracy) OVER (ORDER BY cost_per_1000, accuracy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best FROM m) WHERE accuracy > best")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.pareto(_rounded_summary(spark, sf_dir)).select("model", "accuracy", "cost_per_1000")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE round((l_quantity * 1000 * 0.15 + l_partkey * 1000 * 0.6) / 1e6 * CASE WHEN l_linestatus = 'F' THEN 0.5 ELSE 1.0 END, 6) END AS cost_usd FROM lineitem")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("m", 0.15, 0.6)], "model string, in_per_m double, out_per_m double")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("m").alias("model"), (F.col("l_quantity") * 1000).alias("tokens_in"), (F.col("l_partkey") * 1000).alias("tokens_out"), (F.col("l_linestatus") == "F").alias("is_batch"), (F.col("l_returnflag") == "N").alias("is_local"))
    return rollup.cost(rows, prices).select("l_orderkey", "l_linenumber", "l_partkey", "cost_usd")


@query("""SELECT o_orderkey AS specimen_id, CASE WHEN o_orderkey % 3 = 0 THEN 'key' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'occurrenceID' WHEN o_orderkey % 5 = 0 THEN 'annotation' END AS truth_source, CASE WHEN o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0) OR o_orderkey % 5 = 0 THEN o_orderstatus END AS truth_country FROM orders""")
def truth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth by key, else occurrence id, else annotation."""
    orders = table(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus").alias("truth_country")
    occurrences = orders.where("o_orderkey % 3 = 0").select(key.alias("key"), F.lit(None).cast("string").alias("occurrenceID"), status)
    occurrences = occurrences.unionByName(orders.where("o_orderkey % 3 = 1 and o_orderkey % 2 = 0").select((-key - 1).alias("key"), key.cast("string").alias("occurrenceID"), status))
    annotations = orders.where("o_orderkey % 5 = 0").select(key.cast("string").alias("annotation_id"), status)
    return lookups.attach_truth(orders.select(key.alias("specimen_id")), occurrences, annotations)


@query("SELECT o_orderkey AS stem FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0)")
def pending_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stem"), "o_orderstatus")
    done = orders.where("o_orderstatus = 'F'").select("stem", F.when(F.col("stem") % 2 == 0, "a").otherwise("b").alias("model"))
    return lookups.pending(orders.select("stem"), done, "a")


@query("SELECT o_custkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return lookups.last_wins(df, "o_custkey", "o_orderkey").drop("o_orderkey")


@query(_SPECIMENS + " SELECT specimen_id, CAST((eventdate <> '')::INT + (country <> '')::INT + (typestatus <> '')::INT + (specimen_id % 8 <> 7)::INT AS INTEGER) AS fields_extracted, round(100 * ((eventdate <> '')::INT + (country <> '')::INT + (typestatus <> '')::INT + (specimen_id % 8 <> 7)::INT) / 4, 1) AS field_completeness_pct FROM sp")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.completeness(specimens(spark, sf_dir), ["eventDate", "country", "typeStatus", "decimalLatitude"]).select("specimen_id", "fields_extracted", "field_completeness_pct")


@query("SELECT event_type, window_start, n, failed FROM (SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) FILTER (value < 10) AS failed FROM events GROUP BY 1, 2)")
def check_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly failures of a range check: the batch form of the streaming query."""
    from voucherlens.streaming.windows import failures_by_window

    return failures_by_window(table(spark, sf_dir, "events"), 10.0, watermark=None)


@query(_SPECIMENS + """, v AS (SELECT specimen_id, d, specimen_id % 4 AS f, day(d) AS n, month(d) AS m, year(d) || '-' || lpad(CAST(day(d) AS VARCHAR), 2, '0') || '-' || lpad(CAST(month(d) AS VARCHAR), 2, '0') AS turned, strftime(d, '%Y-%m-%d') AS iso,
CASE specimen_id % 4 WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN strftime(d, '%b ') || day(d) || ', ' || year(d) WHEN 2 THEN day(d) || '.' || ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII'][month(d)] || '.' || year(d) ELSE CAST(year(d) AS VARCHAR) END AS written FROM sp)
SELECT specimen_id, written AS "verbatimEventDate", CASE WHEN f = 3 THEN 'RANGE' WHEN f = 0 AND n <= 12 AND n <> m THEN 'AMBIGUOUS' ELSE 'DATE' END AS state, CASE WHEN f = 3 THEN written WHEN f = 0 AND n <= 12 AND n <> m THEN least(iso, turned) || '/' || greatest(iso, turned) ELSE iso END AS result FROM v""")
def verbatim_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = checks.with_verbatim_dates(specimens(spark, sf_dir).select("specimen_id", "verbatimEventDate"))
    return df.select("specimen_id", "verbatimEventDate", "verbatimEventDate_parsed.*")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 AS f, CAST(o_orderdate AS DATE) AS d, year(CAST(o_orderdate AS DATE)) AS y, strftime(CAST(o_orderdate AS DATE), '%m') AS m, strftime(CAST(o_orderdate AS DATE), '%d') AS n FROM orders),
e AS (SELECT *, last_day(d) AS e, CAST(y || '-01-01' AS DATE) AS a, CAST(y || '-12-31' AS DATE) AS b FROM o)
SELECT k, CASE f WHEN 0 THEN y || '-' || m || '-' || n WHEN 1 THEN CASE WHEN d = e THEN CAST(d AS VARCHAR) WHEN n = '01' THEN y || '-' || m ELSE CAST(d AS VARCHAR) || '/' || CAST(e AS VARCHAR) END WHEN 2 THEN '-' || y WHEN 3 THEN CAST(d AS VARCHAR) WHEN 4 THEN CASE WHEN m = '01' AND n = '01' THEN CAST(y AS VARCHAR) WHEN m = '12' AND n = '31' THEN CAST(d AS VARCHAR) WHEN m = '12' AND n = '01' THEN y || '-12' ELSE CAST(d AS VARCHAR) || '/' || CAST(b AS VARCHAR) END WHEN 6 THEN y || '/' || y + 1 END AS said,
CASE f WHEN 0 THEN 86400 WHEN 1 THEN 86400 * (e - d + 1) WHEN 2 THEN 86400 * CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 366 ELSE 365 END WHEN 3 THEN 86400 WHEN 4 THEN 86400 * (b - d + 1) WHEN 6 THEN 86400 * (CAST(y + 1 || '-12-31' AS DATE) - a + 1) END AS seconds FROM e""")
def interval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and intervals in several forms, said as shortly as they can be, and how long they are."""
    d = F.col("o_orderdate").cast("date")
    end, year = F.last_day(d).cast("string"), F.year(d).cast("string")
    forms = [F.date_format(d, "yyyyMMdd"), F.concat(d.cast("string"), F.lit("/"), F.substring(end, 9, 2)), F.concat(F.lit("-"), year), F.date_format(d, "yyyy-DDD"), F.concat(d.cast("string"), F.lit("/12-31")), F.concat(year, F.lit("-13")), F.concat(year, F.lit("/"), (F.year(d) + 1).cast("string"))]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.get(F.array(*forms), (F.col("o_orderkey") % 7).cast("int")).alias("text"))
    rows = rows.select("k", intervals.interval(F.col("text")).alias("i"))
    return rows.select("k", intervals.to_text(F.col("i")).alias("said"), intervals.seconds(F.col("i")).alias("seconds"))


@query(_SPECIMENS + " SELECT specimen_id, strftime(d, '%Y-%m-%d') AS found FROM sp")
def label_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of a label text of several lines, its year hinted."""
    df = specimens(spark, sf_dir)
    d = F.col("truth_eventDate").cast("date")
    label = F.concat(F.lit("Herb. No 123\nleg. "), F.col("truth_recordedBy"), F.lit("\n"), F.date_format(d, "d MMMM yyyy"), F.lit(" det. 1801"))
    years = F.array(F.year(d))
    return df.select("specimen_id", labels.best(labels.candidates(label, years), years)["iso"].alias("found"))


@query("SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars, length(regexp_replace(html, '\\s+', '', 'g')) AS n_dense FROM pages")
def page_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("n_chars"), F.length(F.regexp_replace("html", r"\s+", "")).cast("long").alias("n_dense"))


@query("SELECT c_custkey, round(2 * 6371.0 * atan2(sqrt(a), sqrt(greatest(0, 1 - a))), 3) AS km FROM (SELECT c_custkey, pow(sin(radians(c_custkey % 90) / 2), 2) + cos(radians(c_custkey % 90)) * pow(sin(radians(c_custkey % 180) / 2), 2) AS a FROM customer)")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    zero = F.lit(0.0)
    return c.select("c_custkey", geo.haversine_km(zero, zero, (F.col("c_custkey") % 90).cast("double"), (F.col("c_custkey") % 180).cast("double")).alias("km"))
