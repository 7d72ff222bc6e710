"""Specimen records derived from the order tables, with known perturbations of the truth, and small reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherlens.functions.dates import ROMAN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(k: Column, n: int, *values: Column) -> Column:
    out = F
    for i, v in enumerate(values):
        out = out.when(k % n == i, v)
    return out


def specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order: specimen_id, truth_* columns, and the transcription under the terms' own names."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    part = table(spark, sf_dir, "part").where("p_partkey < 200").select("p_partkey", "p_name", "p_type")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(part, F.col("k") % 200 == F.col("p_partkey"), "left")
    # a file of orders may be one task's; dealt by key, the work on them is everyone's, and what is found by key needs no further shuffle
    rows = rows.repartition("k")
    k, d = F.col("k"), F.col("d")
    iso = d.cast("string")
    day, month, year = F.dayofmonth(d), F.month(d), F.year(d).cast("string")
    # the lambda keeps the long projection below out of whole-stage code, where it is one method, longer than the JVM compiles
    numeral = F.get(F.transform(F.array(month), lambda m: F.get(F.array(*map(F.lit, ROMAN)), m - 1)), 0)
    roman = F.concat(day.cast("string"), F.lit("."), numeral, F.lit("."), year)
    lat = ((F.col("o_custkey") * 7919) % 18000) / F.lit(100.0) - 90
    lon = ((F.col("o_custkey") * 104729) % 36000) / F.lit(100.0) - 180
    shift = _cases(k, 8, *[F.lit(float(x)) for x in (0, 0.001, 0.05, 0.3, 0.8, 2.0, 0, 0)])
    two = lambda c: F.format_string("%.3f", c)
    name, sci = F.col("c_name"), F.initcap(F.col("p_name"))
    elevation = F.col("c_acctbal").cast("int")
    return rows.select(
        k.alias("specimen_id"), iso.alias("truth_eventDate"),
        _cases(k, 8, iso, F.date_add(d, 1).cast("string"), F.date_format(d, "yyyy-dd-MM"), F.date_format(d, "yyyy-MM"), year, (F.year(d) - 1).cast("string"), F.lit(""), roman).alias("eventDate"),
        _cases(k, 4, F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "MMM d, yyyy"), roman, year).alias("verbatimEventDate"),
        F.date_add(d, (k % 900).cast("int") - F.when(k % 10 == 0, 1000).otherwise(0)).cast("string").alias("dateIdentified"),
        name.alias("truth_recordedBy"), _cases(k, 4, name, F.concat(F.substring(name, 1, 1), F.lit("."), F.substring_index(name, "#", -1)), F.concat(F.substring_index(name, "#", -1), F.lit(" "), F.substring_index(name, "#", 1)), F.substring(name, 2, 100)).alias("recordedBy"),
        sci.alias("truth_scientificName"), _cases(k, 4, sci, F.substring(sci, 2, 100), F.concat(sci, F.lit(" sp.")), F.substring_index(sci, " ", 1)).alias("scientificName"),
        F.substring_index(sci, " ", 1).alias("truth_genus"), F.substring_index(sci, " ", 1).alias("genus"), F.substring_index(sci, " ", -1).alias("truth_specificEpithet"), F.substring_index(sci, " ", -1).alias("specificEpithet"),
        k.cast("string").alias("truth_catalogNumber"), F.when(k % 5 == 0, F.concat(F.lit("0"), k.cast("string"))).otherwise(k.cast("string")).alias("catalogNumber"),
        F.col("n_name").alias("truth_country"), _cases(k, 4, F.col("n_name"), F.replace(F.col("n_name"), F.lit("_"), F.lit("")), F.substring(F.col("n_name"), 1, 4), F.lit("")).alias("country"),
        F.col("r_name").alias("truth_stateProvince"), _cases(k, 3, F.col("r_name"), F.substring(F.col("r_name"), 1, 3), F.lit("")).alias("stateProvince"),
        F.concat_ws(" near ", "r_name", "n_name").alias("truth_locality"), F.concat_ws(", ", "n_name", "r_name").alias("locality"),
        two(lat).alias("truth_decimalLatitude"), two(lon).alias("truth_decimalLongitude"),
        F.when(k % 8 == 7, "").when(k % 8 == 6, two(lon)).otherwise(two(lat + shift)).alias("decimalLatitude"), F.when(k % 8 == 7, "").when(k % 8 == 6, two(lat)).otherwise(two(lon)).alias("decimalLongitude"),
        elevation.cast("string").alias("minimumElevationInMeters"), (elevation + (k % 7).cast("int") - 2).cast("string").alias("maximumElevationInMeters"),
        F.concat((k % 3000).cast("string"), _cases(k, 4, F.lit(" m"), F.lit(" ft"), F.lit(" yards"), F.lit(" fathoms"))).alias("verbatimElevation"),
        _cases(k, 5, F.lit("Holotype"), F.lit("holotype"), F.lit("Epi."), F.lit("Iso."), F.lit("")).alias("typeStatus"),
    )


def borders(spark: SparkSession) -> DataFrame:
    """A rectangle for each nation of the tables (25 of 14 by 36 degrees), one with a hole."""
    rows = []
    for i in range(25):
        w, s = -180 + 72 * (i % 5), -90 + 36 * (i // 5)
        box = lambda x, y, a, b: [(float(p), float(q)) for p, q in ((x, y), (a, y), (a, b), (x, b), (x, y))]
        rings = [box(w, s, w + 14, s + 36)] + ([box(w + 4, s + 10, w + 8, s + 20)] if i == 7 else [])
        rows.append((i, f"N{chr(65 + i)}", [f"NATION_{i}", f"Nation {i}"], rings))
    return spark.createDataFrame(rows, "feature_pos int, iso_a2 string, names array<string>, rings array<array<struct<lon:double,lat:double>>>")


def backbone(specimens_: DataFrame) -> DataFrame:
    """A stand-in for a name backbone: exact, fuzzy, homonym and missing answers by a hash of each distinct name."""
    from voucherlens.functions import text

    names = specimens_.select("truth_scientificName").distinct().select(text.strip_authors(F.col("truth_scientificName")).alias("query")).where("query <> ''").distinct()
    kind = F.pmod(F.crc32("query"), F.lit(5)).cast("int")
    genus = F.initcap(F.substring_index("query", " ", 1))
    answer = [
        F.get(F.array(*map(F.lit, ["EXACT", "EXACT", "FUZZY", "NONE", "HIGHERRANK"])), kind).alias("matchType"), F.when(kind == 1, "SYNONYM").otherwise("ACCEPTED").alias("status"),
        F.initcap("query").alias("canonicalName"), F.when(kind == 4, "GENUS").otherwise("SPECIES").alias("rank"), F.concat(genus, F.lit("aceae")).alias("family"), genus.alias("genus"),
        F.when(kind == 3, "Multiple equal matches for the name").alias("note"), F.when(kind != 3, F.crc32("query")).alias("usageKey"), F.when(kind == 1, F.crc32(F.upper("query"))).alias("acceptedUsageKey"), F.when(kind == 2, 75).otherwise(98).alias("confidence"),
    ]
    own = names.select("query", F.lit("name").alias("params"), *answer)
    genera = names.select(F.initcap(F.substring_index("query", " ", 1)).alias("query")).distinct().select(
        "query", F.lit("genus").alias("params"), F.lit("EXACT").alias("matchType"), F.lit("ACCEPTED").alias("status"), F.col("query").alias("canonicalName"), F.when(F.pmod(F.crc32("query"), F.lit(3)) == 0, "FAMILY").otherwise("GENUS").alias("rank"),
        F.concat("query", F.lit("aceae")).alias("family"), F.col("query").alias("genus"), F.lit(None).cast("string").alias("note"), F.crc32("query").alias("usageKey"), F.lit(None).cast("long").alias("acceptedUsageKey"), F.lit(99).alias("confidence"),
    )
    return own.unionByName(genera)
