"""Collectors against what is on record of them: profiles over all spellings of a name, and what to say of a record's collector and country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.functions import people, text
from voucherlens.operators.rollup import trimmed_years


def variant_profiles(names: DataFrame, occurrences: DataFrame, name_col: str = "name") -> DataFrame:
    """(key, total, countries, years) for each person of the names: occurrences recorded under any common spelling.

    `occurrences`: recordedBy, country, year, a row each; recordedBy lists persons between "|". An occurrence that
    lists several spellings of one person counts once. Occurrences are counted by their recordedBy text first, so that
    spellings meet distinct texts only and a frequent surname's rows travel as one count; a text is taken apart once.
    Persons without a record have total 0; names without a surname are left out.
    """
    persons = names.select(F.col(name_col).alias("name")).distinct().select(people.profile_key(F.col("name")).alias("key"), F.explode(people.name_variants(F.col("name"))).alias("spelt")).where("key is not null").distinct()
    counted = occurrences.where("recordedBy is not null").groupBy("recordedBy", "country", "year").agg(F.count(F.lit(1)).alias("n"))
    texts = counted.select("recordedBy").distinct().select("recordedBy", F.explode(F.array_distinct(F.transform(F.split("recordedBy", r"\|"), lambda x: F.trim(x)))).alias("spelt"))
    met = texts.join(persons, "spelt").select("key", "recordedBy").distinct()
    rows = met.join(counted, "recordedBy").groupBy("key", "country", "year").agg(F.sum("n").alias("n"))
    out = persons.select("key").distinct().join(rows.groupBy("key").agg(F.sum("n").alias("total")), "key", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    for c, name in (("country", "countries"), ("year", "years")):
        sums = rows.where(F.col(c).isNotNull()).groupBy("key", c).agg(F.sum("n").alias("n"))
        out = out.join(sums.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(name)), "key", "left")
    return out


def top_countries(countries: Column, n: int = 4) -> Column:
    """The `n` countries with most records, as "XX 1,234, YY 56"; the first in order of equals; "none" without any."""
    entries = F.array_sort(F.transform(F.filter(F.map_entries(countries), lambda e: e["value"] > 0), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("c"))))
    said = F.array_join(F.transform(F.slice(entries, 1, n), lambda e: F.concat(e["c"], F.lit(" "), F.format_number(-e["n"], 0))), ", ")
    return F.coalesce(F.nullif(said, F.lit("")), F.lit("none"))


def _less(counts: Column, key: Column, own: Column) -> Column:
    return F.transform_values(counts, lambda k, n: n - F.when(own & (k == key), 1).otherwise(0))


def judged(records: DataFrame, profiles: DataFrame, min_records: int = 20, margin: int = 5) -> DataFrame:
    """`records` (collector, country_code, year) with total, in_country, low, high, verdict and the counts they rest on.

    verdict: unreachable (no profile), unknown (fewer than `min_records`), country (none there), year (out of the usual
    years by more than `margin`) or ok. Where `records` has own_recordedBy, own_country and own_year, the specimen's own
    record is left out of the evidence if it goes under a spelling of the collector's name.
    """
    rows = records.withColumn("key", people.profile_key(F.col("collector"))).join(profiles.select("key", F.col("total").alias("all_records"), "countries", "years"), "key", "left")
    own = F.lit(False)
    if "own_recordedBy" in records.columns:
        own = F.coalesce(F.array_contains(people.name_variants(F.col("collector")), F.col("own_recordedBy")), F.lit(False))
    rows = rows.withColumn("own", own & F.col("all_records").isNotNull())
    no_map = lambda kind: F.map_from_arrays(F.array().cast(f"array<{kind}>"), F.array().cast("array<bigint>"))
    own_country, own_year = (F.col(c) if c in records.columns else F.lit(None).cast("string") for c in ("own_country", "own_year"))
    rows = rows.withColumn("countries", _less(F.coalesce("countries", no_map("string")), own_country, F.col("own"))).withColumn("years", _less(F.coalesce("years", no_map("int")), own_year.cast("int"), F.col("own")))
    rows = rows.withColumn("total", F.col("all_records") - F.col("own").cast("int")).withColumn("in_country", F.when(text.present(F.col("country_code")), F.coalesce(F.try_element_at("countries", F.col("country_code")), F.lit(0))))
    rows = rows.withColumn("span", trimmed_years(F.col("years")))
    outside = (F.col("year") < F.col("span.low") - margin) | (F.col("year") > F.col("span.high") + margin)
    verdict = F.when(F.col("total").isNull(), "unreachable").when(F.col("total") < min_records, "unknown").when(F.col("in_country") <= 0, "country").when(F.coalesce(outside, F.lit(False)), "year").otherwise("ok")
    return rows.withColumn("verdict", verdict).select(*records.columns, "total", "in_country", F.col("span.low").alias("low"), F.col("span.high").alias("high"), "countries", "verdict")


def flags(judgements: DataFrame, switched_off: bool = False, margin: int = 5) -> DataFrame:
    """`judged` rows with flag: struct(kind, text, detail), null where there is nothing to say. Only the country warns.

    `country`: its name as read. Needs collector and country; `switched_off` gives no flag at all.
    """
    # The wording of flags.
    c = F.col
    count = lambda x: F.format_number(x, 0)
    place = F.concat(c("country"), F.lit(" ("), c("country_code"), F.lit(")"))
    who = F.concat(F.lit(" preserved specimens by '"), c("collector"), F.lit("'"))
    inside = F.when(c("year").between(c("low") - margin, c("high") + margin), "inside").otherwise("outside")
    tail = F.when(c("year").isNotNull(), F.concat(F.lit("; the label year "), c("year").cast("string"), F.lit(" is "), inside, F.lit(" that range."))).otherwise(F.lit("."))
    usual = F.when(c("low").isNotNull() & c("year").isNotNull(), F.concat(F.lit(" Usual collecting years on GBIF: "), c("low").cast("string"), F.lit("-"), c("high").cast("string"), tail)).otherwise(F.lit(""))
    fine = F.concat(F.lit("GBIF has "), count(c("in_country")), F.lit(" of "), count(c("total")), who, F.lit(" from "), place, F.lit("."), usual)
    odd = F.concat(F.lit("GBIF has "), count(c("total")), who, F.lit(", none from "), place, F.lit(". Most are from: "), top_countries(c("countries")), F.lit(". A hint to check the collector and country, not a correction."))
    say = lambda kind, words, detail: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(words), c("country")).alias("text"), detail.alias("detail"))
    given = text.present(c("collector")) & text.present(c("country")) & text.present(c("country_code")) & F.lit(not switched_off)
    out = F.when(given & c("verdict").isin("ok", "year"), say("ok", "collector recorded in ", fine)).when(given & (c("verdict") == "country"), say("warn", "collector not recorded in ", odd))
    return judgements.withColumn("flag", out)
