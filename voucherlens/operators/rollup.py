"""Roll-ups: specimens, fields, runs, models, collectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voucherlens.functions import text


def specimen_accuracy(results: DataFrame, id_col: str) -> DataFrame:
    """Mean of a specimen's counted scores, 0 if none counts."""
    return results.groupBy(id_col).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("accuracy"), F.count("score").alias("n_scored"))


def run_summary(specimens: DataFrame) -> DataFrame:
    """One row: the mean of specimen means, and how many are high, middling and low."""
    a = F.col("accuracy")
    return specimens.agg(
        F.count(F.lit(1)).alias("n_specimens"), F.coalesce(F.avg(a), F.lit(0.0)).alias("accuracy"),
        F.count_if(a >= 0.85).alias("n_high"), F.count_if((a >= 0.6) & (a < 0.85)).alias("n_middle"), F.count_if(a < 0.6).alias("n_low"),
    )


def field_summary(results: DataFrame, fields: list[str]) -> DataFrame:
    """Mean and count of each field's counted scores; a field without one has a null mean."""
    order = results.sparkSession.createDataFrame(list(enumerate(fields)), "position int, field string")
    sums = results.groupBy("field").agg(F.avg("score").alias("mean_accuracy"), F.count("score").alias("n_scored"))
    return order.join(sums, "field", "left").select("position", "field", "mean_accuracy", F.coalesce("n_scored", F.lit(0)).alias("n_scored"))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """`df` with fields_extracted, fields_total and the percentage to one decimal."""
    filled = sum((text.present(F.col(f)).cast("int") for f in fields), F.lit(0))
    return df.withColumn("fields_extracted", filled).withColumn("fields_total", F.lit(len(fields))).withColumn("field_completeness_pct", F.round(100 * F.col("fields_extracted") / len(fields), 1))


def failed_extraction(fields: list[str]) -> Column:
    """None of the key fields has a value."""
    given = lambda f: ~F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))).isin(text.VALID_NULLS)
    return ~F.array_contains(F.array(*[given(f) for f in fields]), True)


def cost(df: DataFrame, prices: DataFrame) -> DataFrame:
    """`df` (model, tokens_in, tokens_out, is_batch, is_local) with cost_usd; batches cost half, local models nothing. A model without a price is an error."""
    rows = df.join(prices, "model", "left")
    usd = (F.col("tokens_in") * F.col("in_per_m") + F.col("tokens_out") * F.col("out_per_m")) / 1e6 * F.when(F.col("is_batch"), 0.5).otherwise(1.0)
    unpriced = F.raise_error(F.concat(F.lit("no price for model "), F.coalesce("model", F.lit("null")))).cast("double")
    priced = F.when(F.col("in_per_m").isNull() | F.col("out_per_m").isNull(), unpriced).otherwise(F.round(usd, 6))
    return rows.withColumn("cost_usd", F.when(F.col("is_local"), 0.0).otherwise(priced)).drop("in_per_m", "out_per_m")


def model_summary(runs: DataFrame) -> DataFrame:
    """Per model of (model, n_images, accuracy, cost_usd, tokens_*, seconds, wall_s) rows, one per extracted image."""
    return runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_extracted"), F.greatest(F.lit(0), F.max("n_images") - F.count(F.lit(1))).alias("n_failed"), F.count("accuracy").alias("n_scored"),
        (F.avg("accuracy") * 100).alias("accuracy"), (F.avg(F.coalesce("cost_usd", F.lit(0.0))) * 1000).alias("cost_per_1000"),
        F.avg(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in_avg"), F.avg(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out_avg"), F.avg("tokens_thinking").alias("tokens_thinking_avg"),
        F.coalesce(F.avg("seconds"), F.max("wall_s") / F.count(F.lit(1))).alias("sec_per_specimen"), F.count("seconds").alias("n_timed"),
        F.when(F.count("seconds") > 0, "per-image").when(F.max("wall_s").isNotNull(), "wall").otherwise("none").alias("time_source"),
    )


def ranked(models: DataFrame) -> DataFrame:
    """Models by falling accuracy, those without one last."""
    return models.orderBy(F.desc_nulls_last("accuracy"), "model")


def pareto(models: DataFrame, cost_col: str = "cost_per_1000", score_col: str = "accuracy") -> DataFrame:
    """Models that no cheaper one equals: strictly above the best score so far, by rising cost. One row a model, so one task will do."""
    before = Window.orderBy(cost_col, score_col).rowsBetween(Window.unboundedPreceding, -1)
    return models.withColumn("best", F.coalesce(F.max(score_col).over(before), F.lit(-1.0))).where(F.col(score_col) > F.col("best")).drop("best")


def collector_profiles(occurrences: DataFrame) -> DataFrame:
    """Per (collector): total, countries and years maps, of (collector, country, year) rows. Counts first, maps of few entries then."""
    totals = occurrences.groupBy("collector").agg(F.count(F.lit(1)).alias("total"))
    out = totals
    for c in ("country", "year"):
        counts = occurrences.where(F.col(c).isNotNull()).groupBy("collector", c).agg(F.count(F.lit(1)).alias("n"))
        maps = counts.groupBy("collector").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias("years" if c == "year" else "countries"))
        out = out.join(maps, "collector", "left")
    return out


def trimmed_years(years: Column, low: float = 0.05, high: float = 0.95) -> Column:
    """struct(low, high): the years at places int(p * (n - 1)) of the sorted multiset that a year -> count map stands for."""
    entries = F.array_sort(F.filter(F.map_entries(years), lambda e: e["value"] > 0))
    n = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["value"])

    def at(p: float) -> Column:
        place = F.floor(F.lit(p) * (n - 1))
        begin = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("year"))
        return F.aggregate(entries, begin, lambda a, e: F.struct((a["seen"] + e["value"]).alias("seen"), F.when(a["year"].isNull() & (a["seen"] + e["value"] > place), e["key"].cast("int")).otherwise(a["year"]).alias("year")))["year"]

    return F.when(n > 0, F.struct(at(low).alias("low"), at(high).alias("high")))


def collector_verdicts(specimens: DataFrame, profiles: DataFrame, min_records: int = 20, margin: int = 5, leave_one_out: bool = False) -> DataFrame:
    """`specimens` (collector, country, year) with total, in_country and verdict: unreachable, unknown, country, year or ok."""
    rows = specimens.join(profiles, "collector", "left")
    own = F.lit(1 if leave_one_out else 0)
    less = lambda m, k: F.transform_values(m, lambda key, n: n - F.when(key == k, own).otherwise(F.lit(0)))
    total = F.col("total") - own
    in_country = F.coalesce(F.try_element_at("countries", F.col("country")), F.lit(0)) - F.when(F.try_element_at("countries", F.col("country")).isNotNull(), own).otherwise(F.lit(0))
    years = trimmed_years(F.coalesce(less(F.col("years"), F.col("year")), F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>"))))
    outside = (F.col("year") < years["low"] - margin) | (F.col("year") > years["high"] + margin)
    verdict = F.when(F.col("total").isNull(), "unreachable").when(total < min_records, "unknown").when(text.present(F.col("country")) & (in_country <= 0), "country").when(F.coalesce(outside, F.lit(False)), "year").otherwise("ok")
    return rows.withColumn("verdict", verdict).withColumn("in_country", F.when(text.present(F.col("country")), in_country)).withColumn("total", total).drop("countries", "years")


def status_counts(df: DataFrame, col: str = "status") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
