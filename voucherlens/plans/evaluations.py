"""Queries of a whole evaluation: its frames and its totals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherlens.operators import chunks, evaluation
from voucherlens.plans.catalog import _PARTS, _SPECIMENS, query
from voucherlens.plans.specimens import specimens, table
from voucherlens.streaming import ledger

#: the fields whose scores SQL can state
_FIELDS = {"eventDate": "date", "catalogNumber": "text"}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specimens evaluated: six of ten against JSON documents, two against annotations, two against nothing."""
    df = specimens(spark, sf_dir)
    k, date = F.col("specimen_id"), F.col("truth_eventDate")
    parts = [F.when(k % 3 == 2, F.regexp_replace(F.split_part(date, F.lit("-"), F.lit(i + 1)), "^0", "").cast("int")).alias(x) for i, x in enumerate(("year", "month", "day"))]
    place = {c: F.col(f"truth_{c}") for c in ("decimalLatitude", "decimalLongitude")}
    occurrence = F.to_json(F.struct(F.concat(F.lit("g"), k).alias("gbifID"), F.when(k % 3 == 0, date).alias("eventDate"), F.when(k % 3 == 1, date).alias("verbatimEventDate"), *parts, k.cast("string").alias("catalogNumber"), F.struct(F.lit("1900").alias("eventDate")).alias("other"), *[c.alias(n) for n, c in place.items()]))
    documents = df.where(k % 10 < 6).select(k.alias("key"), F.lit("{}").alias("fragment"), F.to_json(F.struct(F.struct(F.col("truth_locality").alias("verbatimLocality")).alias("label"))).alias("verbatim"), occurrence.alias("occurrence"))
    said = {"eventDate": date, "catalogNumber": k.cast("string"), **place}
    notes = df.where((k % 10).isin(6, 7)).select(k.cast("string").alias("annotation_id"), F.map_from_arrays(F.array(*map(F.lit, said)), F.array(*said.values())).alias("fields"))
    own = df.select(*[c for c in df.columns if not c.startswith("truth_")])
    return evaluation.evaluated(own, evaluation.truth_from_documents(documents), evaluation.truth_from_annotations(notes), fields=_FIELDS)


_EVALUATED = _SPECIMENS + _PARTS + """, e AS (SELECT sc.specimen_id AS k, sc.specimen_id % 10 AS w, sc.date_score, CASE WHEN eventdate = '' THEN 'missing' ELSE 'date-eval' END AS dm, res.coord_score,
CASE WHEN tlat = 0 AND tlon = 0 THEN CASE WHEN alat IS NULL OR (alat = 0 AND alon = 0) THEN 'N/A' ELSE 'ai-extracted-unref' END WHEN alat IS NULL OR (alat = 0 AND alon = 0) THEN 'inferred-gbif' ELSE 'coord-eval' END AS cm,
1 - levenshtein(CAST(sc.specimen_id AS VARCHAR), catalognumber) / greatest(length(CAST(sc.specimen_id AS VARCHAR)), length(catalognumber))::DOUBLE AS cer FROM sc JOIN res ON sc.specimen_id = res.specimen_id),
a AS (SELECT *, CASE WHEN w < 8 THEN (date_score + cer + coalesce(coord_score, 0)) / CASE WHEN coord_score IS NULL THEN 2 ELSE 3 END END AS accuracy FROM e)"""


@query(_EVALUATED + """, f AS (SELECT k, w, 'eventDate' AS field, date_score AS s, dm AS method FROM e UNION ALL SELECT k, w, 'catalogNumber', cer, 'cer' FROM e UNION ALL SELECT k, w, 'coordinates', coord_score, cm FROM e)
SELECT CAST(k AS VARCHAR) AS filename, CASE WHEN w < 6 THEN 'g' || k ELSE CAST(k AS VARCHAR) END AS "gbifID", field, CAST(round(s, 4) AS DOUBLE) AS score, method FROM f WHERE w < 8""")
def evaluation_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluation(_scored(spark, sf_dir)).select("filename", "gbifID", "field", "score", "method")


@query(_EVALUATED + """ SELECT CAST(k AS VARCHAR) AS filename, CASE WHEN w < 6 THEN 'g' || k ELSE CAST(k AS VARCHAR) END AS "gbifID", CASE WHEN w < 8 THEN 'matched' ELSE 'unmatched' END AS status, CAST(round(accuracy, 4) AS DOUBLE) AS overall_score, sp.country, sp.typestatus AS "typeStatus" FROM a JOIN sp ON sp.specimen_id = a.k""")
def darwin_core_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _ = evaluation.evaluate(_scored(spark, sf_dir), fields=list(_FIELDS))
    return frames["darwin_core"].select("filename", "gbifID", "status", "overall_score", "country", "typeStatus")


@query(_EVALUATED + " SELECT field, round(avg(s), 4) AS mean_accuracy, count(s) AS n_scored FROM (SELECT w, 'eventDate' AS field, date_score AS s FROM e UNION ALL SELECT w, 'catalogNumber', cer FROM e UNION ALL SELECT w, 'coordinates', coord_score FROM e) WHERE w < 8 GROUP BY field")
def field_summary_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.field_summary(_scored(spark, sf_dir), list(_FIELDS)).select("field", "mean_accuracy", "n_scored")


@query(_EVALUATED + " SELECT count(*) AS n_specimens, count(accuracy) AS n_matched, count(*) - count(accuracy) AS n_unmatched, round(avg(accuracy), 6) AS accuracy, count(*) FILTER (accuracy >= 0.85) AS n_high, count(*) FILTER (accuracy >= 0.6 AND accuracy < 0.85) AS n_middle, count(*) FILTER (accuracy < 0.6) AS n_low, 0::BIGINT AS n_synonyms FROM a")
def evaluation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's totals, as observed while its scored table is written."""
    _, seen = evaluation.evaluate(_scored(spark, sf_dir), fields=list(_FIELDS))
    columns = ["n_specimens", "n_matched", "n_unmatched", "accuracy", "n_high", "n_middle", "n_low", "n_synonyms"]
    return spark.createDataFrame([tuple(round(seen[c], 6) if c == "accuracy" else seen[c] for c in columns)], ", ".join(f"{c} {'double' if c == 'accuracy' else 'long'}" for c in columns))


#: a range such as 1998-00 ends before it begins and is none
_LABELS = """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 = 0 AND (year(CAST(o_orderdate AS DATE)) + 1) % 100 < 2 THEN 6 ELSE o_orderkey % 8 END AS f, CAST(o_orderdate AS DATE) AS d, year(CAST(o_orderdate AS DATE)) AS y, month(CAST(o_orderdate AS DATE)) AS m, day(CAST(o_orderdate AS DATE)) AS n FROM orders)"""


@query(_LABELS + """ SELECT k, CASE WHEN f = 0 THEN y - 1 || '-' || y + 1 || ' (range)' WHEN f IN (1, 2, 5, 7) THEN strftime(d, '%Y-%m-%d') WHEN f = 3 THEN CAST(y AS VARCHAR) WHEN f = 4 THEN strftime(d, '%Y-%m') WHEN f = 6 THEN NULL END AS value,
CASE WHEN f = 0 THEN 'range' WHEN f IN (1, 2, 5, 7) THEN 'high' WHEN f = 3 THEN 'year' WHEN f = 4 THEN 'medium' END AS confidence,
CASE WHEN f = 6 THEN 'no date pattern found on sheet — review manually' WHEN f IN (0, 3) THEN 'sheet supports GBIF — AI wrong' WHEN f IN (1, 4, 5, 7) THEN 'sheet supports GBIF — AI wrong' WHEN f = 2 THEN 'sheet supports AI — GBIF likely wrong' END AS verdict,
CASE WHEN f = 2 THEN 1.0::DOUBLE END AS corrected FROM o""")
def label_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates on labels in several forms, and whether they speak for the record or the transcription."""
    from voucherlens.functions import labels

    d = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), d.alias("d"), F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("n"))
    k, y, m, n = map(F.col, "kymn")
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    iso, next_year = F.col("d").cast("string"), (y + 3).cast("string")
    forms = [
        F.concat(F.lit("Annis "), (y - 1).cast("string"), F.lit("-"), two(y + 1), F.lit(". No 1801-95")), F.concat(F.lit("leg. X "), n, F.lit("."), m, F.lit("."), two(y)), F.concat(F.lit("no 17, "), m, F.lit("/"), n, F.lit(" det. B")),
        F.concat(F.lit("coll. 2 in "), y), F.concat(F.lit("Sommer "), F.date_format("d", "MMMM"), F.lit(" "), y), F.concat(F.lit("det. 3 III 1801, "), F.date_format("d", "MMM"), F.lit(". "), n, F.lit("th, "), y), F.lit("Herb. Kew no 44"), F.concat(n, F.lit(" "), F.date_format("d", "MMMM"), F.lit(", "), y, F.lit(" 1801-1803")),
    ]
    label = F.get(F.array(*forms), (k % 8).cast("int"))
    truth = F.when(k % 8 == 2, next_year).otherwise(iso)
    found = F.when(k % 8 == 2, iso).otherwise(next_year)
    return rows.select("k", labels.resolve(truth, found, label).alias("v")).select("k", "v.value", "v.confidence", "v.verdict", "v.corrected")


@query("""WITH RECURSIVE o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders), s AS MATERIALIZED (SELECT *, sum(size) OVER (ORDER BY i) AS total FROM o),
c(chunk, first) AS (SELECT 0, 1 UNION ALL SELECT chunk + 1, (SELECT min(n.i) FROM s n WHERE n.i > c.first AND n.total > (SELECT b.total - b.size + 5000000 FROM s b WHERE b.i = c.first)) FROM c WHERE first IS NOT NULL)
SELECT o_orderkey, CAST(max(chunk) AS BIGINT) AS chunk FROM s JOIN c ON c.first <= s.i GROUP BY o_orderkey""")
def submission_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in order, cut into chunks of a budget."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("size"))
    return chunks.byte_chunks(rows, 5_000_000, order=("o_orderkey",)).select("o_orderkey", "chunk")


@query("""WITH e AS (SELECT event_id, user_id AS stem, CASE event_type WHEN 'purchase' THEN 'answered' WHEN 'click' THEN 'failed' ELSE 'submitted' END AS kind, 'j' || event_id // 7 AS job, ts, value FROM events),
p AS (SELECT stem, min({'ts': ts, 'event_id': event_id, 'job': job, 'cost': value}) AS paid FROM e WHERE kind = 'answered' GROUP BY stem),
b AS (SELECT e.*, p.paid FROM e LEFT JOIN p ON p.stem = e.stem WHERE p.paid IS NULL OR (e.ts, e.event_id) <= (p.paid.ts, p.paid.event_id)),
s AS (SELECT stem, any_value(paid) AS paid, count(DISTINCT CASE WHEN kind = 'submitted' THEN job END) AS attempts, arg_max(kind, {'ts': ts, 'event_id': event_id}) AS last, arg_max(job, {'ts': ts, 'event_id': event_id}) FILTER (kind = 'submitted') AS job FROM b GROUP BY stem)
SELECT CAST(stem AS VARCHAR) AS stem, CASE WHEN paid IS NOT NULL THEN 'done' ELSE last END AS status, attempts, CASE WHEN paid IS NOT NULL THEN paid.job ELSE job END AS job, CASE WHEN paid IS NOT NULL THEN paid.cost ELSE 0.0 END AS cost FROM s""")
def job_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each user's jobs, as the stream of the ledger would have it in the end."""
    kind = F.when(F.col("event_type") == "purchase", "answered").when(F.col("event_type") == "click", "failed").otherwise("submitted")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("stem"), F.lit("m").alias("model"), kind.alias("kind"), F.concat(F.lit("j"), F.floor(F.col("event_id") / 7)).alias("job"), F.col("value").alias("cost"), F.lit(None).cast("string").alias("error"), "ts")
    return ledger.settled(rows).select("stem", "status", "attempts", "job", "cost")
