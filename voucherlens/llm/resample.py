"""Importance resampling towards a target distribution of hashed word n-grams.

Method: overlap chunking for long texts. A long text is split at word boundaries into chunks that carry the next n - 1
words, so that each chunk owns the n-grams that start in it; chunks are dealt out over the cluster, and their feature
counts and weights are summed by document. Counts by hash bucket are a fixed-size table; the draw is by Gumbel noise on
the weights, and ranks come from one range sort with the partitions' totals summed. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voucherlens.llm.common import discard, written
from voucherlens.llm.decontam import words


def chunked(docs: DataFrame, id_col: str, text_col: str, max_n: int, chunk_words: int, long_chars: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, words, owned) of texts of up to `long_chars` characters, whole, and (row, doc_id, words, owned) of longer ones:
    chunks of `chunk_words` words and the max_n - 1 that follow, dealt out by row and chunk. `owned` n-grams may start in a chunk.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    short = rows.where(~is_long).select("doc_id", words(F.col("text")).alias("words"))
    long = rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(chunk_words))
    cut = long.select("row", "doc_id", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("words", i + 1, chunk_words + max_n - 1).alias("words")))).alias("c"))
    cut = cut.select("row", "doc_id", "c.at", "c.words").repartition("row", "at")
    return short.withColumn("owned", F.size("words")), cut.select("row", "doc_id", "words", F.least(F.size("words"), F.lit(chunk_words)).alias("owned"))


def buckets_of(tokens: Column, owned: Column, max_n: int, buckets: int) -> Column:
    """Hash buckets of all runs of 1 to `max_n` words that start within the first `owned` words, repeats included."""
    hashed = lambda feature: (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def run_of(n: int):
        return lambda i: hashed(F.array_join(F.slice(tokens, i, F.lit(n)), " "))

    parts = [F.transform(F.slice(tokens, F.lit(1), owned), hashed)]
    for n in range(2, max_n + 1):
        last = F.least(owned, F.size(tokens) - n + 1)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), run_of(n))
        parts.append(F.when(last >= 1, runs).otherwise(F.array().cast("array<int>")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def bucket_gains(source: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", target_text: str = "text", text_col: str = "text", chunk_words: int = 8192, long_chars: int = 65_536) -> DataFrame:
    """(bucket, s, t, gain) for every bucket: counts over all source and target texts, and 1000 times the log ratio of their shares, floored.

    Add-one smoothing; a bucket that neither holds still has a gain. `buckets` rows, whatever the input's size.
    """

    def counts(texts: DataFrame, text: str, name: str) -> DataFrame:
        short, long = chunked(texts.select(F.lit(None).cast("long").alias("id"), F.col(text).alias("text")), "id", "text", max_n, chunk_words, long_chars)
        return short.unionByName(long.drop("row")).select(F.explode(buckets_of(F.col("words"), F.col("owned"), max_n, buckets)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts(source, text_col, "s"), "bucket", "left").join(counts(target, target_text, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    total = Window.partitionBy(F.lit(0))  # over the fixed number of buckets
    big = lambda c: F.col(c).cast("double")
    both = both.withColumn("all_s", F.sum("s").over(total)).withColumn("all_t", F.sum("t").over(total))
    ratio = (big("t") + 1) * (big("all_s") + buckets) / ((big("s") + 1) * (big("all_t") + buckets))
    return both.select("bucket", "s", "t", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, max_n: int = 1, buckets: int = 10_000, min_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", chunk_words: int = 8192, long_chars: int = 65_536) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of `docs`.

    weight: the floored mean gain of a text's features, 0 without any. score: weight and Gumbel noise keyed by seed and id.
    rank: 1, 2, 3 … for the `percent` per cent highest scores among texts of `min_words` words or more, ties to the
    smaller id; null for the others. A null text has no words. A null id has no score and is never drawn. Repeated rows
    are judged one by one. Empty documents give no row; an empty target leaves gains by the documents alone.
    """
    if max_n < 1 or chunk_words < 1 or not 0 <= percent <= 100:
        raise ValueError("max_n and chunk_words must be positive, percent between 0 and 100")
    gains = written(bucket_gains(docs, target, max_n, buckets, id_col, target_text, text_col, chunk_words, long_chars), "gains")
    table = gains.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("g")).scalar()
    gained = F.aggregate("features", F.lit(0).cast("long"), lambda acc, b: acc + F.get("g", b))

    def weighed(held: DataFrame) -> DataFrame:
        ids = [c for c in held.columns if c in ("row", "doc_id")]
        held = held.select(*ids, "owned", buckets_of(F.col("words"), F.col("owned"), max_n, buckets).alias("features"), table.alias("g"))
        return held.select(*ids, F.col("owned").cast("long").alias("n_words"), F.size("features").cast("long").alias("n_features"), gained.alias("gained"))

    short, long = map(weighed, chunked(docs, id_col, text_col, max_n, chunk_words, long_chars))
    long = long.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "gained")]).drop("row")
    rows = short.unionByName(long)
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((key + 0.5) / 4294967296.0))).cast("long")
    mean = F.when(F.col("n_features") > 0, F.expr("(gained - pmod(gained, n_features)) div n_features")).otherwise(0).cast("long")
    rows = rows.select("doc_id", "n_words", "n_features", mean.alias("weight"), (mean + noise).alias("score"))
    rows = written(rows.withColumn("fit", (F.col("n_words") >= min_words) & F.col("score").isNotNull()), "weights")
    ordered = written(rows.orderBy(F.desc("fit"), F.desc("score"), "doc_id").withColumn("place", F.monotonically_increasing_id()), "scores")
    discard(gains, rows)
    part = F.shiftright("place", 33).alias("part")
    sizes = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.count_if("fit").alias("fits"))  # a row for each partition of the sort
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    drawn = F.floor(sizes.agg(F.coalesce(F.sum("fits"), F.lit(0))).scalar() * percent / 100)
    place = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = ordered.withColumn("part", part).join(before, "part").withColumn("rank", F.when(F.col("fit") & (place <= drawn), place))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", "rank")
