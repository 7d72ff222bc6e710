"""Line deduplication by content-defined chunks, in DataFrame functions only.

Method: every line is hashed; a rolling hash over the last two line hashes ends a chunk where it is divisible by
`spread`, so boundaries depend on nearby lines alone and a shifted passage is cut as before. Chunks of two lines or more
meet by their hash as thin rows; those found again are compared byte by byte with the first occurrence, and all but the
first (by doc_id, then place) are removed. Counts are partial aggregates and joins are plain equi-joins that adaptive
execution may split, so a passage found in a third of the rows makes no hot task.

A chunk only meets its like where both boundaries lie within the shared passage. `repeated_runs` leaves none out: all windows
of two lines, and single lines of `long_chars` or more, meet by the hashes of their lines; those found again are removed but
for the first, where they add up to a run of enough text. The first occurrence of a line always stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import column_name, written


def _chunks(spread: int):
    """array<struct<s, e, g>>: the multi-line chunks of the line hashes h, as first and last line and hash."""
    inner = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: (i == F.size("h") - 1) | ((i > 0) & (F.pmod(F.xxhash64(F.get("h", i - 1), F.get("h", i)), F.lit(spread)) == 0)))
    pairs = lambda ends: F.transform(ends, lambda e, i: F.struct(F.coalesce(F.get(ends, i - 1) + 1, F.lit(0)).alias("s"), e.alias("e")))
    return inner, pairs


def repeated_chunks(docs: DataFrame, spread: int = 3, min_chars: int = 20) -> DataFrame:
    """(k, spans) of `docs` (k, text): the (s, e) line spans to remove, verified byte by byte."""
    cut = docs.select("k", F.split("text", "\n").alias("lines"))
    cut = cut.select("k", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.length(F.trim(x))).alias("n"))
    ends, pairs = _chunks(spread)
    cut = cut.select("k", "h", "n", ends.alias("ends")).select("k", "h", "n", pairs(F.col("ends")).alias("c"))
    long = lambda c: (c["e"] > c["s"]) & (F.aggregate(F.slice("n", c["s"] + 1, c["e"] - c["s"] + 1), F.lit(0), lambda a, x: a + x) >= min_chars)
    cut = cut.select("k", F.explode(F.transform(F.filter("c", long), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.xxhash64(F.slice("h", c["s"] + 1, c["e"] - c["s"] + 1)).alias("g")))).alias("c")).select("k", "c.*")
    first = cut.groupBy("g").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("k", "s")).alias("first")).where("many > 1")
    first = written(first, "repeated")  # so that both sides of the join below are shuffled for it, and a hot chunk can be split
    need = cut.join(first, "g").select("k", F.struct("s", "e", "g", (F.struct("k", "s") == F.col("first")).alias("first")).alias("c"))
    need = need.groupBy("k").agg(F.collect_set("c").alias("cs"))
    seen = docs.join(need, "k").select("k", F.split("text", "\n").alias("lines"), F.explode("cs").alias("c"))
    seen = seen.select("k", "c.*", F.array_join(F.slice("lines", F.col("c.s") + 1, F.col("c.e") - F.col("c.s") + 1), "\n").alias("chunk"))
    origin = seen.where("first").select("g", F.col("chunk").alias("origin"), F.col("k").alias("k0"), F.col("s").alias("s0"))
    again = seen.where("not first").join(origin, ["g"]).where("chunk = origin")
    return again.groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def repeated_runs(docs: DataFrame, min_chars: int = 20, long_chars: int = 200) -> DataFrame:
    """(k, spans) of `docs` (k, text): (s, e) line spans to remove, apart from each other, their lines compared byte by byte.

    A run counts with two lines that aren't blank and `min_chars` characters, or with a line of `long_chars`.
    """
    cut = docs.select("k", F.split("text", "\n").alias("lines"))
    cut = cut.select("k", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.length(F.trim(x))).alias("n"))
    window = lambda i, j: F.struct(i.alias("s"), j.alias("e"), F.get("h", i).alias("g"), F.get("h", j).alias("g2"))
    each = F.sequence(F.lit(0), F.size("h") - 1)
    two = F.transform(F.filter(each, lambda i: i < F.size("h") - 1), lambda i: window(i, i + 1))
    one = F.transform(F.filter(each, lambda i: F.get("n", i) >= long_chars), lambda i: window(i, i))
    cut = cut.select("k", F.explode(F.concat(two, one)).alias("c")).select("k", "c.*", (F.col("c.e") > F.col("c.s")).alias("wide"))
    meet = ["g", "g2", "wide"]
    first = cut.groupBy(*meet).agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("k", "s")).alias("first")).where("many > 1").drop("many")
    first = written(first, "repeated")  # so that both sides of the join below are shuffled for it, and a hot window can be split
    again = cut.join(first, meet).groupBy("k").agg(F.collect_list(F.struct("s", "e", (F.struct("k", "s") == F.col("first")).alias("first"))).alias("cs"))
    seen = written(docs.join(again, "k").select("k", "cs", _lines_of("cs").alias("ls")), "windows")
    # a hash that stands for two texts removes nothing
    texts = seen.select(F.explode("ls").alias("l")).select(F.xxhash64("l.line").alias("g"), "l.line")
    bad = texts.groupBy("g").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").agg(F.collect_set("g").alias("bad"))
    seen = seen.crossJoin(F.broadcast(bad))
    fine = lambda i: F.exists("ls", lambda x: (x["i"] == i) & ~F.array_contains("bad", F.xxhash64(x["line"])))
    gone = F.filter("cs", lambda c: ~c["first"] & ((F.size("bad") == 0) | (fine(c["s"]) & fine(c["e"]))))
    runs = F.aggregate(
        F.array_sort(F.transform(gone, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))), F.expr("cast(array() as array<struct<s: int, e: int>>)"),
        lambda a, c: F.when((F.size(a) > 0) & (c["s"] <= F.element_at(a, -1)["e"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], c["e"]).alias("e"))))).otherwise(F.concat(a, F.array(c))),
    )
    sizes = lambda r: F.filter(F.transform(F.filter("ls", lambda x: (x["i"] >= r["s"]) & (x["i"] <= r["e"])), lambda x: F.length(F.trim(x["line"]))), lambda n: n > 0)
    enough = lambda n: ((F.size(n) > 1) & (F.aggregate(n, F.lit(0), lambda a, x: a + x) >= min_chars)) | F.exists(n, lambda x: x >= long_chars)
    return seen.select("k", "ls", runs.alias("runs")).select("k", F.filter("runs", lambda r: enough(sizes(r))).alias("spans")).where("size(spans) > 0").groupBy("k").agg(F.first("spans").alias("spans"))


def _lines_of(windows: str):
    """array<struct<i, line>>: the lines of `text` within the windows, once each."""
    at = F.array_sort(F.array_distinct(F.flatten(F.transform(windows, lambda c: F.array(c["s"], c["e"])))))
    lines = F.split("text", "\n")
    return F.transform(at, lambda i: F.struct(i.alias("i"), F.get(lines, i).alias("line")))


def dedup_lines(docs: DataFrame, spread: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """`docs` with repeated chunks cut from the text; all rows stay, columns as they were (`counts` adds n_lines, n_removed_lines).

    A chunk's first occurrence stays. Rows that share doc_id and text count as one document; a null doc_id is an id like
    any other (the first). Null texts stay null and empty ones empty; a text all of whose lines go becomes empty.
    """
    return _without(docs, lambda keyed: repeated_chunks(keyed, spread, min_chars), id_col, text_col, counts)


def dedup_runs(docs: DataFrame, min_chars: int = 20, long_chars: int = 200, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """`docs` with every repeated run of lines cut from the text but for its first occurrence; rows and columns as in dedup_lines."""
    return _without(docs, lambda keyed: repeated_runs(keyed, min_chars, long_chars), id_col, text_col, counts)


def _without(docs: DataFrame, find, id_col: str, text_col: str, counts: bool) -> DataFrame:
    """`docs` without the spans that `find` gives for (k, text)."""
    key, spans = column_name(docs, "line_key"), column_name(docs, "line_spans")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h")))
    cut = find(keyed.where(F.col(text_col).isNotNull()).select(F.col(key).alias("k"), F.col(text_col).alias("text")))
    out = keyed.join(cut.select(F.col("k").alias(key), F.col("spans").alias(spans)), key, "left")
    lines = F.split(F.col(text_col), "\n")
    left = F.filter(lines, lambda _, i: ~F.exists(F.col(spans), lambda s: (s["s"] <= i) & (i <= s["e"])))
    text = F.when(F.col(spans).isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text_col))
    if counts:
        gone = F.coalesce(F.aggregate(F.col(spans), F.lit(0), lambda a, s: a + s["e"] - s["s"] + 1), F.lit(0))
        return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), gone.cast("long").alias("n_removed_lines"))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
