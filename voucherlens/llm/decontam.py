"""Benchmark decontamination, in DataFrame functions only.

Method: a broadcast hash set of normalised test n-grams, a scan of the training documents' token windows, verification
of every hit word by word, then removal of spans or documents. The hash set holds the benchmark's grams of a few words:
a bit array, folded into the plan as a literal whose size is set by the checked number of grams. Every window of n words
covers exactly one position of a grid of step n - gram + 1, so the scan need only look there: no window is missed.
Only grid places in the set go on, with the few words around them; they meet the benchmark's grams in a broadcast of checked
size, or else in a shuffle. A document's hits meet only in its own row, so a passage that a third of the corpus shares makes no hot key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import column_name, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before it


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _gram(tokens: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(tokens, at + i) for i in range(size)])


def _slots(h: Column, many: int) -> list[Column]:
    """The two bit places of a hash in a set of `many` bits."""
    return [F.pmod(h, F.lit(many)), F.pmod(F.shiftright(h, 17).bitwiseXOR(F.shiftleft(h, 5)), F.lit(many))]


def _hash_set(grams: DataFrame, count: int) -> tuple[Column, int]:
    """A set of the gram hashes g as a literal array of 64-bit blocks, 16 to 64 bits to a gram: `count` has been checked."""
    many = 1 << max(12, (64 * count).bit_length() if count <= 100_000 else (16 * count).bit_length())
    places = grams.select("g").distinct().select(*[x.alias(f"s{i}") for i, x in enumerate(_slots(F.col("g"), many))]).toPandas().to_numpy()
    bits = np.zeros(many, dtype=np.uint8)
    bits[places.ravel()] = 1
    blocks = np.packbits(bits, bitorder="little").view("<i8")
    return F.split(F.lit(",".join(map(str, blocks.tolist()))), ",").cast("array<bigint>"), many


def _of_one(f):
    """`f` as a lambda of one argument, as Spark's higher-order functions ask for."""
    return lambda x: f(x)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, gram: int = 4, max_grams: int = 100_000, max_set: int = 4_000_000) -> DataFrame:
    """(k, n_words, spans, items) for each row (k, w) of `docs`: spans are the (start, stop) word positions of windows hit.

    `benchmark` has item_id, w. A window is `n` consecutive item words; an item of fewer, but not none, is one window.
    Beyond `max_grams` gram places, or 64 MB, the grams are no longer sent to all executors: hits in the set are shuffled to
    them. Beyond `max_set` nor is the set: all grid positions are shuffled. The rows are the same.
    """
    items = written(benchmark.where(F.size("w") > 0).select("item_id", "w", F.least(F.size("w"), F.lit(n)).alias("len")).distinct(), "items")
    places = lambda length, size, step: F.when(F.size("w") >= length, F.sequence(F.lit(0), F.size("w") - size, F.lit(step)))
    kind = "array<struct<len:int,p:int,g:bigint>>"
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # n values at most
    grams = None
    for length in lengths:
        size = min(gram, length)
        own = items.where(F.col("len") == length).select("item_id", "len", "w", F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("j"))
        # of the item's words only those of windows that cover the gram
        own = own.select("item_id", "len", "j", F.size("w").alias("many"), _gram(F.col("w"), F.col("j"), size).alias("g"), F.lit(length - size + 1).alias("step"), _near(F.col("w"), F.col("j"), length, size).alias("iw"))
        grams = own if grams is None else grams.unionByName(own)
    if grams is None:
        return docs.select("k", F.size("w").cast("long").alias("n_words"), F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans"), F.lit(None).cast(f"array<{items.schema['item_id'].dataType.simpleString()}>").alias("items"))
    grams = written(grams, "grams")
    count, chars = grams.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.concat_ws(" ", "iw"))), F.lit(0))).first()
    small = count <= max_set
    found = []
    for length in lengths:
        size = min(gram, length)
        grid = places(length, size, length - size + 1)
        if small:
            bits, many = _hash_set(grams.where(F.col("len") == length), count)
            one = lambda s, bits=bits: F.getbit(F.get(bits, F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")) == 1

            def known(p: Column, one=one, many=many, size=size) -> Column:
                a, b = _slots(_gram(F.col("w"), p, size), many)
                return one(a) & one(b)

            grid = F.filter(grid, _of_one(known))
        found.append(F.coalesce(F.transform(grid, _of_one(lambda p, length=length, size=size: F.struct(F.lit(length).alias("len"), p.alias("p"), _gram(F.col("w"), p, size).alias("g")))), F.array().cast(kind)))
    size = F.least(F.lit(gram), F.col("c.len"))
    rows = docs.select("k", "w", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.concat(*found)).alias("c"))
    rows = rows.select("k", "n_words", "c.len", "c.p", "c.g", F.when(F.col("c").isNotNull(), _near(F.col("w"), F.col("c.p"), F.col("c.len"), size)).alias("w"))
    rows = rows.join(F.broadcast(grams) if count <= max_grams and chars <= 1 << 26 else grams, ["len", "g"], "left")
    # the window that covers the gram may begin up to step - 1 words before it, in the item and in the document alike
    low, high = F.greatest(F.lit(0), F.col("j") + F.col("len") - F.col("many")), F.least(F.col("step") - 1, F.col("j"), F.col("p"))
    rows = rows.select("*", F.explode_outer(F.when(low <= high, F.sequence(low, high))).alias("o"))
    before = lambda at: F.least(at, F.col("step") - 1)
    same = F.slice("w", before(F.col("p")) - F.col("o") + 1, F.col("len")) == F.slice("iw", before(F.col("j")) - F.col("o") + 1, F.col("len"))
    rows = rows.select("k", "n_words", F.when(same, F.struct((F.col("p") - F.col("o")).alias("start"), (F.col("p") - F.col("o") + F.col("len")).alias("stop"))).alias("span"), F.when(same, F.col("item_id")).alias("item"))
    return rows.groupBy("k", "n_words").agg(F.collect_set("span").alias("spans"), F.collect_set("item").alias("items"))


def _near(tokens: Column, at: Column, length: Column | int, size: Column | int) -> Column:
    """The words of all windows of `length` that cover the gram of `size` words at `at`: up to length - size before it, and length from it on."""
    length, size = (x if isinstance(x, Column) else F.lit(x) for x in (length, size))
    first = F.greatest(F.lit(0), at - (length - size))
    return F.slice(tokens, first + 1, at - first + length)


def _covered(spans: Column) -> Column:
    """Positions inside any of the (start, stop) spans."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["stop"]).alias("end"))
    return F.coalesce(F.aggregate(F.array_sort(spans), begin, step)["n"], F.lit(0)).cast("long")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(k, n_words, spans, items, n_hit) for each row of `docs`, repeated ones too; k is struct(doc_id, xxhash64(text)).

    A null or blank text has no words; a null doc_id or item_id is a value like any other (a null item_id is not listed).
    """
    keyed = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h")).alias("k"), words(F.col(text_col)).alias("w"))
    tests = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w"))
    # rows that are the same have one row of hits
    return keyed.select("k").join(scan(keyed, tests, n), "k").withColumn("n_hit", _covered(F.col("spans")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without what the benchmark contains; columns as they were.

    remove="documents": rows with a hit go. remove="spans": the words hit go, with the characters between two of them.
    Other rows, null and empty texts among them, are unchanged; an empty benchmark removes nothing.
    """
    hit = report(docs, benchmark, n, id_col, text_col).where("n_hit > 0").select("k", "spans").dropDuplicates(["k"])
    k, spans = column_name(docs, "hit_key"), column_name(docs, "hit_spans")
    keyed = docs.withColumn(k, F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h")))
    hit = hit.select(F.col("k").alias(k), F.col("spans").alias(spans))
    if remove == "documents":
        return keyed.join(hit, k, "left_anti").drop(k).select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")
    joined = keyed.join(hit, k, "left")
    hits = lambda i: F.exists(F.col(spans), lambda s: (s["start"] <= i) & (i < s["stop"]))
    own, gaps = F.regexp_extract_all(F.col(text_col), F.lit(f"({_WORD})"), 1), F.split(F.col(text_col), _WORD)
    piece = lambda gap, i: F.concat(F.when(hits(i) & hits(i - 1), "").otherwise(gap), F.when(hits(i), "").otherwise(F.coalesce(F.get(own, i), F.lit(""))))
    cut = F.when(F.col(spans).isNotNull(), F.array_join(F.transform(gaps, piece), "")).otherwise(F.col(text_col))
    return joined.withColumn(text_col, cut).select(*docs.columns)
