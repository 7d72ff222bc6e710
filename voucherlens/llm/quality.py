"""Quality rules with risk-controlled thresholds.

Method: labelled documents are split by a hash into a fitting half and a holdout. The fitting half gives each rule a
reference value (a high quantile of it over good documents); a document's badness is the largest of its rule values over
their references. On the holdout, each stratum tests each cutoff of a fixed grid with an exact binomial bound: a cutoff
is admissible if "more than `risk` of good documents are rejected" is refuted at level `delta` divided by the number of
strata times cutoffs tested (Bonferroni). Of the admissible ones, that with the greatest catch of bad documents less
false rejections is used, the mildest on a tie; a stratum without one rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import written

WINDOW = 8
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_same_next"]
_SPACE, _SYMBOLS, _CAPITALS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
#: rule -> (numerator, denominator, least reference)
RULES = {
    "symbols": ("n_symbols", "word_chars", 0.01),
    "capitals": ("n_upper", "word_chars", 0.15),
    "stutter": ("n_same_next", "n_words", 0.05),
    "repeated_lines": ("n_dup_lines", "n_lines", 0.2),
    "repeated_windows": ("n_repeat_words", "n_words", 0.15),
    "word_length": ("word_chars", "n_words", 6.0),
}
GRID = [1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0]


def counts(text: str | None) -> tuple[int, ...]:
    """The values of _COUNTS of one whole text; all 0 where it is null."""
    if not text:
        return (0,) * len(_COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    tokens = raw.split()
    n = len(tokens)
    lines, seen, doubles = 0, set(), 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            doubles += line in seen
            seen.add(line)
    repeated = 0
    if n > WINDOW:
        joined = b" ".join(tokens)
        ends = np.cumsum([len(x) + 1 for x in tokens])
        starts = [0, *ends[: n - WINDOW].tolist()]
        windows = [joined[a:b] for a, b in zip(starts, (ends[WINDOW - 1 :] - 1).tolist(), strict=True)]
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            marks = np.zeros(n + 1, dtype=np.int64)
            for i, w in enumerate(windows):
                if often[w] > 1:
                    marks[i] += 1
                    marks[i + WINDOW] -= 1
            repeated = int((np.cumsum(marks) > 0).sum())
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols, upper = (len(raw) - len(raw.translate(None, x)) for x in (_SYMBOLS, _CAPITALS))
    return n, chars, symbols, doubles, repeated, lines, upper, sum(map(eq, tokens, tokens[1:]))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = "lang") -> DataFrame:
    """(doc_id, stratum, counts...) for every row; a null stratum is one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts(x.as_py()) for x in batch.column(2)], dtype=np.int64).reshape(-1, len(_COUNTS))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1), *[pa.array(rows[:, i].copy()) for i in range(len(_COUNTS))]], names=["doc_id", "stratum", *_COUNTS])

    level = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("none")) if stratum else F.lit("all")
    return docs.select(id_col, level.alias("stratum"), text_col).mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS))


def base_failed() -> Column:
    """Too short, or too much of it in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _value(rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.coalesce(F.col(top) / F.nullif(F.col(bottom), F.lit(0)), F.lit(0.0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly but for rounding.

    Terms fall away from the mean, so either tail's sum ends where they no longer count: its length is some square roots of n.
    """
    if k < 0 or k >= n:
        return float(k >= n)
    low = k < n * p
    i = k if low else k + 1
    term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = 0.0
    while term > total * 1e-18 and 0 <= i <= n:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p) if low else (n - i) * p / ((i + 1) * (1 - p))
        i += -1 if low else 1
    return min(1.0, total) if low else max(0.0, 1 - total)


def choose(good: list[int], bad: list[int], n_good: int, n_bad: int, risk: float, level: float) -> float:
    """The cutoff of GRID to use, given how many good and bad holdout documents exceed each; infinity if none may be."""
    best, cut = 0.0, math.inf
    for j in reversed(range(len(GRID))):
        if n_good and n_bad and binomial_tail(good[j], n_good, risk) <= level:
            gain = bad[j] / n_bad - good[j] / n_good
            if gain > best:
                best, cut = gain, GRID[j]
    return cut


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> tuple[dict[str, float], DataFrame]:
    """Reference values by rule, and (stratum, cutoff). `label_col`: 1 good, 0 bad; documents labelled both ways count as bad."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("good"))
    marked = stats.where(~base_failed()).join(marks, "doc_id").withColumn("fit", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    marked = written(marked.select("stratum", "good", "fit", *[_value(r).alias(r) for r in RULES]), "labelled")
    row = marked.where("fit and good = 1").agg(*[F.percentile_approx(r, 0.995, 10_000).alias(r) for r in RULES]).first()
    refs = {r: max(least, row[r] or 0.0) for r, (_, _, least) in RULES.items()}
    held = marked.where("not fit").withColumn("badness", badness(refs, {r: F.col(r) for r in RULES}))
    many = held.select("stratum").distinct().count() * len(GRID)
    sums = held.groupBy("stratum").agg(
        F.count_if(F.col("good") == 1).alias("n_good"), F.count_if(F.col("good") != 1).alias("n_bad"),
        F.array(*[F.count_if((F.col("good") == 1) & (F.col("badness") > g)) for g in GRID]).alias("good"),
        F.array(*[F.count_if((F.col("good") != 1) & (F.col("badness") > g)) for g in GRID]).alias("bad"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cuts = [choose(list(r.good), list(r.bad), r.n_good, r.n_bad, risk, delta / many) for r in f.itertuples()]
            yield pd.DataFrame({"stratum": f["stratum"], "cutoff": cuts})

    return refs, written(sums.mapInPandas(run, "stratum string, cutoff double"), "cutoffs")


def badness(refs: dict[str, float], values: dict[str, Column]) -> Column:
    return F.greatest(*[values[r] / F.lit(refs[r]) for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = "lang") -> DataFrame:
    """(doc_id, counts..., base_failed, badness, cutoff, kept) for every row of `docs`.

    Null and blank texts have no words and fail the base rules. A stratum that no label covers keeps what passes them.
    """
    stats = written(statistics(docs, id_col, text_col, stratum), "statistics")
    refs, cuts = cutoffs(stats, labels, risk, delta)
    out = stats.join(cuts, "stratum", "left").withColumn("base_failed", base_failed())
    out = out.withColumn("badness", badness(refs, {r: _value(r) for r in RULES}))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("badness") > F.col("cutoff"), F.lit(False)))
