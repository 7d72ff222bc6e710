"""Items in order cut into chunks of a budget of bytes: a chunk closes when the next item would not fit.

Where a chunk closes hangs on all items before it. Each range of items is summed up as a function of the bytes that come
in with an open chunk: which of its first items closes that chunk, and from there how many chunks close and what goes
out. Functions of neighbours compose, a few at a time, level by level; back down, every range learns what comes in, and
cuts its items by itself. No task sees more than one range, or the functions of a few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens.sources.shared import discard, written

_FAN = 16
_FUNCTION = "part long, steps array<long>, closed array<long>, carry array<long>, total long"


def _next_starts(sums: np.ndarray, budget: int) -> np.ndarray:
    """For each item that starts a chunk, the item that starts the next one (or their number)."""
    before = np.concatenate([[0], sums[:-1]])
    return np.maximum(np.searchsorted(sums, before + budget, side="right"), np.arange(1, len(sums) + 1))


def summed_up(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(steps, closed, carry, total) of a range: with c bytes coming in, the first i with c + steps[i] > budget closes the chunk,
    then closed[i] chunks have closed by the end of the range and carry[i] bytes go out; without such an i, c + total go out.
    """
    sums = np.cumsum(sizes)
    nexts, n = _next_starts(sums, budget), len(sizes)
    closed, carry = np.ones(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        j = nexts[i]
        closed[i], carry[i] = (closed[j] + 1, carry[j]) if j < n else (1, sums[-1] - (sums[i] - sizes[i]))
    many = min(n, int(np.searchsorted(sums, budget, side="right")) + 1)
    return sums[:many], closed[:many], carry[:many], int(sums[-1]) if n else 0


def applied(function: tuple, coming: int, budget: int) -> tuple[int, int]:
    """(chunks closed, bytes going out) of a function for the bytes coming in."""
    steps, closed, carry, total = function
    i = int(np.searchsorted(steps, budget - coming, side="right"))
    return (int(closed[i]), int(carry[i])) if i < len(steps) else (0, coming + total)


def composed(first: tuple, second: tuple, budget: int) -> tuple:
    """The function of two neighbours."""
    steps, closed, carry, total = first
    after = [applied(second, int(c), budget) for c in carry]
    closed, carry = closed + np.array([x for x, _ in after], dtype=np.int64), np.array([x for _, x in after], dtype=np.int64)
    if not len(steps) or steps[-1] <= budget:  # a chunk may come through the first range unclosed
        more = second[0] + total
        many = min(len(more), int(np.searchsorted(more, budget, side="right")) + 1)
        steps, closed, carry = np.append(steps, more[:many]), np.append(closed, second[1][:many]), np.append(carry, second[2][:many])
    return steps, closed, carry, total + second[3]


def _functions(table: pa.Table) -> list[tuple]:
    table = table.sort_by("part")
    lists = [[np.array(x, dtype=np.int64) for x in table.column(c).to_pylist()] for c in ("steps", "closed", "carry")]
    return list(zip(*lists, table.column("total").to_pylist(), strict=True))


def byte_chunks(items: DataFrame, budget: int, size_col: str = "size", order: tuple[str, ...] = ("pos",), ranges: int | None = None) -> DataFrame:
    """`items` with `chunk`, from 0 in the order of the columns `order` (which no two items share).

    A chunk takes items as long as they fit `budget`; an item above it is a chunk of its own, or starts one that takes
    only items of no size. Null sizes count as 0. `ranges`: how many ranges of items to form, by default as many as Spark
    shuffles into. Empty in, empty out.
    """
    if budget < 0:
        raise ValueError("the budget can't be negative")
    spark = items.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    dealt = items.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumns({"size_": size, "at_": F.monotonically_increasing_id()})
    dealt = written(dealt.withColumn("part_", F.shiftright("at_", 33)), "items")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pairs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                steps, closed, carry, total = summed_up(pairs.values.field("size").to_numpy(), budget)
                yield pa.record_batch([pa.array([part]), pa.array([steps]), pa.array([closed]), pa.array([carry]), pa.array([total])], names=["part", "steps", "closed", "carry", "total"])

    sizes = dealt.groupBy("part_").agg(F.array_sort(F.collect_list(F.struct(F.col("at_").alias("at"), F.col("size_").alias("size")))).alias("pairs"))
    levels = [written(sizes.mapInArrow(sum_up, _FUNCTION), "functions")]

    def compose(table: pa.Table) -> pa.Table:
        held = _functions(table)
        out = held[0]
        for f in held[1:]:
            out = composed(out, f, budget)
        part = min(table.column("part").to_pylist()) // _FAN
        return pa.table({"part": pa.array([part], pa.int64()), "steps": [out[0]], "closed": [out[1]], "carry": [out[2]], "total": pa.array([out[3]], pa.int64())}, schema=pa.schema([("part", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("steps", "closed", "carry")], ("total", pa.int64())]))

    while (levels[-1].agg(F.max("part")).first()[0] or 0) > 0:
        levels.append(written(levels[-1].groupBy(F.floor(F.col("part") / _FAN)).applyInArrow(compose, _FUNCTION), "functions"))

    # what comes in: before the first item a chunk is closed that isn't counted
    known = spark.createDataFrame([(0, budget + 1, -1)], "parent long, coming long, before long")

    def descend(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        coming, before = table.column("coming")[0].as_py(), table.column("before")[0].as_py()
        out = []
        for part, f in zip(table.column("part").to_pylist(), _functions(table), strict=True):
            out.append((part, coming, before))
            closed, coming = applied(f, coming, budget)
            before += closed
        return pa.table(dict(zip(("parent", "coming", "before"), (pa.array(x, pa.int64()) for x in zip(*out, strict=True)), strict=True)))

    for level in levels[::-1]:
        joined = level.withColumn("parent", F.floor(F.col("part") / _FAN)).join(known, "parent")
        known = written(joined.groupBy("parent").applyInArrow(descend, "parent long, coming long, before long"), "coming")
    # the top level's own row is its own parent, 0; each level gives the parents of the one below

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, coming, before in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                values = pairs.values
                sizes = values.field("size").to_numpy()
                sums = np.cumsum(sizes)
                nexts, starts = _next_starts(sums, budget), []
                at = int(np.searchsorted(sums, budget - coming, side="right"))
                while at < len(sizes):
                    starts.append(at)
                    at = int(nexts[at])
                chunk = before + np.searchsorted(np.array(starts, dtype=np.int64), np.arange(len(sizes)), side="right")
                yield pa.record_batch([values.field("at"), pa.array(chunk.astype(np.int64))], names=["at_", "chunk"])

    placed = sizes.join(known.withColumnRenamed("parent", "part_"), "part_").select("pairs", "coming", "before").mapInArrow(cut, "at_ long, chunk long")
    out = dealt.join(placed, "at_").drop("size_", "at_", "part_")
    discard(*levels)
    return out
