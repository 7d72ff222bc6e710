"""What several corpus operators share: the shared folder, written tables, graph components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens.sources.shared import discard, shared_dir, written

__all__ = ["column_name", "connected_components", "discard", "held_out", "shared_dir", "written"]


def column_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or it with underscores appended until no column of `df` has that name (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def held_out(id_col: str) -> F.Column:
    """True where crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over `edges` (src, dst longs), for every node with an edge.

    Alternates large-star and small-star steps on a written edge table until it no longer changes. A hub's edges
    stay spread out: the minimum of a neighbourhood is a partial aggregate, and the join back is one that adaptive
    execution may split. Nulls are dropped; self-loops and repeated edges are harmless; empty in, empty out.
    """
    both = edges.where("src is not null and dst is not null and src <> dst")
    now = written(both.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        way = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = way.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = way.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now, old = written(small, "edges"), now
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
