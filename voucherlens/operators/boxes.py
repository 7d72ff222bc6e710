"""Boxes of detected labels: which count, which are one label seen twice, and in what order they are read."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voucherlens.sources.shared import discard, written

# The classes that hold text, and what a contour's box may measure.
CLASSES = ["label", "barcode"]
LEAST_AREA, MOST_AREA, LEAST_ASPECT, MOST_ASPECT = 0.003, 0.60, 0.1, 20.0
OVERLAP = 0.15


def text_boxes(boxes: DataFrame, classes: Iterable[str] = CLASSES) -> DataFrame:
    """The boxes (…, cls, …) of classes that hold text."""
    return boxes.where(F.col("cls").isin(list(classes)))


def label_like(contours: DataFrame) -> DataFrame:
    """Contours (x, y, w, h, width, height of the image) that a label may have: their share of the image and their shape. Null sizes go."""
    area, whole = F.col("w") * F.col("h"), F.col("width") * F.col("height")
    shape = F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(F.lit(0.0))
    return contours.where((area > LEAST_AREA * whole) & (area < MOST_AREA * whole) & shape.between(LEAST_ASPECT, MOST_ASPECT))


def padded(contours: DataFrame, padding: int = 12) -> DataFrame:
    """`contours` with x1, y1, x2, y2: the box with some room around it, within the image."""
    zero = F.lit(0)
    return contours.withColumns({
        "x1": F.greatest(zero, F.col("x") - padding), "y1": F.greatest(zero, F.col("y") - padding),
        "x2": F.least("width", F.col("x") + F.col("w") + padding), "y2": F.least("height", F.col("y") + F.col("h") + padding),
    })


def reading_order(boxes: DataFrame, image: str = "image", line: int = 100) -> DataFrame:
    """`boxes` with `place`, from 0 in each image: by lines of `line` pixels from the top, then from the left; ties by the other corners and `pos`, if there is one."""
    order = Window.partitionBy(image).orderBy(F.floor(F.col("y1") / line), *[c for c in ("x1", "y1", "x2", "y2", "pos") if c in boxes.columns])
    return boxes.withColumn("place", F.row_number().over(order) - 1)


def merged_in_order(boxes: list[tuple[int, int, int, int]], overlap: float = OVERLAP) -> list[tuple[tuple[int, int, int, int], list[int]]]:
    """Boxes that overlap by `overlap` of the smaller one become one that holds both, over and over; with the places of their members.

    The first box takes in later ones as it grows, then the second, and again from the start until nothing changes.
    """
    left = [(*b, (b[2] - b[0]) * (b[3] - b[1]), [i]) for i, b in enumerate(boxes)]
    changed = True
    while changed:
        changed, i = False, 0
        while i < len(left):
            a1, b1, a2, b2, size, own = left[i]
            j = i + 1
            while j < len(left):
                c1, d1, c2, d2, other, theirs = left[j]
                wide = (a2 if a2 < c2 else c2) - (a1 if a1 > c1 else c1)
                high = (b2 if b2 < d2 else d2) - (b1 if b1 > d1 else d1)
                if wide > 0 and high > 0 and wide * high >= overlap * (size if size < other else other):
                    a1, b1, a2, b2, own = min(a1, c1), min(b1, d1), max(a2, c2), max(b2, d2), own + theirs
                    size = (a2 - a1) * (b2 - b1)
                    left[i] = (a1, b1, a2, b2, size, own)
                    del left[j]
                    changed = True
                else:
                    j += 1
            i += 1
    return [(x[:4], x[5]) for x in left]


def _clusters(boxes: DataFrame, cell: int, max_rounds: int) -> DataFrame:
    """(image, cls, pos, cluster): boxes that may come to meet while boxes grow; the clusters' own boxes don't overlap.

    Clusters start as boxes and join by the cells of a grid that they cover: each goes to the first it overlaps, and
    grows with it. Rounds go on until no two overlap, and each is written, so that lineage stays short.
    """
    key = ["image", "cls"]
    members = written(boxes.select(*key, "pos", F.col("pos").alias("cluster")), "members")
    now = written(boxes.select(*key, F.col("pos").alias("cluster"), "x1", "y1", "x2", "y2"), "clusters")
    for _ in range(max_rounds):
        spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell)))
        cells = now.where("x1 < x2 and y1 < y2").withColumn("cx", spread("x1", "x2")).withColumn("cy", spread("y1", "y2"))
        other = cells.select(*key, "cx", "cy", *[F.col(c).alias(f"{c}_") for c in ("cluster", "x1", "y1", "x2", "y2")])
        meets = "cluster_ < cluster and x1 < x2_ and x1_ < x2 and y1 < y2_ and y1_ < y2"
        first = cells.join(other, [*key, "cx", "cy"]).where(meets).groupBy(*key, "cluster").agg(F.min("cluster_").alias("into"))
        first = written(first, "joins")
        if first.isEmpty():
            return members
        joined = now.join(first, [*key, "cluster"], "left").withColumn("cluster", F.coalesce("into", "cluster"))
        grown = joined.groupBy(*key, "cluster").agg(*[F.min(c).alias(c) for c in ("x1", "y1")], *[F.max(c).alias(c) for c in ("x2", "y2")])
        new, moved = written(grown, "clusters"), written(members.join(first, [*key, "cluster"], "left").select(*key, "pos", F.coalesce("into", "cluster").alias("cluster")), "members")
        discard(now, members, first)
        now, members = new, moved
    raise RuntimeError(f"boxes still met after {max_rounds} rounds")


def _merged(overlap: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's boxes, ordered by image, cls, cluster and pos, with those of a cluster merged: many clusters at a time, the last of a batch kept until its end is seen."""
    sides = ("x1", "y1", "x2", "y2")

    def merge(table: pa.Table) -> pa.RecordBatch:
        columns = [table.column(c).to_numpy() for c in sides]
        starts = np.concatenate([[0], _changes(table) + 1])
        sizes = np.diff(np.concatenate([starts, [table.num_rows]]))
        # a box alone stays as it is
        keep, members = [starts[sizes == 1]], [np.ones(int((sizes == 1).sum()), "int64")]
        boxes, firsts, counts, merged = list(zip(*[c.tolist() for c in columns], strict=True)), [], [], []
        for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            for box, own in merged_in_order(boxes[a : a + n], overlap):
                firsts.append(a + min(own))
                counts.append(len(own))
                merged.append(box)
        at = np.concatenate([*keep, np.array(firsts, "int64")])
        grown = np.array(merged, "int64").reshape(-1, 4)
        out = {c: np.concatenate([x[keep[0]], grown[:, i]]) for i, (c, x) in enumerate(zip(sides, columns, strict=True))}
        head = table.select(["image", "cls", "pos"]).take(pa.array(at)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(pa.concat_arrays(head.column(c).chunks) for c in ("image", "cls", "pos")), pa.array(np.concatenate([*members, np.array(counts, "int64")])), *map(pa.array, out.values())], names=["image", "cls", "pos", "members", *sides])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch])
            ends = _changes(table)
            if len(ends) == 0:
                held.append(batch)
                continue
            # rows of this batch that belong to clusters whose end is seen
            n = int(ends[-1]) + 1 - (1 if held else 0)
            yield merge(pa.Table.from_batches([*held, batch.slice(0, n)]))
            held = [batch.slice(n)]
        if held:
            yield merge(pa.Table.from_batches(held))

    return run


def _changes(table: pa.Table) -> np.ndarray:
    """Places of rows that the next row's image, class or cluster differs from."""
    n = table.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for c in ("image", "cls", "cluster"):
        column = table.column(c)
        new |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy() if n > 1 else False
    return np.flatnonzero(new)


def merge_boxes(boxes: DataFrame, overlap: float = OVERLAP, cell: int = 512, max_rounds: int = 100, few: int = 64) -> DataFrame:
    """(image, cls, pos, members, x1, y1, x2, y2) of (image, cls, pos, x1, y1, x2, y2) boxes: detections of one label made one box.

    Within an image and class, by `merged_in_order` in the order of `pos` (distinct there). Up to `few` boxes of an image
    and class are held against each other as they are. Where there are more, only boxes that some growing box can reach
    are: they fall into clusters first, over a grid. A task goes through many images or clusters, one at a time. pos is
    the first member's, members how many there were. Boxes without area stay as they are; rows with a null go. Empty in,
    empty out.
    """
    rows = boxes.select("image", "cls", *[F.col(c).cast("long").alias(c) for c in ("pos", "x1", "y1", "x2", "y2")]).dropna()
    kinds = dict(rows.dtypes)
    schema = f"image {kinds['image']}, cls {kinds['cls']}, pos long, members long, x1 long, y1 long, x2 long, y2 long"
    many = written(rows.groupBy("image", "cls").count().where(F.col("count") > few).select("image", "cls"), "crowded")
    groups = rows.withColumn("cluster", F.lit(0).cast("long"))
    if not many.isEmpty():
        crowded = written(rows.join(many, ["image", "cls"], "left_semi"), "boxes")
        groups = rows.join(many, ["image", "cls"], "left_anti").withColumn("cluster", F.lit(0).cast("long"))
        groups = groups.unionByName(crowded.join(_clusters(crowded, cell, max_rounds), ["image", "cls", "pos"]))
    dealt = groups.select("image", "cls", "cluster", "pos", "x1", "y1", "x2", "y2").repartition("image", "cls", "cluster").sortWithinPartitions("image", "cls", "cluster", "pos")
    return dealt.mapInArrow(_merged(overlap), schema)
