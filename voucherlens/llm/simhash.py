"""SimHash near-duplicate detection.

Method: tiled exact comparison. Distinct fingerprints are sorted into cells by their population counts (of the four
16-bit quarters, whose differences sum to no more than the differing bits), cells are cut into tiles of bounded size,
and only pairs of tiles whose counts are within the radius are compared, by numpy exclusive-or and bit counts. A tile
pair emits a spanning forest of its links, not all of them, so a group of near copies costs rows in proportion to its
size; components of the union of forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import connected_components, written

SEED = 42
_QUARTERS = [(a, b, c, d) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) for d in range(-2, 3)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over word shingles, A-Z lower-cased; 0 without a word. Repeats count as often as they occur."""
    import xxhash

    if not text:
        return 0
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(x) + 1 for x in tokens])
    starts = (ends - [len(x) + 1 for x in tokens])[:n].tolist()
    stops = (ends[min(words, len(tokens)) - 1 :] - 1)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # a slice at a time: a very long text needs no more memory than this
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row of `docs`; a null or blank text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all links within `radius` between `a` and `b` (the same array: within it)."""
    same = np.array_equal(a, b)
    both, shift = (a, 0) if same else (np.concatenate([a, b]), len(a))
    parent = list(range(len(both)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for at in range(0, len(a), 64):
        near = np.bitwise_count(a[at : at + 64, None] ^ b[None, :]) <= radius
        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True):
            x, y = root(at + i), root(shift + j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((at + i, shift + j))
    return [(int(both[x]), int(both[y])) for x, y in edges]


def links(fps: DataFrame, radius: int = 2, tile: int = 2048) -> DataFrame:
    """(src, dst) fingerprints: a spanning forest, per pair of tiles, of the links within `radius` bits. `fps`: distinct `fp`.

    Only radii up to 2 list their neighbouring cells here.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    quarter = lambda i: F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int")
    celled = fps.select("fp", (quarter(0) + 32 * quarter(1) + 1024 * quarter(2) + 32768 * quarter(3)).alias("cell"))
    cells = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("k"))
    cells = written(cells, "cells")
    tiles = celled.join(cells, "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int").alias("tile")).agg(F.collect_list("fp").alias("fps"))
    tiles = written(tiles, "tiles")
    steps = sorted({a + 32 * b + 1024 * c + 32768 * d for a, b, c, d in _QUARTERS if abs(a) + abs(b) + abs(c) + abs(d) <= radius})
    near = cells.select(F.col("cell").alias("a"), F.col("k").alias("ka"), F.explode(F.array(*map(F.lit, [x for x in steps if x >= 0]))).alias("step"))
    near = near.withColumn("b", F.col("a") + F.col("step")).join(cells.select(F.col("cell").alias("b"), F.col("k").alias("kb")), "b")
    pairs = near.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("ta"), "kb")
    pairs = pairs.select("a", "b", "ta", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("tb")).where("a <> b or ta <= tb")
    left = tiles.select(F.col("cell").alias("a"), F.col("tile").alias("ta"), F.col("fps").alias("fa"))
    right = tiles.select(F.col("cell").alias("b"), F.col("tile").alias("tb"), F.col("fps").alias("fb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fa, fb in zip(batch.column(0), batch.column(1), strict=True):
                out += forest(fa.values.to_numpy().view(np.uint64), fb.values.to_numpy().view(np.uint64), radius)
            sides = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([pa.array(sides[:, 0].copy()), pa.array(sides[:, 1].copy())], names=["src", "dst"])

    return pairs.join(left, ["a", "ta"]).join(right, ["b", "tb"]).select("fa", "fb").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", words: int = 3, tile: int = 2048) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for every row of `docs`.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits, the row's own included.
    Texts without a word share fingerprint 0 and link like any other. Rows with a null doc_id are kept, take part with
    their fingerprint, and get the component of those they link to (null if all of it is null). Empty in, empty out.
    """
    found = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    reps = written(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    edges = links(reps.select("fp"), radius, tile)
    parts = connected_components(edges)
    of = reps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    of = written(of, "classes")
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = of.join(least, "root").select("fp", "component_id")
    return found.join(of, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_WORDS = 4  # of 64 bits, in the wide fingerprints that find candidates for a similarity


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles, A-Z lower-cased; the whole text where it is shorter, none without a word."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(x) + 1 for x in tokens])
    starts = (ends - [len(x) + 1 for x in tokens])[:n].tolist()
    stops = (ends[min(words, len(tokens)) - 1 :] - 1)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=n))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256-bit SimHash of a set of hashes, as four words: further bits come from mixing the hashes again."""
    out = np.zeros(_WORDS, dtype=np.uint64)
    for w in range(_WORDS):
        ones, mixed = np.zeros(64, dtype=np.int64), hashes + np.uint64((0x9E3779B97F4A7C15 * w) % (1 << 64))
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        for at in range(0, len(mixed), 1 << 16):
            ones += np.unpackbits(mixed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = ((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum()
    return out


def candidates(fa: np.ndarray, na: np.ndarray, fb: np.ndarray, nb: np.ndarray, per_mille: int, radius: int, first: int, same: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of `fa` with the rows of `fb` (n x 4 words) within `radius` bits, `first` of them in the first word, whose set sizes allow the similarity."""
    other = np.ascontiguousarray(fb[:, 0])
    for at in range(0, len(fa), 64):
        i, j = np.nonzero(np.bitwise_count(fa[at : at + 64, :1] ^ other[None, :]) <= first)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        keep = 1000 * np.minimum(na[i], nb[j]) >= per_mille * np.maximum(na[i], nb[j])
        i, j = i[keep], j[keep]
        keep = np.bitwise_count(fa[i] ^ fb[j]).sum(axis=1, dtype=np.int64) <= radius
        i, j = i[keep], j[keep]
        cuts = np.flatnonzero(np.diff(i)) + 1
        for x, y in zip(np.split(i, cuts), np.split(j, cuts), strict=True):
            if len(x):
                yield int(x[0]), y


def similar(sets: list[np.ndarray], side: np.ndarray, fps: np.ndarray, per_mille: int, radius: int, first: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the candidates whose sets have a Jaccard similarity of `per_mille` thousandths or more.

    Links go from side 0 to side 1, or within side 0 where no row has side 1.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = not len(right)
    right = left if same else right
    label, mark, edges = np.arange(len(sets)), np.zeros(len(values), dtype=np.int64), []
    for i, j in candidates(fps[left], sizes[left], fps[right], sizes[right], per_mille, radius, first, same):
        i, j = int(left[i]), right[j]
        j = j[label[j] != label[i]]
        if not len(j):
            continue
        mark[own[i]] = 1
        shared = np.array([int(mark[own[x]].sum()) for x in j])
        mark[own[i]] = 0
        for x in j[(1000 + per_mille) * shared >= per_mille * (sizes[i] + sizes[j])].tolist():
            if label[x] != label[i]:
                label[label == label[x]] = label[i]
                edges.append((i, x))
    return edges


def near_copies(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", words: int = 5, tile: int = 8192, radius: int = 80, first: int = 26) -> DataFrame:
    """(doc_id, component_id) for every row of `docs`: components over links of a Jaccard similarity of word shingles of `similarity` or more.

    Candidates are sets of shingles within `radius` bits of a 256-bit SimHash (`first` in its first word) whose sizes allow
    the similarity; each link is then held against the sets themselves. At a similarity of 0.8 some 39 bits are expected
    to differ, with a deviation of 6, so the radius leaves out none to speak of. Texts with equal sets are one node. Nodes
    are compared by tiles, whose sets are read only for those with a candidate. Null ids as in near_duplicates.
    """
    per_mille = round(similarity * 1000)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(x.as_py(), words) for x in part.column(1)]
                nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64).view(np.int64)
                fps = [wide_fingerprint(x).tobytes() for x in sets]
                sizes = pa.array([len(x) for x in sets], pa.int64())
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(nodes), pa.array(fps, pa.binary()), sizes, pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "node", "fp", "n", "hashes"])

    found = written(docs.select(id_col, text_col).mapInArrow(hashed, "doc_id long, node long, fp binary, n long, hashes binary"), "shingles")
    cell = F.floor(F.log("n") / F.log(F.lit(1010 / per_mille))).cast("int")  # sizes that allow the similarity lie in the same or in adjacent cells
    reps = written(found.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max(F.struct("n", "fp")).alias("f")).select("node", "rep", "f.n", "f.fp"), "nodes")
    celled = reps.where("n > 0").select("node", "n", "fp", cell.alias("cell"))
    # both the rows of a tile and the sets a task may hold of it are bounded
    cells = written(celled.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("n") / (1 << 22))).cast("int").alias("k")), "cells")
    tiles = celled.join(F.broadcast(cells), "cell").groupBy("cell", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("tile"))
    tiles = written(tiles.agg(F.collect_list(F.struct("node", "n", "fp")).alias("rows")), "tiles")
    near = cells.select(F.col("cell").alias("a"), F.col("k").alias("ka"), F.explode(F.array(F.lit(0), F.lit(1))).alias("step")).withColumn("b", F.col("a") + F.col("step"))
    near = near.join(cells.select(F.col("cell").alias("b"), F.col("k").alias("kb")), "b").select("a", "b", F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("ta"), "kb")
    pairs = near.select("a", "b", "ta", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("tb")).where("a <> b or ta <= tb")
    pairs = pairs.repartition(F.xxhash64("a", "b", "ta", "tb"))
    left = tiles.select(F.col("cell").alias("a"), F.col("tile").alias("ta"), F.col("rows").alias("ra"))
    right = tiles.select(F.col("cell").alias("b"), F.col("tile").alias("tb"), F.col("rows").alias("rb"))

    def words_of(fps: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(fps), dtype=np.uint64).reshape(-1, _WORDS)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key = [batch.column(c)[row].as_py() for c in range(4)]
                same = key[0] == key[1] and key[2] == key[3]
                sides = [batch.column(c)[row].values for c in (4, 5)]
                nodes, sizes = [x.field("node").to_numpy() for x in sides], [x.field("n").to_numpy() for x in sides]
                fps, hit = [words_of(x.field("fp").to_pylist()) for x in sides], [np.zeros(len(x), dtype=bool) for x in sides]
                for i, j in candidates(fps[0], sizes[0], fps[1], sizes[1], per_mille, radius, first, same):
                    hit[0][i] = hit[1][j] = True
                hit = [hit[0] | hit[1], np.zeros(0, dtype=bool)] if same else hit
                out = [(*key, side, node) for side in (0, 1) for node in (nodes[side][hit[side]].tolist() if len(hit[side]) else [])]
                if out:
                    yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names=["a", "b", "ta", "tb", "side", "node"])

    both = pairs.join(left, ["a", "ta"]).join(right, ["b", "tb"]).select("a", "b", "ta", "tb", "ra", "rb")
    wanted = written(both.mapInArrow(close, "a long, b long, ta long, tb long, side long, node long"), "candidates")
    sets = found.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("fp").alias("fp"), F.first("hashes").alias("hashes"))

    def linked(table: pa.Table) -> pa.Table:
        nodes, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        held = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("hashes")]
        edges = np.array(similar(held, side, words_of(table.column("fp").to_pylist()), per_mille, radius, first), dtype=np.int64).reshape(-1, 2)
        return pa.table({"src": nodes[edges[:, 0]], "dst": nodes[edges[:, 1]]})

    edges = wanted.join(sets, "node").groupBy("a", "b", "ta", "tb").applyInArrow(linked, "src long, dst long")
    parts = connected_components(edges)
    of = written(reps.join(parts, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("root")), "classes")
    of = of.join(of.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("node", "component_id")
    return found.select("doc_id", "node").join(of, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """`docs` without rows whose component has a smaller doc_id; columns as they were. Repeated rows of one doc_id all stay, and so do null ids."""
    groups = near_copies(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), similarity, words=words)
    gone = groups.where("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
