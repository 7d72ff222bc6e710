"""Similarity join of texts by the Jaccard similarity of their sets of word n-grams.

Method: size-aware, heavy and light. Equal sets are one node. For two small sets the words that a link needs in common are
all but a few, so small sets enumerate their subsets of that size, and equal subsets are links. Large sets scan inverted
lists: those of a set's rarest n-grams, of which two linked sets share one. Up to which size a set counts as small is
chosen by cost, from the sizes and the lists' lengths as counted.

N-grams are ordered by counts of hash buckets over all documents (a table of fixed size), so that common passages come
last. A short list gives its pairs; a long one is cut into tiles, and pairs of tiles are compared within a task. Pairs
are held against each other by parity bitmaps first: two sets differ in at least as many members as their bitmaps in
bits, so what lies too far apart is left out for certain. Of the pairs that remain in long lists a spanning forest is
tried, twice, then all whose components still differ, so that a group of near copies costs rows in proportion to its
size. Every link is decided by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import connected_components, discard, written

SEED = 42
_BITS, _SLICES = 20, 64  # of the table of bucket counts
_SMALLEST_HEAVY = 32  # sets of more n-grams are never enumerated: subsets would be tens of thousands a set
_MAX_SENT = 1 << 20  # rows of ids that a broadcast may have (16 MB)
_SHORT, _TILE = 16, 1024  # members of a short list, and of a tile of a long one


class _Hashes(dict):
    """word -> 64-bit hash, worked out once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 20:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def ngram_set(text: bytes, known: _Hashes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of `n` words, A-Z lower-cased; the whole sequence where it is shorter, none without a word."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([known[w] for w in words], dtype=np.uint64)
    size = min(n, len(h))
    many = len(h) - size + 1
    x = np.full(many, size, dtype=np.uint64)
    for i in range(size):
        x = (x ^ h[i : i + many]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def needed(a: int, b: int, percent: int) -> int:
    """The least number of common members at which sets of `a` and `b` members link: 100 x common >= percent x union."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(size: int, percent: int) -> list[tuple[int, int]]:
    """(partner's size, subset size) of all sizes that may link with `size`; equal sets, one node, need no subset."""
    partners = range(-(-percent * size // 100), 100 * size // percent + 1)
    found = [(b, needed(size, b, percent)) for b in partners]
    return [(b, c) for b, c in found if c <= min(size, b) and not (b == size and c == size)]


def _key_of(found: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(found.tobytes(), SEED)
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (d >> 64, d & ((1 << 64) - 1)))


def parity_bits(found: np.ndarray) -> bytes:
    """A bitmap of as many bits as the set has members, or up to twice as many: a bit is set if an odd number of members falls on it."""
    many = max(64, 1 << (len(found) - 1).bit_length())
    odd = np.bincount(((found >> np.uint64(7)) & np.uint64(many - 1)).astype(np.int64), minlength=many) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each) as they would be with fewer words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _may_link(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of `a` and `b` members with bitmaps `x` and `y` (rows, broadcast against each other) can link."""
    words = min(x.shape[1], y.shape[1])
    apart = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(axis=1, dtype=np.int64)
    return (apart <= a + b - 2 * -(-percent * (a + b) // (100 + percent))) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def _sets(batch: pa.RecordBatch, known: _Hashes, n: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield i, ngram_set(text.as_buffer().to_pybytes() if text.is_valid else b"", known, n)


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, n, k1, k2) of documents, and rows (slice, part, counts) of bucket counts, a slice for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, names = _Hashes(), np.zeros(1 << _BITS, dtype=np.int64), ["doc_id", "n", "k1", "k2", "slice", "part", "counts"]
        types = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            rows = []
            for i, found in _sets(batch, known, n):
                counts[(found >> np.uint64(64 - _BITS)).astype(np.int64)] += 1  # a bucket counts once for each document
                rows.append((i, len(found), *_key_of(found)))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.record_batch([*columns, *[pa.nulls(len(rows), t) for t in types[4:]]], names=names)
        if counts.any():
            cut, part = counts.reshape(_SLICES, -1), TaskContext.get().partitionId()
            columns = [pa.nulls(_SLICES, t) for t in types[:4]] + [pa.array(range(_SLICES), pa.int64()), pa.array([part] * _SLICES, pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary())]
            yield pa.record_batch(columns, names=names)

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, slice long, part long, counts binary")


def _commonness(counts: DataFrame) -> np.ndarray:
    """How common each bucket is, in quarters of a power of two: the counts of all partitions, summed 256 at a time."""

    def total(table: pa.Table) -> pa.Table:
        sums = sum((np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table.column("counts")), np.zeros((1 << _BITS) // _SLICES, dtype=np.int64))
        return pa.table({"slice": table.column("slice")[:1], "part": table.column("part")[:1], "counts": pa.array([sums.tobytes()], pa.binary())})

    parts = counts.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    while True:
        parts = -(-parts // 256)
        counts = counts.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("slice", "part").applyInArrow(total, "slice long, part long, counts binary")
        if parts == 1:
            break
        counts = written(counts, "counts")
    out = np.zeros((_SLICES, (1 << _BITS) // _SLICES), dtype=np.int64)
    for row in counts.collect():  # 64 rows of one size
        out[row["slice"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return np.minimum(255, np.floor(4 * np.log2(out + 1.0))).astype(np.uint8).ravel()


def _entries(docs: DataFrame, nodes: DataFrame, common: np.ndarray, n: int, percent: int) -> DataFrame:
    """(node, n, rare, all, bits): for each node its rarest n-grams, of which linked sets share one, the whole set where it is small, and its bitmap."""
    order = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, common = _Hashes(), order.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for i, found in _sets(batch.slice(at, 1000), known, n):
                    if i is None or not len(found):
                        continue
                    least = np.argsort(common[(found >> np.uint64(64 - _BITS)).astype(np.int64)], kind="stable")
                    rare = found[least[: len(found) - -(-percent * len(found) // 100) + 1]]
                    rows.append((i, *_key_of(found), rare.view(np.int64), found.view(np.int64) if len(found) <= _SMALLEST_HEAVY else None, parity_bits(found)))
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary()], strict=True)], names=["node", "k1", "k2", "rare", "all", "bits"])

    found = docs.mapInArrow(run, "node long, k1 long, k2 long, rare array<long>, all array<long>, bits binary")
    return found.join(nodes.select("node", "k1", "k2", "n"), ["node", "k1", "k2"]).select("node", "n", "rare", "all", "bits")


def choose_boundary(costs: list[tuple[int, int, int]], percent: int) -> int:
    """The largest size to enumerate, for which subsets and lists together are fewest. `costs`: (size, sets, members of the lists they would scan)."""
    best, at = 0, 0
    for size, sets, scanned in sorted(costs):
        at += sets * sum(comb(size, c) for _, c in subset_sizes(size, percent)) - scanned
        if at <= best:
            best, boundary = at, size
    return boundary if best < 0 else 0


def _subset_pairs(entries: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(u, v): for every shared subset a star of links, within or between the two sizes it is for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sides, keys = [], [], []
            for node, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = found.values.to_numpy().view(np.uint64)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                total, a = h.sum(dtype=np.uint64), len(h)
                for b, c in subset_sizes(a, percent):
                    left = np.array(list(combinations(range(a), a - c)), dtype=np.int64).reshape(comb(a, c), a - c)
                    key = total - h[left].sum(axis=1, dtype=np.uint64) if a > c else np.array([total])
                    key = (key ^ np.uint64(min(a, b) * 4096 + max(a, b))) * np.uint64(0x94D049BB133111EB)
                    keys.append(key.view(np.int64))
                    nodes.append(np.full(len(key), node))
                    sides.append(np.full(len(key), 0 if a < b else 1 if a > b else 2))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (keys, nodes, sides)], names=["key", "node", "side"])

    rows = entries.where(F.col("n") <= boundary).select("node", "all").mapInArrow(run, "key long, node long, side long")
    least = rows.groupBy("key").agg(*[F.min(F.when(F.col("side") == s, F.col("node"))).alias(f"least{s}") for s in range(3)])
    other = F.when(F.col("side") == 0, F.col("least1")).when(F.col("side") == 1, F.col("least0")).otherwise(F.col("least2"))
    pairs = rows.join(least.where("least0 is not null and least1 is not null or least2 is not null"), "key").select(F.col("node").alias("u"), other.alias("v"))
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _short_pairs(lists: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(u, v): the pairs of lists of up to 16 members that sizes and places allow, one of them large."""
    rows = lists.where(F.col("many") <= _SHORT)
    a, b = (rows.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "place")]) for s in "ab")
    smaller = F.struct("n_a", "node_a") < F.struct("n_b", "node_b")
    sized = 100 * F.col("n_a") >= percent * F.col("n_b")
    met = a.join(b, (a["gram"] == b["gram"]) & smaller & sized & (F.col("n_b") > boundary) & (F.col("place_a") < _index_length(F.col("n_a"), percent)))
    return met.select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")).distinct()


def _index_length(n: Column, percent: int) -> Column:
    """Of how many of its rarest n-grams a set shares one with any linked set that is no smaller."""
    return n - F.ceil(2 * percent * n / (100 + percent)) + 1


def _near(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                rows = [np.frombuffer(s, dtype=np.uint64).reshape(1, -1) for s in (x, y)]
                kept.append(bool(_may_link(np.array([a]), np.array([b]), *rows, percent)[0]))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(kept, pa.bool_()))

    for side in ("u", "v"):
        pairs = pairs.join(entries.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"b{side}")), side)
    return pairs.select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(run, "u long, v long")


def tile_pairs(left: dict, right: dict, same: bool, boundary: int, percent: int, forest: bool, last_first: bool) -> list[tuple[int, int]]:
    """Pairs of a tile's members with another's (or its own) that may link: all, or a spanning forest over their labels.

    A side has node, n, short (the list's n-gram is among the rarest that a smaller set counts), label and bits by word count.
    """
    side = [left] if same else [left, right]
    label, out = {x: x for s in side for x in s["label"].tolist()}, []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(left["node"]) - 1, -1, -1) if last_first else range(len(left["node"])):
        own = left["bits"][i].reshape(1, -1)
        for words, (places, bits) in right["classes"].items():
            j = places[right["label"][places] != left["label"][i]]
            if not len(j) or not words // 2 <= own.shape[1] <= words * 2:
                continue
            rows = bits if len(j) == len(places) else bits[right["label"][places] != left["label"][i]]
            a, b = left["n"][i], right["n"][j]
            fine = _may_link(a, b, own, rows, percent) & (np.maximum(a, b) > boundary) & np.where((a < b) | ((a == b) & (left["node"][i] < right["node"][j])), left["short"][i], right["short"][j])
            if same:
                fine &= j > i
            for k in (j[fine][::-1] if last_first else j[fine]).tolist():
                if forest:
                    x, y = root(int(left["label"][i])), root(int(right["label"][k]))
                    if x == y:
                        continue
                    label[max(x, y)] = min(x, y)
                out.append(tuple(sorted((int(left["node"][i]), int(right["node"][k])))))
    return out


def _long_pairs(lists: DataFrame, labels: DataFrame | None, entries: DataFrame, boundary: int, percent: int, forest: bool, last_first: bool = False) -> DataFrame:
    """(u, v): pairs of long lists that bitmaps allow and whose components differ, by pairs of tiles within a task."""
    rows = lists.where(F.col("many") > _SHORT).withColumn("label", F.col("node"))
    if labels is not None:
        rows = rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        mixed = rows.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gram")
        rows = rows.join(mixed, "gram")
    rows = rows.join(entries.select("node", "bits"), "node").withColumn("short", F.col("place") < _index_length(F.col("n"), percent))
    tiles = rows.withColumn("k", F.ceil(F.col("many") / _TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    tiles = written(tiles.groupBy("gram", "tile", "k").agg(F.array_sort(F.collect_list(F.struct("node", "n", "label", "short", "bits"))).alias("members")), "tiles")
    left = tiles.select("gram", F.col("tile").alias("ta"), F.explode(F.sequence("tile", F.col("k") - 1)).alias("tb"), F.col("members").alias("a"))
    both = left.join(tiles.select("gram", F.col("tile").alias("tb"), F.col("members").alias("b")), ["gram", "tb"])

    def side(members: pa.StructArray) -> dict:
        out = {c: members.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "label", "short")}
        out["bits"] = [np.frombuffer(x, dtype=np.uint64) for x in members.field("bits").to_pylist()]
        words = np.array([len(x) for x in out["bits"]])
        out["classes"] = {int(w): (np.flatnonzero(words == w), np.stack([out["bits"][i] for i in np.flatnonzero(words == w)])) for w in np.unique(words)}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ta, tb, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x = side(a.values)
                found = tile_pairs(x, x if ta == tb else side(b.values), ta == tb, boundary, percent, forest, last_first)
                if found:
                    yield pa.record_batch([pa.array(s, pa.int64()) for s in zip(*found, strict=True)], names=["u", "v"])

    return both.select("ta", "tb", "a", F.when(F.col("ta") != F.col("tb"), F.col("b")).otherwise(F.slice("b", 1, 1)).alias("b")).mapInArrow(run, "u long, v long").distinct()


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose sets link, written. Sets are worked out again, for the nodes in question only."""
    ids = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = written(nodes.select("node", "k1", "k2").join(ids, "node", "left_semi"), "wanted")
    few = wanted.count() <= _MAX_SENT
    rows = docs.join((F.broadcast(wanted) if few else wanted), docs[docs.columns[0]] == wanted["node"]).select("node", docs.columns[1], "k1", "k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [(i, found.tobytes()) for (i, found), k1, k2 in zip(_sets(part, known, n), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True) if _key_of(found) == (k1, k2)]
                if out:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["node", "members"])

    sets = written(rows.mapInArrow(run, "node long, members binary").dropDuplicates(["node"]), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                kept.append((100 + percent) * common >= percent * (len(x) + len(y)))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("members").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("members").alias("y")), "v")
    edges = written(both.select("u", "v", "x", "y").mapInArrow(check, "src long, dst long"), "links")
    discard(wanted, sets)
    return edges


def jaccard_components(docs: DataFrame, percent: int = 85, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, component_id) for every row of `docs`: n the size of its set, component_id the smallest doc_id reachable by links.

    Sets of distinct runs of `n` words (stretches without ASCII white space, A-Z lower-cased) link where their Jaccard
    similarity is `percent` hundredths or more. A text without a word has an empty set, links with nothing and is its own
    component. Rows that repeat a doc_id are judged by their own text. Rows with a null doc_id have the component of rows
    with the same set, null if none of these has an id. An empty table gives no row.
    """
    if n < 1 or not 50 < percent <= 100:
        raise ValueError("n must be positive, percent above 50 and at most 100")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = written(_scan(docs, n), "scan")
    found = scanned.where("slice is null").select("doc_id", "n", "k1", "k2")
    nodes = written(found.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n")), "nodes")
    entries = written(_entries(docs, nodes, _commonness(scanned.where("slice is not null").select("slice", "part", "counts")), n, percent), "entries")

    members = entries.select("node", "n", F.posexplode("rare").alias("place", "gram"))
    shared = members.groupBy("gram").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    lists = written(members.join(shared, "gram"), "lists")
    costs = entries.where(F.col("n") <= _SMALLEST_HEAVY).groupBy("n").agg(F.count(F.lit(1)).alias("sets"))
    costs = costs.join(lists.where(F.col("n") <= _SMALLEST_HEAVY).groupBy("n").agg(F.sum("many").alias("scanned")), "n", "left").na.fill(0, ["scanned"])
    boundary = choose_boundary([tuple(r) for r in costs.select("n", "sets", "scanned").collect()], percent)  # at most 32 rows
    lists = lists.where(100 * F.greatest("n", F.lit(boundary + 1)) <= 100 * F.col("n") + (100 - percent) * F.lit(boundary + 1))  # may link with a large set
    large = lambda *sizes: F.greatest(*sizes) > boundary

    first = _short_pairs(lists, boundary, percent).unionByName(_subset_pairs(entries, boundary, percent)).distinct()
    tried = written(_near(first, entries, percent).unionByName(_long_pairs(lists, None, entries, boundary, percent, True)).distinct(), "pairs")
    edges = _linked(tried, docs, nodes, n, percent)
    for forest in (True, False):
        more = _long_pairs(lists, connected_components(edges), entries, boundary, percent, forest, True).join(tried, ["u", "v"], "left_anti")
        more = written(more, "pairs")
        tried, edges = tried.unionByName(more), edges.unionByName(_linked(more, docs, nodes, n, percent))

    parts = connected_components(edges)
    of = nodes.join(parts, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    some = found.where("n > 0").join(written(of, "classes"), ["k1", "k2"]).select("doc_id", "n", "component_id")
    return some.unionByName(found.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
