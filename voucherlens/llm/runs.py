"""Runs of periodic words within a text, and texts with all but the first period of each run taken out.

Method: Gusfield and Stoye's tandem repeats. Blocks of the Lempel-Ziv factorisation give squares that cover the leftmost
occurrence of every kind of square; walks along suffix links, from the end of each such stretch, reach the kinds that
rotate into one another without lying side by side, so that the vocabulary is complete; the leaves below each kind are
its occurrences, and occurrences one word apart with the same period merge into runs. Squares of squares are left out
by a test at the prime divisors of the period, so a run shows its smallest period only.

The suffix tree is held as arrays over many documents at once: ranks of all stretches of 1, 2, 4, … words, sorted
suffixes and common prefixes of neighbours, with a word of its own kind at the end of each document, so that nothing is
compared across documents. A document none of whose windows of half the least length occurs twice has no run, and gets
no tree. Work and memory grow with the words times a logarithm; documents are rows of their own, so none meets another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_BATCH = 1 << 18  # words handled at once, unless one text has more


def _ranks(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, … words from every place, until all differ: how many places have a smaller one."""
    n = len(first)
    size = np.bincount(first)
    rank = (np.cumsum(size) - size)[first].astype(np.int32)
    levels, step = [rank], 1
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            return levels
        key = rank[tied].astype(np.int64) * n + rank[np.minimum(tied + step, n - 1)]
        order = np.argsort(key)
        key, held, at = key[order], rank[tied[order]], np.arange(len(tied))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
        tie = np.maximum.accumulate(np.where(np.concatenate([[True], held[1:] != held[:-1]]), at, 0))
        rank = rank.copy()
        rank[tied[order]] = held + (group - tie).astype(np.int32)
        levels.append(rank)
        step *= 2


def _minima(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """Least of the 1, 2, 4, … values from every place on, up to `longest`."""
    table = [values]
    while 2 << (len(table) - 1) <= min(longest, len(values)):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


@dataclass
class _Tree:
    """Suffixes of joined documents: ranks by level, places in order, and tables of minima of places and of common prefixes."""

    ranks: list[np.ndarray]
    places: np.ndarray
    least_place: list[np.ndarray]
    least_prefix: list[np.ndarray]

    @classmethod
    def of(cls, first: np.ndarray, longest: int) -> _Tree:
        ranks = _ranks(first)
        places = np.empty(len(first), dtype=np.int64)
        places[ranks[-1]] = np.arange(len(first))
        tree = cls(ranks, places, _minima(places, longest), [])
        prefix = np.zeros(len(first), dtype=np.int64)
        prefix[1:] = tree.ahead(places[:-1], places[1:])
        tree.least_prefix = _minima(prefix, longest)
        return tree

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and from j on (i and j differ)."""
        many = np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            many += (rank[i + many] == rank[j + many]).astype(np.int64) << level
        return many

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree up to i and up to j, both included."""
        many = np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, a, b = self.ranks[level], i - many - (1 << level) + 1, j - many - (1 << level) + 1
            many += ((np.minimum(a, b) >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])).astype(np.int64) << level
        return many

    def earlier(self) -> np.ndarray:
        """For every place, the longest stretch from there that also starts at a smaller place: the blocks' lengths."""
        n, own = len(self.places), self.places
        down, up = np.arange(n), np.arange(1, n + 1)
        for level in range(len(self.least_place) - 1, -1, -1):
            table, wide = self.least_place[level], 1 << level
            a = down - wide
            down = np.where((a >= 0) & (table[np.maximum(a, 0)] > own), a, down)
            fits = up + wide <= n
            up = np.where(fits & (table[np.minimum(up, n - wide)] > own), up + wide, up)
        out = np.zeros(n, dtype=np.int64)
        for near, there in ((down - 1, down > 0), (up, up < n)):
            i, j = own[there], own[near[there]]
            out[i] = np.maximum(out[i], np.where(j < i, self.ahead(i, j), 0))
        return out

    def below(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf below the point of the tree that spells `length` words from i."""
        low = self.ranks[-1][i].astype(np.int64)
        high = low.copy()
        n = len(self.places)
        for level in range(len(self.least_prefix) - 1, -1, -1):
            table, wide = self.least_prefix[level], 1 << level
            a = low - wide
            low = np.where((a >= 0) & (table[np.maximum(a + 1, 0)] >= length), a, low)
            fits = high + wide <= n - 1
            high = np.where(fits & (table[np.minimum(high + 1, n - wide)] >= length), high + wide, high)
        return low, high

    def along_link(self, i: np.ndarray, period: np.ndarray) -> np.ndarray:
        """From the square at i by its suffix link and then by its first word: a place with the next rotation, or -1."""
        word, last = self.ranks[0][i], 2 * period - 1
        low, high = self.below(i + 1, last)
        stop = high.copy()
        high = high + 1
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = self.ranks[0][self.places[np.minimum(middle, stop)] + last] < word
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        found = self.places[np.minimum(low, stop)]
        return np.where((low <= stop) & (self.ranks[0][found + last] == word), found, -1)


def _primitive(tree: _Tree, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the word of `period` words from `start`, which a square repeats, is no power of a shorter one."""
    good = np.ones(len(start), dtype=bool)
    if not len(start):
        return good
    least = np.arange(int(period.max()) + 1)  # smallest prime divisor
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            own = least[p * p :: p]
            own[own == np.arange(p * p, len(least), p)] = p
    rest = period.copy()
    while (open_ := np.flatnonzero(rest > 1)).size:
        p = least[rest[open_]]
        part = period[open_] // p
        good[open_[tree.ahead(start[open_], start[open_] + part) >= period[open_] - part]] = False
        while (more := rest[open_] % p == 0).any():
            rest[open_[more]] //= p[more]
    return good


def _leftmost(tree: _Tree) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of runs that hold the leftmost occurrence of every kind of square, by two searches from each block."""
    follows = (np.arange(len(tree.places)) + np.maximum(tree.earlier(), 1)).tolist()
    cuts, at = [], 0
    while at < len(follows):
        cuts.append(at)
        at = follows[at]
    begin = np.array(cuts)
    end = np.append(begin[1:], len(follows))
    after = np.append(end[1:], len(follows))

    def each(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(most)), most)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(most) - most, most) + 1

    starts, periods, word, n = [], [], tree.ranks[0], len(follows)
    # the square's second half ends in the block's successor or begins before its end: compare with the end, or with the begin
    for edge, most, sign in ((end, end - begin, -1), (begin, after - begin, 1)):
        of, k = each(most)
        here = edge[of]
        there = here + sign * k
        fine = np.flatnonzero((here < n) & (there < n) & (there > 0))
        fine = fine[word[here[fine]] == word[there[fine]]]
        here, there, k = here[fine], there[fine], k[fine]
        left = np.minimum(here, there)
        forth, back = tree.ahead(here, there), tree.behind(here - 1, there - 1)
        square = forth + back >= k
        starts.append((left - back)[square])
        periods.append(k[square])
    start, period = np.concatenate(starts), np.concatenate(periods)
    found = np.unique(start * n + period)  # a run found from several blocks counts once
    start, period = found // n, found % n
    good = _primitive(tree, start, period)
    return start[good], period[good]


def find_runs(words: np.ndarray, begins: np.ndarray, min_length: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs of `min_length` words or more in documents that begin at `begins` in `words`.

    `words` are numbers from 0; starts count from the document's first word. In order of document, start, period.
    """
    sizes = np.diff(np.append(begins, len(words)))
    of = np.repeat(np.arange(len(sizes)), sizes)
    kinds = int(words.max()) + 2 if len(words) else 1
    offset = begins + np.arange(len(begins)) + 1  # of each document behind its own end mark and those before
    spelt = np.zeros(len(words) + len(sizes) + 1, dtype=np.int64)
    spelt[np.arange(len(words)) + of + 1] = (of + 1) * kinds + words + 1
    spelt[offset + sizes] = np.arange(1, len(sizes) + 1) * kinds
    tree = _Tree.of(np.unique(spelt, return_inverse=True)[1], int(sizes.max(initial=0)) + 1)
    n = len(spelt)
    start, period = _leftmost(tree)
    seen, places, lengths = set((start * n + period).tolist()), [], []
    while len(start):
        more = tree.ahead(start, start + period) - period
        taken = np.minimum(more, period - 1)
        many = taken + 1
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        places.append(np.repeat(start, many) + step)
        lengths.append(np.repeat(period, many))
        open_ = taken < period - 1  # not all rotations lie in this run
        period = period[open_]
        place = tree.along_link((start + taken)[open_], period)
        place, period = place[place >= 0], period[place >= 0]
        start = place - tree.behind(place - 1, place + period - 1)
        key = np.unique(start * n + period)
        key = np.array([x for x in key.tolist() if x not in seen], dtype=np.int64)
        seen.update(key.tolist())
        start, period = key // n, key % n
    none = np.zeros(0, dtype=np.int64)
    place, period = (np.concatenate(x) if x else none for x in (places, lengths))
    low, high = tree.below(place, 2 * period)
    _, kind = np.unique(low * n + period, return_index=True)
    low, high, period = low[kind], high[kind], period[kind]
    many = high - low + 1
    leaf = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    key = np.sort(np.repeat(period, many) * n + tree.places[leaf])
    head = np.concatenate([[True], key[1:] != key[:-1] + 1]) if len(key) else none.astype(bool)
    first, last = key[head], key[np.append(head[1:], True)] if len(key) else none
    period, start = first // n, first % n
    length = last - first + 2 * period
    fits = length >= min_length
    start, length, period = start[fits], length[fits], period[fits]
    document = np.searchsorted(offset, start, side="right") - 1
    start = start - offset[document]
    order = np.lexsort((period, start, document))
    return document[order], start[order], length[order], period[order]


def _repetitive(words: np.ndarray, of: np.ndarray, window: int) -> np.ndarray:
    """Documents in which some stretch of `window` words occurs twice (and, rarely, one more, as hashes are compared)."""
    if len(words) < window:
        return np.zeros(0, dtype=np.int64)
    spread = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    many = len(words) - window + 1
    key = of[:many].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(window):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + spread[i : i + many]
    key, of = key[of[:many] == of[window - 1 :]], of[:many][of[:many] == of[window - 1 :]]
    order = np.sort(key)
    return np.unique(of[np.isin(key, np.unique(order[1:][order[1:] == order[:-1]]))])


def _of_texts(texts: list[list[bytes]], min_length: int) -> tuple[list[list[dict]], list[bytes]]:
    """Runs of each text, and its words without those that a run repeats."""
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for ws in texts for w in ws], dtype=np.int64)
    sizes = np.array([len(ws) for ws in texts], dtype=np.int64)
    begins, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    runs: list[list[dict]] = [[] for _ in texts]
    kept = [b" ".join(ws) for ws in texts]
    chosen = _repetitive(words, of, (min_length + 1) // 2)
    if len(chosen):
        own = np.concatenate([words[begins[d] : begins[d] + sizes[d]] for d in chosen])
        part, start, length, period = find_runs(own, np.cumsum(sizes[chosen]) - sizes[chosen], min_length)
        edges = np.searchsorted(part, np.arange(len(chosen) + 1))
        for d, a, b in zip(chosen.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a == b:
                continue
            rows = list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
            runs[d] = [{"start": s, "length": n, "period": p} for s, n, p in rows]
            change = np.zeros(sizes[d] + 1, dtype=np.int64)
            np.add.at(change, start[a:b] + period[a:b], 1)
            np.add.at(change, start[a:b] + length[a:b], -1)
            kept[d] = b" ".join(texts[d][i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist())
    return runs, kept


def periodic_runs(docs: DataFrame, min_length: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed) for every row of `docs`.

    Words are stretches without ASCII white space. runs: (start, length, period) in words, by start, then period, of all
    stretches of `min_length` words or more that hold their smallest period twice and can't grow. collapsed: the words,
    joined by one space, that no run holds after its first period. A null or blank text has no run and an empty
    collapsed text; ids may be null or repeat; an empty table gives no row.
    """
    if min_length < 2:
        raise ValueError("min_length must be 2 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs, kept = _of_texts(texts, min_length)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

        for batch in batches:
            ids, texts, many = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if texts and many + len(ws) > _BATCH:
                    yield result(ids, texts)
                    ids, texts, many = [], [], 0
                ids.append(i)
                texts.append(ws)
                many += len(ws)
            if texts:
                yield result(ids, texts)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, RUNS)
