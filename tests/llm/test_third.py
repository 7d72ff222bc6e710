import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voucherlens.llm import jaccard, queries, resample, runs

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHING = "doc_id long, text string, runs string, collapsed string, row string, words string, place string, bucket string, node string, n string, key string"
EXTRA = ("a", "b", "c", "d", "e", "f", "g", "h", "i")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_runs(w, least):
    number = {}
    a = np.array([number.setdefault(x, len(number)) for x in w])
    best = {}
    for q in range(1, len(a) // 2 + 1):
        same = np.diff(np.concatenate([[False], a[:-q] == a[q:], [False]]).astype(int))
        for i, j in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist(), strict=True):
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j - i + q), q)
    return sorted((s, q, n) for (s, n), q in best.items())


def test_runs_against_brute_force():
    r = random.Random(3)
    found = 0
    for _ in range(600):
        docs, least = [], r.choice([2, 3, 4, 12])
        for _ in range(r.randint(1, 4)):
            d = [r.randrange(r.choice([1, 2, 3, 5, 20])) for _ in range(r.choice([0, 1, 2, 5, 20, 40, 80]))]
            for _ in range(r.randint(0, 3) if d else 0):
                a, p = r.randrange(len(d)), r.randint(0, len(d))
                d[p:p] = d[a : a + r.randint(1, 10)] * r.randint(1, 5)
            docs.append(d)
        begins = np.cumsum([0, *map(len, docs)])[:-1]
        got = runs.find_runs(np.array([x for d in docs for x in d], dtype=np.int64), begins, least)
        want = [(i, s, n, q) for i, d in enumerate(docs) for s, q, n in brute_runs(d, least)]
        assert list(zip(*map(np.ndarray.tolist, got), strict=True)) == want
        found += len(want)
    assert found > 3000


def test_runs_of_awkward_rows(spark):
    long = " ".join(["ab"] * 30_000 + [f"w{i}" for i in range(500)] * 7)
    texts = [None, "", " \t\n ", "one", "a b " * 6, "a b " * 5, "x a  b\x0bc\ta b c a b c a b c a b c y", "é è " * 9, long, "a b " * 6]
    rows = [(i if i != 7 else None, t, *EXTRA) for i, t in enumerate(texts)]
    got = runs.periodic_runs(spark.createDataFrame(rows, CLASHING)).collect()
    for row, text in zip(sorted(got, key=lambda x: 7 if x.doc_id is None else x.doc_id), texts, strict=True):
        w = SPACED.findall(text or "")
        want = brute_runs(w, 12) if len(w) < 1000 else [(0, 1, 30_000), (30_000, 500, 3_500)]
        assert [(x.start, x.period, x.length) for x in row.runs] == want
        gone = {i for s, q, n in want for i in range(s + q, s + n)}
        assert row.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert runs.periodic_runs(spark.createDataFrame([], CLASHING)).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame([], CLASHING), 1)


def test_query_of_runs_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op11_runs(spark, folder).collect()}
    for doc_id, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        w = SPACED.findall(text or "")
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        want = brute_runs(w, 12)
        gone = {i for s, q, n in want for i in range(s + q, s + n)}
        s, q, n = min(want, key=lambda x: (-x[2], x[0], x[1])) if want else (None,) * 3
        row = got.pop(doc_id)
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (len(want), s, n, q, want and 1000 * n // q or None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in want).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert not got


def brute_resample(docs, target, percent, max_n, buckets, least, seed):
    def features(text):
        w = WORDS.findall(lower(text))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    rows, scored = [], []
    for d, text in docs:
        w, f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in f) // len(f) if f else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(w) >= least:
                scored.append((-score, d))
        rows.append((d, len(w), len(f), weight, score))
    rank = {d: i + 1 for i, (_, d) in enumerate(sorted(scored)[: percent * len(scored) // 100])}
    return sorted((*r, rank.get(r[0]) if r[0] is not None else None) for r in rows if r[0] is not None), [r for r in rows if r[0] is None]


@pytest.mark.parametrize(("max_n", "chunk_words", "long_chars"), [(1, 8192, 65_536), (1, 7, 50), (3, 5, 30), (3, 1, 0)])
def test_resample_against_brute_force(spark, max_n, chunk_words, long_chars):
    r = random.Random(max_n)
    vocab = ["".join(r.choice("abcXYZ019éЖ") for _ in range(r.randint(1, 4))) for _ in range(40)]
    say = lambda n: "".join(r.choice(vocab) + r.choice([" ", "-", ", ", "\n"]) for _ in range(n))
    docs = [(i, say(r.choice([0, 1, 5, 19, 20, 21, 60, 200]))) for i in range(80)] + [(90, None), (91, ""), (92, " -- "), (None, say(30)), (93, say(3000))]
    target = [say(20), None, "", say(50)]
    found = resample.resample(
        spark.createDataFrame([(*d, *EXTRA) for d in docs], CLASHING), spark.createDataFrame([(x,) for x in target], "text string"), 30, max_n, 50, 20, "s", chunk_words=chunk_words, long_chars=long_chars
    ).collect()
    want, nameless = brute_resample(docs, target, 30, max_n, 50, 20, "s")
    assert sorted(tuple(x) for x in found if x.doc_id is not None) == want
    assert [tuple(x)[:5] for x in found if x.doc_id is None] == nameless and sum(x[5] is not None for x in want) == 30 * sum(x[1] >= 20 for x in want) // 100


def test_resample_of_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], CLASHING)
    some = spark.createDataFrame([(5, "a b c", *EXTRA), (5, "a b c", *EXTRA), (4, "d e f", *EXTRA)], CLASHING)
    assert resample.resample(none, some).collect() == [] and resample.resample(none, none).collect() == []
    got = sorted(map(tuple, resample.resample(some, none, 100, min_words=3).collect()))
    assert [x[0] for x in got] == [4, 5, 5] and sorted(x[5] for x in got) == [1, 2, 3] and got[1][:5] == got[2][:5]
    with pytest.raises(ValueError):
        resample.resample(some, some, percent=101)


def brute_links(texts, percent, n):
    sets = {}
    for d, text in texts.items():
        w = SPACED.findall(lower(text))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, pairs = sorted(sets), 0
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
                pairs += sets[a] != sets[b]
    return {d: (len(sets[d]), root(d)) for d in ids}, pairs


def near_texts(seed, count, sizes):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdÉé") for _ in range(r.randint(1, 5))) for _ in range(300)]
    passage = [r.choice(vocab) for _ in range(30)]
    out = [None, "", " \n", "one", "ONE", "one two three four", "One  two three\tfour"]
    while len(out) < count:
        if r.random() < 0.6 and len(out) > 20:
            w = (out[r.randrange(7, len(out))]).split(" ")
            for _ in range(r.choice([0, 1, 1, 2])):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w.append(r.choice(vocab))
            out.append(" ".join(w))
        else:
            w = [r.choice(vocab) for _ in range(r.choice(sizes))]
            out.append(" ".join(w + passage if r.random() < 0.4 else w))
    return {i * 7 % 2003: x for i, x in enumerate(out)}


@pytest.mark.parametrize(("percent", "n", "sizes", "boundary"), [(85, 4, [8, 12, 16, 22, 60, 200], None), (85, 1, [6, 9, 14, 18, 25], 14), (85, 4, [12, 16, 20, 24], 20), (60, 2, [5, 7, 9, 30], 7)])
def test_jaccard_against_brute_force(spark, monkeypatch, percent, n, sizes, boundary):
    texts = near_texts(n + percent, 260, sizes)
    if boundary is not None:
        monkeypatch.setattr(jaccard, "choose_boundary", lambda costs, _: boundary)
    if n == 4:  # long lists and several tiles on a small table
        monkeypatch.setattr(jaccard, "_SHORT", 2)
        monkeypatch.setattr(jaccard, "_TILE", 5)
    want, pairs = brute_links(texts, percent, n)
    rows = [(d, x, *EXTRA) for d, x in texts.items()]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, CLASHING), percent, n).collect()
    assert {r.doc_id: (r.n, r.component_id) for r in got} == want and len(got) == len(want)
    assert pairs > 10


def test_jaccard_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(None, "a b c d e"), (9, "a b c d e"), (9, "a b c d e"), (4, "A b c D e"), (None, "z z"), (None, None), (7, long), (8, long + " x"), (2, "")]
    got = jaccard.jaccard_components(spark.createDataFrame([(*r, *EXTRA) for r in rows], CLASHING)).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = [(None, 0, None), (None, 1, None), (None, 2, 4), (2, 0, 2), (4, 2, 4), (7, 39_997, 7), (8, 39_998, 7), (9, 2, 4), (9, 2, 4)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert jaccard.jaccard_components(spark.createDataFrame([], CLASHING)).collect() == []


def test_bitmaps_leave_out_no_link():
    r = np.random.default_rng(1)
    for _ in range(300):
        size = int(r.integers(1, 700))
        a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, len(a) - int(r.integers(0, 1 + len(a) // 6)))], r.integers(0, 2**63, int(r.integers(0, 1 + len(a) // 6)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        x, y = (np.frombuffer(jaccard.parity_bits(s), dtype=np.uint64).reshape(1, -1) for s in (a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert jaccard._may_link(np.array([len(a)]), np.array([len(b)]), x, y, 85)[0]


def test_boundary_by_cost():
    assert jaccard.choose_boundary([], 85) == 0
    assert jaccard.choose_boundary([(7, 10, 1000), (20, 10, 10)], 85) == 7
    assert jaccard.choose_boundary([(7, 10, 0), (20, 10, 10**6)], 85) == 20
    for a in range(1, 33):
        for b, c in jaccard.subset_sizes(a, 85):
            assert 100 * c >= 85 * (a + b - c) and 100 * (c - 1) < 85 * (a + b - c + 1)
