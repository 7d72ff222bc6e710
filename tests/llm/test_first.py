import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from voucherlens.llm import decontam, packing, simhash

DOCS = "doc_id long, text string, lang string, k string, fp long, w string"


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def texts(n=150, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéÀÉ") for _ in range(r.randint(1, 6))) for _ in range(60)]
    out = [None, "", "  \n", "one", "One two", "ONE two three", "É é", "a\x0bb\x1cc d"]
    while len(out) < n:
        if r.random() < 0.4 and len(out) > 20:
            ws = (out[r.randrange(8, len(out))] or "").split(" ")
            for _ in range(r.randint(0, 1)):
                ws[r.randrange(len(ws))] = r.choice(vocab)
            out.append(" ".join(ws))
        else:
            out.append(" ".join(r.choice(vocab) for _ in range(r.randint(1, 300))))
    return out


def test_simhash_against_brute_force(spark):
    rows = [(i * 7 % 1000, t, "x", "k", 1, "w") for i, t in enumerate(texts())]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), tile=16).collect()
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    comps = brute_components(fps)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{fps[d]:016x}", comps[d]) for d in fps}
    assert len(set(comps.values())) < len(comps)


def test_simhash_forest_keeps_every_link():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 12, dtype=np.uint64)
    a = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6), base ^ np.uint64(7)]))
    edges = simhash.forest(a, a, 2)
    assert all((x ^ y).bit_count() <= 2 for x, y in edges) and len(edges) == len(a) - 12


def test_simhash_empty_and_filter(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(3, "a b c d", "x", "k", 1, "w"), (2, "a b c d", "x", "k", 1, "w"), (None, "a b c d", "x", "k", 1, "w"), (9, "q r s t u", "x", "k", 1, "w")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == [(False, 2), (False, 9), (True, None)] and kept[0].asDict().keys() == {"doc_id", "text", "lang", "k", "fp", "w"}


def test_near_copies_against_brute_force(spark):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.choice([6, 9, 30, 120, 400]))]
        for k in range(5):
            ws = list(base)
            for _ in range(len(ws) * k // 120 if k else 0):
                ws[r.randrange(len(ws))] = r.choice(vocab)
            rows.append((len(rows) * 7 % 1000, " ".join(ws[: len(ws) - r.randint(0, 1)]), "x", "k", 1, "w"))
    shingles = {d: frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for d, t, *_ in rows}
    parent, pairs = {d: d for d in shingles}, 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in shingles:
        for b in shingles:
            if a < b and len(shingles[a] & shingles[b]) * 5 >= 4 * len(shingles[a] | shingles[b]):
                pairs += shingles[a] != shingles[b]
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert pairs > 50 and {k.doc_id for k in kept} == {d for d in shingles if root(d) == d} and len(kept) < len({*shingles.values()})
    got = simhash.near_copies(spark.createDataFrame(rows, DOCS), tile=32).collect()
    assert {k.doc_id: k.component_id for k in got} == {d: root(d) for d in shingles}


def test_packing_round_trip(spark):
    path, ranks, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(i, t, "x", "k", 1, "w") for i, t in enumerate([*texts(40), "a<|endoftext|>b", "日本語   テ\u0085ス", "x" * 9000, " leading", "it's 12"])]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    tok = Tokenizer.from_file(path)
    pieces = packing.pack_documents(df, path, ranks, pattern, length=64).collect()
    want = {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t, *_ in rows}
    by = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(by.setdefault(p.doc_id, [])) and p.length == len(p.ids) and p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by[p.doc_id] += p.ids
    assert by == want
    seqs = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == seqs.get(p.sequence_id, 0)
        seqs[p.sequence_id] = p.offset + p.length
    assert sorted(seqs) == list(range(len(seqs))) and all(n == 64 for s, n in seqs.items() if s < len(seqs) - 1)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), path).collect() == []


def brute_hits(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for item, text in items:
        w = words(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = {}
    for d, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in wins}:
            for i in range(len(w) - m + 1):
                if own := wins.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    found |= own
        out[d] = (len(w), len(hit), found)
    return out


@pytest.mark.parametrize("limit", [{}, {"max_grams": 0}, {"max_grams": 0, "max_set": 0}])
def test_decontamination_against_brute_force(spark, limit):
    r = random.Random(3)
    vocab = [a + b for a in "abcé" for b in "xyz1"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 3, 4, 7, 9, 10, 11, 25, 40]))) for i in range(30)] + [(77, None), (78, " - "), (79, items_text := say(15)), (80, items_text)]
    docs = []
    for i in range(120):
        parts = [say(r.randint(0, 30)) for _ in range(3)]
        if r.random() < 0.6:
            item = (r.choice(items)[1] or "").split()
            a = r.randint(0, len(item))
            parts.insert(1, ", ".join(item[a : a + r.randint(5, 20)]).upper().replace("É", "é"))
        docs.append((i, "-".join(parts), "x", "k", 1, "w"))
    docs += [(900, None, "x", "k", 1, "w"), (901, "", "x", "k", 1, "w"), (902, "...", None, None, None, None)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    keyed = d.select(d.doc_id.alias("k"), decontam.words(d.text).alias("w"))
    got = decontam.scan(keyed, b.select("item_id", decontam.words(b.text).alias("w")), **limit)
    got = {r.k: (r.n_words, len({p for s in r.spans for p in range(s.start, s.stop)}), set(r["items"])) for r in got.collect()}
    assert got == brute_hits(docs, items)
    assert any(x[1] for x in got.values()) and not all(x[1] for x in got.values() if x[0])


def test_decontamination_removal(spark):
    item = "zero one two three four five six seven eight nine ten"
    docs = [(1, f"Before, it. {item.title()}! After 5", "x", "k", 1, "w"), (2, "clean text", "x", "k", 1, "w"), (None, None, "x", "k", 1, "w"), (2, item, "x", "k", 1, "w")]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in decontam.decontaminate(d, b).collect() if r.text) == [(2, "clean text")]
    spans = decontam.decontaminate(d, b, remove="spans")
    assert spans.columns == d.columns and {r.text for r in spans.collect()} == {"Before, it. ! After 5", "clean text", None, ""}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(d, none).count() == 4 and decontam.decontaminate(d.limit(0), b).count() == 0
    assert decontam.report(d, none).count() == 4
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_decontamination_of_repeated_rows_and_a_long_item(spark):
    r = random.Random(5)
    item = " ".join(f"w{r.randrange(10**6)}" for _ in range(50_000))
    part = " ".join(item.split()[700:712])
    df = spark.createDataFrame([(1, part), (1, part), (1, part), (2, "x " + part + " y"), (3, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([("a", item)], "item_id string, text string")
    assert sorted((x.k.doc_id, x.n_hit) for x in decontam.report(df, b).collect()) == [(1, 12)] * 3 + [(2, 12), (3, 0)]
    assert [x.doc_id for x in decontam.decontaminate(df, b).collect()] == [3]
    assert decontam.decontaminate(df, b, remove="spans").count() == 5
