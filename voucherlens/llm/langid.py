"""Language identification by character language models.

Method: one interpolated Kneser-Ney model of order four per language. Four-gram counts over all training documents are
gathered as per-partition partial sums; continuation counts, discounts, context totals and probabilities are worked out in
Spark over all of them. The four-grams of the documents to judge, each once, get their bits under every language by joins
with these tables. Sorted key arrays with a row of bits for each key hold the commonest ones on the executors, as many as
`values` numbers allow; a document's rarer ones are joined by key, so no gram of any model is left out at any size. A
document's language is that of the lowest length-normalised cross-entropy. A small hashed sample that isn't counted sets how
steeply entropy differences become a probability, and the entropy beyond which a language's verdict is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import discard, held_out, written

UNKNOWN = "und"
_BLOCK = 1 << 20  # characters worked on at once
_S16 = np.uint64(16)


class Letters:
    """Texts as 16-bit codes: lower-cased letters, and one space for each run of anything else."""

    def __init__(self):
        self.letter = np.array([chr(i).isalpha() for i in range(0x33480)])

    def codes(self, text: str | None) -> np.ndarray:
        """Empty for a text without a letter; else with three spaces before and one after."""
        cps = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = self.letter[np.minimum(cps, len(self.letter) - 1)]
        if not is_letter.any():
            return np.zeros(0, np.uint16)
        codes = np.where(is_letter, np.where(cps < 65536, cps, 1 + cps % 65535), 32).astype(np.uint16)
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = is_letter[1:] | is_letter[:-1]
        codes = codes[keep]
        head = [32, 32] if codes[0] == 32 else [32, 32, 32]
        return np.concatenate([np.array(head, np.uint16), codes, np.array([] if codes[-1] == 32 else [32], np.uint16)])


def grams(codes: np.ndarray) -> np.ndarray:
    """Packed four-grams, one for each code but the first three."""
    c = codes.astype(np.uint64)
    return c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << _S16 | c[3:] if len(c) > 3 else np.zeros(0, np.uint64)


def blocks(texts: list[str | None], letters: Letters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(four-grams, row of each), at most about _BLOCK at a time; a long text comes in several blocks."""
    held, owners, size = [], [], 0
    for row, text in enumerate(texts):
        all_ = grams(letters.codes(text))
        for at in range(0, len(all_), _BLOCK):
            part = all_[at : at + _BLOCK]
            held.append(part)
            owners.append(np.full(len(part), row))
            size += len(part)
            if size >= _BLOCK:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, size = [], [], 0
    if size:
        yield np.concatenate(held), np.concatenate(owners)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all (lang, text) rows: sums within partitions first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(), {}

        def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        def out(lang: str) -> pa.RecordBatch:
            keys, n = merge(sums.pop(lang))
            return pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lang in sorted(set(langs)):
                own = [texts[i].as_py() for i, x in enumerate(langs) if x == lang]
                for g, _ in blocks(own, letters):
                    sums.setdefault(lang, []).append(np.unique(g, return_counts=True))
                    if len(sums[lang]) >= 16:
                        sums[lang] = [merge(sums[lang])]
                        if len(sums[lang][0][0]) > 2_000_000:
                            yield out(lang)
        for lang in list(sums):
            yield out(lang)

    parts = rows.mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def orders(counts: DataFrame) -> list[DataFrame]:
    """For orders 4 to 1: (lang, key, n, mass, context, rest), from (lang, gram, n): the discounted share of a gram in its context, and what is left to the next order there."""
    out, own = [], counts.select("lang", F.col("gram").alias("key"), "n")
    for order in (4, 3, 2, 1):
        bits = F.sum((F.col("n") == 1).cast("long")).alias("one"), F.sum((F.col("n") == 2).cast("long")).alias("two")
        d = own.groupBy("lang").agg(*bits).select("lang", F.when((F.col("one") > 0) & (F.col("two") > 0), F.col("one") / (F.col("one") + 2 * F.col("two"))).otherwise(0.5).alias("d"))
        own = own.withColumn("context", F.shiftrightunsigned("key", 16))
        contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        # a row for each language
        full = own.join(contexts, ["lang", "context"]).join(F.broadcast(d), "lang")
        full = full.select("lang", "key", "n", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("mass"), "context", (F.col("d") * F.col("kinds") / F.col("total")).alias("rest"))
        out.append(written(full, f"order{order}"))
        if order > 1:
            own = out[-1].groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return out


def probabilities(wanted: DataFrame, model: Model) -> DataFrame:
    """`wanted` (key, n) with `bits`: minus log2 P(last letter | the three before) of packed four-grams under each language."""
    langs = F.array(*map(F.lit, model.langs))
    below = None
    for order, table in enumerate(model.orders[::-1], 1):
        keys = wanted.select(F.col("key").bitwiseAND(F.lit((1 << 16 * order) - 1)).alias("key")).distinct() if order < 4 else wanted
        mass = table.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("lang", "mass"))).alias("mass"))
        rest = table.groupBy("context").agg(F.map_from_entries(F.collect_set(F.struct("lang", "rest"))).alias("rest"))
        keys = keys.withColumn("context", F.shiftrightunsigned("key", 16)).withColumn("low", F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)))
        keys = keys.withColumn("below", F.transform(langs, lambda _: F.lit(model.floor))) if below is None else keys.join(below, "low")
        keys = keys.join(mass, "key", "left").join(rest, "context", "left")
        p = F.transform(
            F.arrays_zip(langs.alias("lang"), F.col("below")),
            lambda x: F.coalesce(F.try_element_at("mass", x["lang"]), F.lit(0.0)) + F.coalesce(F.try_element_at("rest", x["lang"]), F.lit(1.0)) * x["below"],
        )
        below = keys.select(F.col("key").alias("low"), p.alias("below")) if order < 4 else keys.select("key", "n", F.transform(p, lambda x: -F.log2(x)).alias("bits"))
    return below


def least_count(table: DataFrame, keep: int) -> int:
    """The least `n` that `keep` rows of `table` at most reach."""
    grade = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2("n")).cast("int"))  # counts up to 1023, then powers of two
    sizes = table.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("grade")).collect()  # about 1,100 rows at most
    total, least = 0, 1 << 62
    for r in sizes:
        total += r.many
        if total > keep:
            break
        least = r.grade if r.grade < 1024 else 1 << (r.grade - 1024)
    return least


class Scorer:
    """Bits of texts under all models from sorted keys and their rows of bits; grams that aren't among them are counted."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.bits, self.letters = keys[order], bits[order], Letters()

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        """(four-grams in each text, bits of the known ones under each model, (key, n) of the others)."""
        n, bits, rare = np.zeros(len(texts), np.int64), np.zeros((len(texts), self.bits.shape[1])), []
        for g, rows in blocks(texts, self.letters):
            kinds, inverse = np.unique(g, return_inverse=True)
            at = np.searchsorted(self.keys, kinds)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == kinds if len(self.keys) else np.zeros(len(kinds), bool)
            n += np.bincount(rows, minlength=len(texts))
            if known.any():
                values, own = np.where(known[:, None], self.bits[at], 0.0), inverse
                for j in range(bits.shape[1]):
                    bits[:, j] += np.bincount(rows, weights=values[own, j], minlength=len(texts))
            other = ~known[inverse]
            rare.append((rows[other], g[other]))
        rows, g = (np.concatenate(x) for x in zip(*rare, strict=True)) if rare else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        order = np.lexsort((g, rows))
        rows, g = rows[order], g[order]
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (g[1:] != g[:-1])]) if len(g) else np.zeros(0, np.int64)
        many = np.diff(np.r_[first, len(g)])
        pairs = pa.StructArray.from_arrays([pa.array(g[first].view(np.int64)), pa.array(many.astype(np.int64))], names=["key", "n"])
        return n, bits, pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[first], np.arange(len(texts) + 1)).astype(np.int32)), pairs)


class Model:
    """Languages; tables of orders 4 to 1; the floor of a letter; how many numbers executors may hold; the steepness of scores and the greatest entropy accepted for each language."""

    def __init__(self, langs: list[str], orders: list[DataFrame], floor: float, values: int, steep: float = 8.0):
        self.langs, self.orders, self.floor, self.values, self.steep = langs, orders, floor, values, steep
        self.most = np.full(len(langs), np.inf)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", values: int = 4_000_000, sample: int = 4000) -> Model:
    """Models of all languages of the documents that aren't held out, counted over all of them but some `sample` (a tenth at most) that calibrate."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    share = min(0.1, sample / max(1, rows.count()))
    few = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_003)) < share * 1_000_003
    counts = written(gram_counts(rows.where(~few).select("lang", "text")), "grams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    tables = orders(counts)
    model = Model(langs, tables, 1.0 / (1 + tables[-1].select("key").distinct().count()), values)
    discard(counts)
    if langs:
        seen = _entropies(rows.where(few).select("doc_id", F.col("lang"), F.lit(False).alias("held_out"), "text"), model).where("letters > 0").select("lang", "bits").toPandas()  # about `sample` rows
        seen = seen[seen["lang"].isin(langs)]
        _calibrate(model, seen["lang"].tolist(), np.array(seen["bits"].tolist()).reshape(len(seen), len(langs)))
    return model


def _calibrate(model: Model, langs: list[str], bits: np.ndarray) -> None:
    """Sets `steep` to the value of least log loss, and `most` to the 99.9 % point of each language's own documents, with a tenth of slack."""
    if not langs:
        return
    at = np.array([model.langs.index(x) for x in langs])
    losses = {}
    for steep in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
        p = np.exp(-steep * (bits - bits.min(axis=1, keepdims=True)))
        losses[steep] = -np.log(np.maximum(1e-12, p[np.arange(len(at)), at] / p.sum(axis=1))).mean()
    model.steep = min(losses, key=losses.get)
    for j in range(len(model.langs)):
        own = bits[at == j, j]
        model.most[j] = 1.1 * np.quantile(own, 0.999) if len(own) else np.inf


def _entropies(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, held_out, letters, bits per letter) of (doc_id, lang, held_out, text) rows."""
    wanted = written(gram_counts(rows.select(F.lit("").alias("lang"), "text")).select(F.col("gram").alias("key"), "n"), "wanted")
    table = written(probabilities(wanted, model), "bits")
    discard(wanted)
    size = len(model.langs)
    least = least_count(table, model.values // size)
    head = table.where(F.col("n") >= least).select("key", "bits").toArrow()  # `values` numbers at most
    keys = head.column("key").to_numpy().view(np.uint64)
    known = head.column("bits").combine_chunks().flatten().to_numpy().reshape(len(keys), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(keys, known)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, bits, rare = scorer.score(part.column(3).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * size), pa.array(bits.ravel()))
                yield pa.record_batch([part.column(0).cast(pa.int64()), part.column(1), part.column(2), pa.array(n), lists, rare], names=["doc_id", "lang", "held_out", "letters", "bits", "rare"])

    scored = rows.mapInArrow(run, "doc_id long, lang string, held_out boolean, letters long, bits array<double>, rare array<struct<key:long,n:long>>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    other = scored.select("row", F.inline("rare")).join(table.where(F.col("n") < least).select("key", F.col("bits").alias("own")), "key")
    more = other.groupBy("row").agg(F.array(*[F.sum(F.get("own", F.lit(j)) * F.col("n")) for j in range(size)]).alias("more"))
    bits = F.zip_with("bits", F.coalesce("more", F.array_repeat(F.lit(0.0), size)), lambda a, b: (a + b) / F.greatest("letters", F.lit(1)))
    return scored.join(more, "row", "left").select("doc_id", "lang", "held_out", "letters", bits.alias("bits"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_letter, rejected) for every row of `docs`.

    `und` with score 0 where a text is null or has no letter, or nothing was learnt. `rejected` marks texts that are less
    likely under the chosen model than nearly all of its own language's documents; a caller may read them as `und`.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    if not model.langs:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_letter"), F.lit(True).alias("rejected"))
    out = _entropies(rows, model).withColumn("least", F.array_min("bits")).withColumn("at", F.array_position("bits", F.col("least")).cast("int"))
    total = F.aggregate("bits", F.lit(0.0), lambda a, b: a + F.exp(F.lit(-model.steep) * (b - F.col("least"))))
    named = F.col("letters") > 0
    most = F.array(*[F.lit(float(x)) for x in model.most])
    return out.select(
        "doc_id", "held_out", F.when(named, F.get(F.array(*map(F.lit, model.langs)), F.col("at") - 1)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(named, 1 / total).otherwise(0.0).alias("score"), F.when(named, F.col("least")).alias("bits_per_letter"),
        (~named | (F.col("least") > F.get(most, F.col("at") - 1))).alias("rejected"),
    )
