"""Toxicity scores from a learned lexicon, found in spite of misspelling and read in context.

Method: terms (whole words, and stems of words) that labelled toxic documents have and others don't are counted in Spark
and kept as a trie. Its intersection with a Levenshtein automaton of one edit (a letter more, less or another, or two
changed over, anywhere in the word) is walked as a lazily built deterministic automaton, so a word costs a few table
look-ups. A misspelt hit counts as a part of an exact one, the more the longer its term, so it never speaks against
toxicity; words that clean documents have are no misspellings. Digits and signs inside a word stand for letters. Each hit
is read in its window: quoted or attributed speech counts apart from speech that addresses someone. A logistic model of
these few counts, pulled towards fixed weights where the labels are silent, gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import held_out, written

_WORD = re.compile(r"[^\W\d_]+")
# Signs that stand for letters inside words, and the letters they stand for.
_SIGNS = "@$!*€"
_TOKEN = re.compile(rf"(?:[^\W_]|[{re.escape(_SIGNS)}](?=[^\W_]))+")
_LETTERS = str.maketrans("013457@$!€", "oieast" + "asie")
STEMS = (5, 6, 7)
# Marks and words that tell a quotation, and words that address a person.
_QUOTES = "\"“”„«»‘’"
_SAYING = frozenset("said says wrote writes called quote quoted cited term word slur sagte schrieb nannte zitat wort dit écrit cité mot dijo escribió llamó cita palabra".split())
_ADDRESS = frozenset("you your youre du dich dir ihr euch sie tu toi te vous votre tú usted vosotros eres".split())
FEATURES = ["hits", "quoted", "addressed", "density"]
_PRIOR = np.array([-3.0, 3.0, -0.5, 0.5, 1.0])
WINDOW = 48


class Lexicon(NamedTuple):
    """Terms, and ordinary words within one edit of a term, which clean documents have."""

    terms: list[str]
    ordinary: frozenset[str] = frozenset()

    def trie(self) -> FuzzyTrie:
        return FuzzyTrie(self.terms, ordinary=self.ordinary)


class FuzzyTrie:
    """The terms within one edit of a word: a trie of terms times a Levenshtein automaton, determinised as it is walked.

    A term that ends in "*" is a stem and matches the words that begin with it. Terms of fewer than `least` letters are
    matched exactly. walk() gives (edits, term index), the fewest edits first, or None; `ordinary` words match exactly only.
    """

    def __init__(self, terms: list[str], least: int = 4, ordinary: frozenset[str] = frozenset()):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool, bool]]] = [[]]
        self.deep = [0]
        self.sizes, self.ordinary, self.least = [len(term.rstrip("*")) for term in terms], ordinary, least
        self.worth = [(1.0 - 2.0 / n) * (0.5 if term.endswith("*") else 1.0) for n, term in zip(self.sizes, terms, strict=True)]
        for i, term in enumerate(terms):
            stem, at = term.endswith("*"), 0
            word = term.rstrip("*")
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.deep.append(0)
                at = self.next[at][c]
                self.deep[at] = max(self.deep[at], len(word))
            self.ends[at].append((i, stem, len(word) >= least))
        self.deep[0] = max(self.sizes, default=0)
        self.states: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []
        self.begin = self._state(frozenset([(0, 0, "")]))

    def _fuzzy(self, node: int) -> list[tuple[str, int]]:
        return [(c, x) for c, x in self.next[node].items() if self.deep[x] >= self.least]

    def _state(self, raw: frozenset) -> int:
        """`raw`: (node, edits, mark) triples; a letter missing from the word is an edit without a step.

        mark: empty; "*" once a stem is matched; a letter that must come next, where it has changed places with the last.
        """
        whole = set(raw)
        for node, edits, mark in raw:
            if not mark and edits == 0:
                whole |= {(child, 1, "") for _, child in self._fuzzy(node)}
        for node, edits, mark in list(whole):
            if not mark and any(stem and (fuzzy or not edits) for _, stem, fuzzy in self.ends[node]):
                whole.add((node, edits, "*"))
        state = frozenset(whole)
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            found = [(edits, i) for node, edits, mark in state if mark in ("", "*") for i, stem, fuzzy in self.ends[node] if (fuzzy or not edits) and stem == (mark == "*")]
            self.final.append(min(found, default=None))
        return self.ids[state]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits, mark in self.states[state]:
            if mark == "*":
                out.add((node, edits, "*"))
            elif mark:
                if mark == c:
                    out.add((node, edits, ""))
            else:
                if (child := self.next[node].get(c)) is not None:
                    out.add((child, edits, ""))
                if edits == 0 and self.deep[node] >= self.least:
                    out.add((node, 1, ""))  # a letter too many
                    for first, x in self._fuzzy(node):
                        out.add((x, 1, ""))  # another letter
                        if (second := self.next[x].get(c)) is not None and self.deep[second] >= self.least:
                            out.add((second, 1, first))  # the two changed over
        self.steps[state][c] = to = self._state(frozenset(out)) if out else -1
        return to

    def walk(self, word: str) -> tuple[int, int] | None:
        state, steps = self.begin, self.steps
        for c in word:
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
        found = self.final[state]
        return None if found and found[0] and word in self.ordinary else found

    def weigh(self, token: str) -> float | None:
        """How much a token counts as a term: 1 if it is one, less if it is misspelt or holds signs for letters; None if it is none."""
        plain = token.isalpha()
        found = self.walk(token if plain else token.translate(_LETTERS))
        found = found or (None if plain else self.walk(token))
        if found is None:
            return 1.0 if not plain and any((hit := self.walk(x)) and not hit[0] for x in _WORD.findall(token)) else None
        return self.worth[found[1]] if found[0] or not plain else 1.0


def features(text: str | None, trie: FuzzyTrie, memo: dict) -> list[float]:
    """FEATURES of one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    hits = quoted = addressed = 0.0
    words = 0
    for m in _TOKEN.finditer(low):
        word = m[0]
        weight = memo.get(word, 0)
        if weight == 0:
            weight = memo[word] = None if word.isdigit() else trie.weigh(word)
        words += not word.isdigit()
        if weight is None:
            continue
        before, after = low[max(0, m.start() - WINDOW) : m.start()], low[m.end() : m.end() + WINDOW]
        near = set(_WORD.findall(before))
        opened = max(before.rfind(q) for q in _QUOTES) >= 0 and min((i for q in _QUOTES if (i := after.find(q)) >= 0), default=-1) >= 0
        if opened or near & _SAYING:
            quoted += 1
        else:
            hits += weight
        addressed += bool((near | set(_WORD.findall(after))) & _ADDRESS)
    return [np.log1p(hits), np.log1p(quoted), np.log1p(addressed), 10 * hits / max(words, 1)]


def _parts(text: Column) -> Column:
    """Distinct words of a text, and their stems, marked with a star."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w).between(3, 30)))
    stems = [F.transform(F.filter(words, _longer(n)), _stem(n)) for n in STEMS]
    return F.array_distinct(F.concat(words, *stems))


def _longer(n: int):
    return lambda w: F.length(w) > n


def _stem(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


def lexicon(marked: DataFrame, least_docs: int = 3) -> list[str]:
    """Terms of (text, toxic) rows that toxic texts have and others hardly, the commonest first; as many as the bounded sample has.

    Texts that repeat count once. A stem gives way to a word or longer stem that covers nearly the same documents.
    """
    own = marked.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    found = own.select("toxic", F.explode(_parts(F.col("text"))).alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    found = found.where((F.col("a") >= least_docs) & ((F.col("a") + 0.5) / (F.col("n") + 1) >= 0.8))
    rows = found.orderBy(F.desc("a"), F.desc(F.length(F.regexp_replace("term", r"\*", ""))), F.desc("term")).collect()  # terms of the bounded sample
    whole, out = {}, []
    for r in rows:
        word = r.term.rstrip("*")
        if not any(word.startswith(x) or x.startswith(word) for x in whole.get(word[:3], ())):
            whole.setdefault(word[:3], []).append(word)
            out.append(r.term)
    return out


def ordinary_words(marked: DataFrame, terms: list[str], least_docs: int = 1) -> frozenset[str]:
    """Words of (text, toxic) rows within one edit of a term that `least_docs` different clean texts have: real words, not misspellings."""
    own = marked.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).where("toxic = 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = FuzzyTrie(terms)
        for batch in batches:
            found = [w for text in batch.column(0).to_pylist() for w in set(_WORD.findall(text.lower())) if (hit := trie.walk(w)) and hit[0]]
            yield pa.record_batch([pa.array(found, pa.string())], names=["word"])

    many = own.select("text").mapInArrow(run, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs)
    return frozenset(r.word for r in many.collect())  # words of the bounded sample


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights (bias first) of a logistic model, with a Gaussian prior around _PRIOR; Newton steps."""
    x, w = np.column_stack([np.ones(len(x)), x]), _PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + (w - _PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _featured(rows: DataFrame, terms: Lexicon) -> DataFrame:
    """`rows` (doc_id, toxic, held_out, text) with the features in the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = terms.trie(), {}
        for batch in batches:
            values = []
            for text in batch.column(3):
                values.append(features(text.as_py(), trie, memo))
                if len(memo) > 500_000:
                    memo.clear()
            values = np.array(values, dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.record_batch([*batch.columns[:3], *[pa.array(values[:, i].copy()) for i in range(len(FEATURES))]], names=["doc_id", "toxic", "held_out", *FEATURES])

    return rows.mapInArrow(run, "doc_id long, toxic int, held_out boolean, " + ", ".join(f"{f} double" for f in FEATURES))


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the weights, from about `max_docs` labelled documents at most that aren't held out (all, if fewer).

    The sample is the documents whose hash falls below a threshold, the same on every run.
    """
    marks = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    marks = written(marks, "marks")
    share = min(1.0, max_docs / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_003)) < share * 1_000_003)
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "doc_id")
    sample = written(sample.where("text is not null").select("doc_id", "toxic", F.lit(False).alias("held_out"), "text"), "sample")
    found = lexicon(sample)
    terms = Lexicon(found, ordinary_words(sample, found))
    rows = _featured(sample, terms).select("toxic", *FEATURES).toPandas()  # bounded by max_docs
    return terms, fit(rows[FEATURES].to_numpy(dtype=float), rows["toxic"].to_numpy(dtype=float))


def score(docs: DataFrame, terms: Lexicon, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, features..., score, predicted) for every row of `docs`; a null or empty text has the bias alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("toxic"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    z = F.lit(float(weights[0]))
    for f, w in zip(FEATURES, weights[1:], strict=True):
        z = z + F.lit(float(w)) * F.col(f)
    out = _featured(rows, terms).drop("toxic").withColumn("score", 1 / (1 + F.exp(-z)))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def filter_toxic(docs: DataFrame, terms: Lexicon, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """`docs` without those that score `cut` or more, judged row by row; columns as they were, null texts kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = terms.trie(), {}
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            values = []
            for text in batch.column(at):
                values.append(features(text.as_py(), trie, memo))
                if len(memo) > 500_000:
                    memo.clear()
            z = weights[0] + np.array(values, dtype=np.float64).reshape(-1, len(FEATURES)) @ weights[1:]
            yield batch.filter(pa.array(1 / (1 + np.exp(-z)) < cut))

    return docs.mapInArrow(run, docs.schema)
