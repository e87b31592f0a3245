"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text (operator 5).

Folding lower-cases, maps look-alike letters of other scripts and full-width forms to Latin, and reads digits and symbols
that stand before a letter as the letters they imitate. The lexicon holds word beginnings and whole words (marked by | at
their end). Its weights are learned: word beginnings of 4 letters or more in toxic labelled texts, grown as long as they
keep their texts, kept if the texts that hold them are mostly toxic, weighted by the log of the odds; whole words where
their beginnings are not kept. Phrases of a term and a neighbouring word that mostly stand in
harmless texts become exceptions: a term within one does not count. A text's raw value is the sum of the weights of its
terms over log2(2 + words); the score is raw / (raw + threshold), with the threshold fitted on the training rows, so 0.5
and more means toxic.

The training rows are the labelled rows of least hash, at most max_training of them (a documented bound); all rows are
scored on their whole texts. The number of beginnings, terms and exceptions has no limit: beginnings are counted on the
executors, and only terms that pass are collected. Beginnings that too few toxic texts hold are skipped there by a bitmap
of fixed size; what it lets through is counted exactly. Defined results: null and empty texts score 0; a text without terms scores 0; without toxic
training rows the lexicon is empty and every score is 0; every row stays, repeated rows and null ids included; columns of
the outputs' names are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import append_columns, bitmap, in_bitmap
from plumbline.llm.shingles import MEMO_WORDS
from plumbline.runtime import materialize, ship

#: Letters of other scripts that look like Latin ones, and digits and symbols read as letters.
LOOK_ALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ѵ": "v", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ℓ": "l"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FOLD = str.maketrans(LOOK_ALIKES | {chr(c): unicodedata.normalize("NFKC", chr(c)).lower() for c in range(0xFF01, 0xFF5F)})
_SUBSTITUTE = re.compile("[" + re.escape("".join(SUBSTITUTES)) + r"](?=[^\W\d_])")
_WORDS = re.compile(r"[^\W_]+")
SHORTEST, LONGEST = 4, 12


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    return _SUBSTITUTE.sub(lambda m: SUBSTITUTES[m[0]], text)


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    threshold: float = 1.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "threshold": self.threshold, "_automaton": None}

    def terms(self, folded: str) -> list[tuple[int, int, str]]:
        """(start, end of the word, term) of each term at a word's beginning, the longest for a word."""
        if not self.weights:
            return []
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for t in self.weights:
                self._automaton.add_word(t.rstrip("|"), t.rstrip("|"))
            self._automaton.make_automaton()
        found: dict[int, str] = {}
        for end, term in self._automaton.iter(folded):
            start = end - len(term) + 1
            if not start or not folded[start - 1].isalnum():
                whole = f"{term}|" in self.weights and not folded[end + 1 : end + 2].isalnum()
                if whole or term in self.weights and len(term) > len(found.get(start, "")):
                    found[start] = f"{term}|" if whole else term
        return [(s, _WORDS.match(folded, s).end(), t) for s, t in sorted(found.items())]

    def hits(self, folded: str) -> list[str]:
        """The terms that count: those outside exception phrases."""
        terms = self.terms(folded)
        return [t for s, e, t in terms if not (self.exceptions and any(p in self.exceptions for p in phrases(folded, s, e)))]

    def raw(self, text: str | None) -> float:
        if not text:
            return 0.0
        hits = self.hits(fold(text))
        return sum(self.weights[t] for t in hits) / math.log2(2 + len(text.split())) if hits else 0.0

    def score(self, text: str | None) -> float:
        raw = self.raw(text)
        return raw / (raw + self.threshold) if raw else 0.0


def phrases(folded: str, start: int, end: int) -> list[str]:
    """The word at start with its neighbour on either side, within 60 characters."""
    word = folded[start:end]
    before, after = _WORDS.findall(folded[max(0, start - 60) : start]), _WORDS.findall(folded[end : end + 60])
    return ([f"{before[-1]} {word}"] if before else []) + ([f"{word} {after[0]}"] if after else [])


def _beginnings(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)} | {f"{w}|" for w in words if SHORTEST <= len(w) <= 2 * LONGEST}


class _Beginnings:
    """The beginnings of a text's words; those that a bitmap of hashes lacks are left out."""

    def __init__(self, bits=None):
        self.bits, self.memo = bits, {}

    def __call__(self, text: str) -> set[str]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        words, memo = set(_WORDS.findall(fold(text))), self.memo
        new = [w for w in words if w not in memo]
        if self.bits is None:
            memo.update((w, tuple(_beginnings({w}))) for w in new)
        elif new:
            of_word = [tuple(_beginnings({w})) for w in new]
            held = iter(in_bitmap(self.bits.value, _term_hashes([t for terms in of_word for t in terms])).tolist())
            memo.update((w, tuple(t for t in terms if next(held))) for w, terms in zip(new, of_word, strict=True))
        return {t for w in words for t in memo[w]}


def _term_hashes(terms: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) for t in terms), np.uint64, len(terms))


def _hashes(terms: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_term_hashes(batch.column(0).to_pylist()).view(np.int64))], names=["h"])

    return terms.select("term").mapInArrow(run, "h long")


def _counts(train: DataFrame, of) -> DataFrame:
    """(term, pos, neg): the training texts of either label for which of(text) has the term, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out():
            terms = list(sums[0].keys() | sums[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([sums[1][t] for t in terms], pa.int64()), pa.array([sums[0][t] for t in terms], pa.int64())], names=["term", "pos", "neg"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[label].update(of(text))
                if len(sums[0]) + len(sums[1]) > 500_000:
                    yield out()
                    sums = {0: Counter(), 1: Counter()}
        yield out()

    return train.mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_terms(rows: list[tuple[str, int, int]], positives: int, negatives: int, precision: float = 0.8) -> dict[str, float]:
    """Terms and weights from (beginning, toxic texts, other texts): the longest of those that keep a shorter one's texts."""
    counts = {t: (p, n) for t, p, n in rows}
    chosen: dict[str, float] = {}
    kept: dict[str, int] = {}
    for term in sorted(counts, key=lambda t: (len(t), t)):
        p, n = counts[term]
        if p < precision * (p + n):
            continue
        shorter = next((term[:i] for i in range(len(term) - 1, SHORTEST - 1, -1) if term[:i] in kept), None)
        if shorter:
            if term[-1] == "|" or p < 0.98 * kept[shorter]:
                continue
            del kept[shorter]
            chosen.pop(shorter)
        kept[term] = p
        chosen[term] = math.log((p + 0.5) / (positives + 1)) - math.log((n + 0.5) / (negatives + 1))
    return {t: w for t, w in chosen.items() if w > 0}


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_training: int) -> DataFrame:
    """(text, label) of the labelled rows of least hash. The ids, bounded by max_training, are broadcast: no text moves."""
    few = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    few = few.orderBy(F.xxhash64(id_col), id_col).limit(max_training)
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(few), id_col).select("text", "label")


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_training: int = 50_000, min_texts: int = 3, precision: float = 0.8) -> Lexicon:
    """A lexicon from labelled texts. Leave out of labels the rows that must not be learned from."""
    spark = docs.sparkSession
    ship(spark)
    train = materialize(training_rows(docs, labels, id_col, text_col, label_col, max_training), "training")
    sizes = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos:
        return Lexicon({})
    found = materialize(_counts(train.where("label = 1"), _Beginnings()).where(F.col("pos") >= min_texts).select("term"), "toxic-beginnings")
    shared = spark.sparkContext.broadcast(bitmap(_hashes(found)))
    passing = _counts(train, _Beginnings(shared)).where((F.col("pos") >= min_texts) & (F.col("pos") >= precision * (F.col("pos") + F.col("neg"))))
    weights = choose_terms([tuple(r) for r in passing.collect()], pos, neg, precision)
    lexicon = Lexicon(weights)

    def around(text: str) -> set[str]:
        folded = fold(text)
        return {p for s, e, _ in lexicon.terms(folded) for p in phrases(folded, s, e)}

    harmless = _counts(train, around).where((F.col("neg") >= min_texts) & (F.col("neg") >= 4 * F.col("pos")))
    lexicon.exceptions = frozenset(r[0] for r in harmless.collect())

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.raw(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], names=["raw", "label"])

    values = train.mapInArrow(raw, "raw double, label int").groupBy(F.round("raw", 3).alias("raw"), "label").count().toArrow()
    lexicon.threshold = best_threshold(*(values.column(c).to_numpy() for c in ("raw", "label", "count")))
    return lexicon


def best_threshold(raw: np.ndarray, label: np.ndarray, count: np.ndarray) -> float:
    """The value that parts the labels with the best F1, in the middle of its gap."""
    levels = np.unique(raw)
    level = np.searchsorted(levels, raw)
    p, n = np.bincount(level, count * (label == 1), len(levels)), np.bincount(level, count * (label == 0), len(levels))
    tp, fp = p[::-1].cumsum()[::-1], n[::-1].cumsum()[::-1]
    f1 = 2 * tp / (tp + fp + p.sum())
    at = max((i for i in range(len(levels)) if levels[i] > 0), key=lambda i: (f1[i], i), default=None)
    if at is None:
        return 1.0
    return float((levels[at] + (levels[at - 1] if at else 0.0)) / 2)


def toxicity(df: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score", hits_col: str | None = None) -> DataFrame:
    """Add the score of each whole text and, on request, the terms that count. One pass without a shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = [[lexicon.score(t) for t in texts]]
            if hits_col:
                out.append([lexicon.hits(fold(t)) if t else [] for t in texts])
            yield batch, out

    fields = [T.StructField(score_col, T.DoubleType())] + ([T.StructField(hits_col, T.ArrayType(T.StringType()))] if hits_col else [])
    return append_columns(df, fields, run)
