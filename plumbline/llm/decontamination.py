"""Benchmark decontamination by canonical templates (operator 8).

A text becomes a sequence of tokens: words without punctuation at their ends, in lower case; numbers, names (capitalised
words inside a sentence) and units after a number become typed placeholders. The first token of a document's window is taken
in every reading that its form allows, since what stands before an item is not the item's. Line breaks are white space like
any other, so re-wrapped copies match. Windows of WINDOW tokens (or the whole item,
if it is shorter) are hashed and joined with those of the benchmark. A window of fewer than MIN_PLAIN plain words is hashed
with the values of its slots, so that tables of numbers and lists of names match only if they are the same. Matches of a
document and an item are gathered by their alignment (position in the document less position in the item). A window whose
slots equal the item's always counts. A re-parameterised window counts only if its slots are consistent with the other
re-parameterised windows of its alignment: windows with a value of the item that stands for two values of the document there
are dropped, and no others. A document is reported for an item when the windows that count, of all alignments, cover
min_share of the item's, so re-parameterised copies are caught along with exact ones, or when VERBATIM_WORDS consecutive
words of the item stand in it, whatever their share of the item. Items of fewer than MIN_TOKENS tokens are compared whole:
a document matches that holds those words and no others.

Documents are read once. A bitmap of fixed size over the benchmark's window hashes lets through what may match; the equi-join
is on the full 64-bit hash. The benchmark's windows are broadcast if their number is at most MAX_BROADCAST, else shuffled.

Defined results: null and empty texts, and items without a word, match nothing; rows of one id count as one
document; rows with a null id take no part; only matching pairs are returned, so clean documents don't appear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.shingles import MEMO_WORDS, mix
from plumbline.runtime import materialize, ship

WINDOW, MIN_TOKENS, MIN_PLAIN = 8, 5, 3
VERBATIM_WORDS = 20
FILTER_BITS = 1 << 25
MAX_BROADCAST = 200_000
#: Units that a number may precede.
UNITS = frozenset("% kg g mg km m cm mm mi ft in lb lbs oz l ml s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres mile miles foot feet inch inches pound pounds gram grams litre litres liter liters dollar dollars euro euros cent cents percent usd eur gbp".split())
_NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_STRIP = " \t\n\r.,;:!?\"'()[]{}<>*#&|_-–—…«»“”‘’¿¡%$/\\"
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
_PLACE = np.array([0, 0x1F3D5B79, 0x2E4C6A88, 0x3D5B7997], np.uint64)


class _Words(dict):
    """Numbers the words of a task and holds, for each, its hash and what its form allows."""

    def __init__(self):
        self.hash, self.kind, self.titled, self.ends = (np.empty(1024, t) for t in (np.uint64, np.int64, bool, bool))

    def __missing__(self, word: str) -> int:
        import xxhash

        bare = word.strip(_STRIP)
        low = bare.lower()
        i = len(self)
        if i == len(self.hash):
            self.hash, self.kind, self.titled, self.ends = (np.concatenate([x, np.empty_like(x)]) for x in (self.hash, self.kind, self.titled, self.ends))
        self.hash[i] = xxhash.xxh3_64_intdigest((low or word).encode("utf-8", "replace"))
        self.kind[i] = -1 if not bare and not word.strip("%") == "" else NUMBER if _NUMBER.fullmatch(bare) else UNIT if (low or word) in UNITS else PLAIN
        self.titled[i] = bare[:1].isupper() and (len(bare) == 1 or not bare[1:].isupper())
        self.ends[i] = word.rstrip("\"')»”’")[-1:] in tuple(".!?:")
        self[word] = i
        return i


@dataclass
class Tokens:
    """A text's tokens: as written, the hash of the word and of its place in a template, its kind, and the places and kinds
    of the readings that a token had after other tokens."""

    raw: list[str]
    word: np.ndarray
    place: np.ndarray
    kind: np.ndarray
    other_at: np.ndarray
    other_kind: np.ndarray


def canonical(text: str | None, words: _Words) -> Tokens:
    raw = (text or "").split()
    if len(words) > MEMO_WORDS:
        words.clear()
    at = np.fromiter(map(words.__getitem__, raw), np.int64, len(raw))
    h, form, titled, ends = words.hash[at], words.kind[at], words.titled[at], words.ends[at]
    keep = form >= 0
    if not keep.all():
        raw = [w for w, k in zip(raw, keep, strict=True) if k]
        h, form, titled, ends = h[keep], form[keep], titled[keep], ends[keep]
    kind, place = form, h
    if len(h):
        before_number = np.concatenate([[False], form[:-1] == NUMBER])
        inside = np.concatenate([[False], ~ends[:-1]])
        kind = np.where((kind == UNIT) & ~before_number, PLAIN, kind)
        kind = np.where((kind == PLAIN) & titled & inside, NAME, kind)
        place = np.where(kind == PLAIN, h, _PLACE[kind])
    others = [np.flatnonzero(may & (kind != k)) for k, may in ((PLAIN, form != NUMBER), (NAME, titled & (form != NUMBER)), (UNIT, form == UNIT))]
    return Tokens(raw, h, place, kind, np.concatenate(others), np.repeat([PLAIN, NAME, UNIT], [len(x) for x in others]))


def _literal(word: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the words themselves from the given places on."""
    out = np.full(len(at), size + 0x1000, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word[at + i])
    return out


def _plain_words(t: Tokens, size: int) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(t.kind == PLAIN)])
    return upto[size:] - upto[:-size]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def tail_hashes(t: Tokens, size: int) -> np.ndarray:
    """Of each window: the hash of what follows its first token. Runs are put together from runs of 1, 2, 4, ... tokens."""
    n, at, out, run, width = len(t.place) - size + 1, 1, None, t.place, 1
    if n < 1:
        return np.empty(0, np.uint64)
    while at < size:
        if (size - 1) & width:
            held = run[at : at + n]
            out, at = held if out is None else _join(out, held), at + width
        if at < size:
            run, width = _join(run[:-width], run[width:]), 2 * width
    return np.zeros(n, np.uint64) if out is None else out


def window_hashes(t: Tokens, size: int, tail: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """plain: the number of plain words of each window."""
    out = _join(tail + np.uint64(size), t.place[: len(tail)])
    few = np.flatnonzero(plain < min(MIN_PLAIN, size))
    if len(few):
        out[few] = _literal(t.word, few, size)
    return out


def reread_hashes(t: Tokens, size: int, tail: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that begin with a token in another reading: place, kind, hash."""
    held = t.other_at < len(tail)
    at, first = t.other_at[held], t.other_kind[held]
    if not len(at):
        return at, first, np.empty(0, np.uint64)
    out = _join(tail[at] + np.uint64(size), np.where(first == PLAIN, t.word[at], _PLACE[first]))
    few = np.flatnonzero(plain[at] - (t.kind[at] == PLAIN) + (first == PLAIN) < min(MIN_PLAIN, size))
    if len(few):
        out[few] = _literal(t.word, at[few], size)
    return at, first, out


def whole_hash(t: Tokens) -> np.ndarray:
    """Of a text of fewer than MIN_TOKENS tokens: one hash of all its words, apart from those of windows."""
    return _literal(t.word, np.zeros(1, np.int64), len(t.word)) ^ np.uint64(0x5DEECE66D)


def _slots(raw: list[str], kind: np.ndarray, at: int, size: int, first: int | None = None) -> list[str]:
    """The values of a window's slots; first is the kind of its first token where it isn't that of kind."""
    return [raw[j].strip(_STRIP).lower() for j in range(at, at + size) if (kind[j] if first is None or j > at else first) != PLAIN]


ITEM_WINDOWS = T.StructType([T.StructField("h", T.LongType()), T.StructField("item", T.LongType()), T.StructField("item_pos", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("n_windows", T.IntegerType()), T.StructField("item_slots", T.ArrayType(T.StringType()))])


def item_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = canonical(text, words)
                if item is None or not t.raw:
                    continue
                if len(t.raw) < MIN_TOKENS:
                    out.append((int(whole_hash(t).view(np.int64)[0]), item, 0, len(t.raw), 1, []))
                    continue
                size = min(WINDOW, len(t.raw))
                hashes = window_hashes(t, size, tail_hashes(t, size), _plain_words(t, size)).view(np.int64).tolist()
                out += [(x, item, i, size, len(hashes), _slots(t.raw, t.kind, i, size)) for i, x in enumerate(hashes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())])], names=ITEM_WINDOWS.fieldNames())

    return benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, ITEM_WINDOWS)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """(id_col, item_id_col, n_windows, n_matched, n_changed) of each document and item that match; n_changed counts the
    values that differ in the alignment of most windows, the first of equals."""
    spark = docs.sparkSession
    ship(spark)
    items = materialize(item_windows(benchmark, item_id_col, item_text_col), "item-windows")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect() if r[0] >= MIN_TOKENS)  # at most WINDOW values
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    words = items.select(F.expr(f"h & {FILTER_BITS - 1}L").alias("bit")).select(F.expr("bit div 64").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bits[words.column("w").to_numpy()] = words.column("m").to_numpy()
    shared = spark.sparkContext.broadcast(bits.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = _Words(), shared.value

        def in_filter(x: np.ndarray) -> np.ndarray:
            bit = (x & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            return held[bit >> 3] >> (bit & 7).astype(np.uint8) & 1

        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                t = canonical(text, known)
                if 0 < len(t.raw) < MIN_TOKENS:
                    out.append((int(whole_hash(t).view(np.int64)[0]), doc, 0, []))
                for size in sizes:
                    if len(t.place) < size:
                        continue
                    tail, plain = tail_hashes(t, size), _plain_words(t, size)
                    x = window_hashes(t, size, tail, plain)
                    for i in np.flatnonzero(in_filter(x)).tolist():
                        out.append((int(x[i : i + 1].view(np.int64)[0]), doc, i, _slots(t.raw, t.kind, i, size)))
                    at, first, x = reread_hashes(t, size, tail, plain)
                    for i in np.flatnonzero(in_filter(x)).tolist():
                        out.append((int(x[i : i + 1].view(np.int64)[0]), doc, int(at[i]), _slots(t.raw, t.kind, int(at[i]), size, int(first[i]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())])], names=["h", "doc", "pos", "slots"])

    found = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "h long, doc long, pos long, slots array<string>")
    small = items.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    matches = found.join(F.broadcast(items) if small else items, "h")
    aligned = matches.groupBy("doc", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.max("n_windows").alias("n_windows"),
        F.max("size").alias("size"),
        F.collect_set(F.struct("item_pos", F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")).alias("pairs"))).alias("windows"),
    )
    differs = lambda w: F.exists(w["pairs"], lambda p: p["a"] != p["b"])
    split = aligned.withColumns({"same": F.filter("windows", lambda w: ~differs(w)), "other": F.filter("windows", differs)})
    pairs = split.withColumn("pairs", F.array_sort(F.array_distinct(F.flatten("other.pairs"))))  # by the item's value
    clashes = F.filter("pairs", lambda p, i: (i > 0) & (F.get("pairs", i - 1)["a"] == p["a"]))["a"]
    good = F.filter("other", lambda w: ~F.arrays_overlap(w["pairs"]["a"], F.col("clashes")))
    counted = pairs.withColumn("clashes", clashes).withColumn("good", good).withColumn("run", F.array_sort(F.array_distinct("same.item_pos")))
    counted = counted.withColumn("places", F.array_distinct(F.concat("same.item_pos", "good.item_pos")))
    changed = F.size(F.array_distinct(F.filter(F.flatten("good.pairs"), lambda p: p["a"] != p["b"])))
    step = VERBATIM_WORDS - F.col("size")
    total = counted.groupBy("doc", "item").agg(
        F.max("n_windows").alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("n_matched"),
        F.max_by(changed, F.struct(F.size("places"), -F.col("shift"))).alias("n_changed"),
        F.max(F.exists(F.transform("run", lambda x, i: F.coalesce(F.get("run", i + step) == x + step, F.lit(False))), lambda x: x)).alias("verbatim"),
    )
    found = total.where((F.col("n_matched") >= min_share * F.col("n_windows")) & (F.col("n_matched") > 0) | F.col("verbatim"))
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_id_col), "n_windows", "n_matched", "n_changed")
