"""Byte-level BPE encoding and decoding (operator 3).

Encoding folds a distinct word once for the whole table, not once for each task:

1. an Arrow stage splits each whole text by the tokenizer's pattern and numbers the distinct words of its task (at most
   about EPOCH_WORDS of them at a time, an epoch, which bounds memory on any input). It writes the rows with packed word
   numbers in place of text and the epoch's words, packed by PARTS classes of their hash;
2. a task takes ranges of classes, so that equal words of all epochs meet there. Spark higher-order functions fold the ranked
   merges over arrays of the pieces of each distinct word. The ranks of pairs of ids are two arrays, broadcast as one row, so
   that a look-up takes two accesses. Each epoch's words go back to it as packed ids;
3. the rows lie in buckets by epoch, so that only the ids move to meet them, and an Arrow stage strings the ids together for
   each row.

What moves is packed: each epoch's words and ids once. Word numbers are written once and stay where they lie. The fold
is quadratic in the length of a word; words of over LONG_BYTES bytes take a heap-ordered fold of the same ranked merges
instead, which is exact as well. Decoding concatenates the ids' binary pieces in an Arrow stage.

Defined results: null and empty texts encode to no ids, and no ids decode to no bytes; special tokens don't exist, their
strings are ordinary text; rows keep their number, repeated rows and null ids included; a column of the output's name is
replaced, and all others stay.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import append_columns, arrow_type
from plumbline.runtime import arrow_batches, materialize_buckets, ship

LONG_BYTES = 128
#: Bits of an id in a piece of a word, and the rank of a pair that does not merge.
ID_BITS = 24
NONE = 1 << ID_BITS
#: Distinct words of an epoch, and those that a task remembers while it folds.
EPOCH_WORDS, FOLDED_WORDS = 300_000, 200_000
#: Code points of text, or ids, in a block of rows.
BLOCK_CHARS = 500_000
#: Hash classes of words; a task folds some of them.
PARTS = 256
#: New words that one row hands to the fold, and the words whose numbers go along: the tables of merges are copied for each row.
WORDS_AT_ONCE, USED_AT_ONCE = 3_000, 60_000
#: Bytes of rows that go to Python at once while texts are split.
BATCH_BYTES = 4 << 20
#: The code points of Unicode's White_Space, for \s.
WHITE_SPACE = r"\t-\r\x20\x85\xa0  -     　"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file, a line for each token: base64 and rank. The size is the tokenizer's."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def unicode_pattern(pattern: str) -> str:
    """The pattern with its white space spelled out, since regex engines differ about \\s."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE_SPACE if inside else f"[{WHITE_SPACE}]")
        elif two == r"\S":
            assert not inside, "\\S inside a class"
            out.append(f"[^{WHITE_SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def merge_tables(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays d and e such that, for ids a and b, e[d[a] + b] ^ a << ID_BITS is the rank of the merged pair, and NONE or more
    where the pair does not merge. The rows of a table of all pairs, shifted until no two entries meet."""
    top = max(ranks.values()) + 1  # stands for either end of a word
    if top + 2 >= NONE or any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("a vocabulary holds every byte, and at most 2**24 ranks")
    rows: defaultdict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                rows[a][0].append(b)
                rows[a][1].append(rank)
    size = 1 << max(10, (4 * sum(len(b) for b, _ in rows.values())).bit_length())
    used, d, e = np.zeros(size + top + 1, bool), np.zeros(top + 1, np.int64), np.full(size + top + 1, top + 1 << ID_BITS, np.int64)
    random = np.random.default_rng(0)
    for a, (b, rank) in sorted(rows.items(), key=lambda x: (-len(x[1][0]), x[0])):
        places = np.array(b)
        while True:
            free = ~used[(tried := random.integers(0, size, 16))[:, None] + places].any(axis=1)
            if free.any():
                break
        d[a] = tried[free.argmax()]
        used[d[a] + places], e[d[a] + places] = True, np.array(rank) | a << ID_BITS
    return d, e


def _rank(a: str, b: str) -> str:
    return f"shiftleft(least(e[d[{a}] + {b}] ^ shiftleft({a}, {ID_BITS}), {NONE}L), 32)"


#: Folds the merges of each word: the pair of least rank first, the leftmost of equals. A word is an array of its pieces and one
#: more at either end; a piece holds the rank of its merge with the next, its place in the word (8 bits) and its id.
FOLD = f"""
transform(words, w -> aggregate(array_repeat(0, greatest(size(w) - 3, 0)), w, (z, i) -> transform(array(array_min(z)), x -> if(x >= {NONE << 32}L, z,
 transform(array(cast(array_position(z, x) as int)), k -> concat(
  slice(z, 1, k - 2),
  array({_rank(f'(z[k - 2] & {NONE - 1}L)', 'shiftright(x, 32)')} | (z[k - 2] & {(1 << 32) - 1}L),
        {_rank('shiftright(x, 32)', f'(z[k + 1] & {NONE - 1}L)')} | (x & {0xFF << ID_BITS}L) | shiftright(x, 32)),
  slice(z, k + 2, size(z))))[0]))[0]))
"""


class Pieces:
    """Words as the fold takes them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, top = ranks, max(ranks.values()) + 1
        self.ids = np.array([*(ranks[bytes([i])] for i in range(256)), top], np.int64)
        self.first = np.full((257, 257), NONE, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank

    def of(self, words: list[bytes]) -> pa.Array:
        """Words of the vocabulary are one piece; words of over LONG_BYTES bytes have none here."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        left_out = (whole < 0) & (size > LONG_BYTES)
        size = np.where(whole >= 0, 3, np.where(left_out, 0, size + 2))
        ends = np.cumsum(size)
        one = whole >= 0
        symbols, inner = np.full(size.sum(), 256, np.int64), np.ones(size.sum(), bool)
        inner[(ends - size)[size > 0]] = inner[(ends - 1)[size > 0]] = False
        known = (ends - 2)[one]
        inner[known] = False
        symbols[inner] = np.frombuffer(b"".join(w for w, skip in zip(words, (one | left_out).tolist(), strict=True) if not skip), np.uint8)
        ids = self.ids[symbols]
        ids[known] = whole[one]
        z = self.first[symbols, np.append(symbols[1:], 256)] << 32 | np.arange(len(ids)) - np.repeat(ends - size, size) << ID_BITS | ids
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(z, pa.int64()))


def folded_ids(pieces: pa.Array, long_words: list[bytes], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of folded words one after the other, and how many each has; long words are folded here."""
    size = np.diff(pieces.offsets.to_numpy()).astype(np.int64)
    ends, ids = np.cumsum(size), pieces.flatten().to_numpy() & NONE - 1
    inner = np.ones(len(ids), bool)
    inner[(ends - size)[size > 0]] = inner[(ends - 1)[size > 0]] = False
    ids, n = ids[inner].astype(np.int32), np.maximum(size - 2, 0)
    if long_words:
        merged, at = [merge_long(w, ranks) for w in long_words], np.flatnonzero(size == 0)
        counts = np.array([len(x) for x in merged])
        ids = np.insert(ids, np.repeat((np.cumsum(n) - n)[at], counts), np.concatenate(merged))
        n[at] = counts
    return ids, n


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ranked merges by a heap, for long words: O(n log n)."""
    n = len(word)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := prev[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= BLOCK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def pack(values: np.ndarray) -> bytes:
    """Non-negative 32-bit integers, compressed; the number of bytes comes first."""
    raw = values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()  # equal bytes of all values together
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)


def _pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    data = b"".join(words)
    return pack(np.fromiter(map(len, words), np.int64, len(words))), len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack_words(lengths: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(unpack(lengths)).tolist()
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def bpe_encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids", keep_text: bool = True, decoded_col: str | None = None) -> DataFrame:
    """Add the token ids of each whole text as array<int> and, on request, the bytes that these ids decode to."""
    spark = df.sparkSession
    ship(spark)
    carried = [i for i, c in enumerate(df.columns) if c not in (ids_col, decoded_col) and (keep_text or c != text_col)]
    carried_fields = [df.schema.fields[i] for i in carried]
    at = df.columns.index(text_col)
    names = [f"c{i}" for i in range(len(carried))]
    row = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, carried_fields, strict=True)] + [T.StructField("n_codes", T.IntegerType())])
    binary = T.BinaryType()
    staged = T.StructType([T.StructField("epoch", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("codes", binary), T.StructField("lengths", binary), T.StructField("words", binary), T.StructField("rows", T.ArrayType(row))])
    row_type, split_by = arrow_type(row), unicode_pattern(pattern)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(split_by).findall
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        epoch, block = uuid.uuid4().hex, 0  # what is written of a task is written once, so its name holds
        for batch in batches:
            texts = batch.column(at)
            for a, b in _blocks(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                codes, counts = array("I"), []
                for t in texts.slice(a, b - a).to_pylist():
                    before = len(codes)
                    if t:
                        codes.extend(map(numbers.__getitem__, find(t)))
                    counts.append(len(codes) - before)
                part = batch.slice(a, b - a)
                rows = pa.StructArray.from_arrays([part.column(i) for i in carried] + [pa.array(counts, pa.int32())], names=[*names, "n_codes"])
                yield pa.RecordBatch.from_arrays([pa.array([epoch]), pa.array([block], pa.int32()), pa.nulls(1, pa.int32()), pa.array([pack(np.frombuffer(codes, np.uint32) if codes else np.empty(0, np.uint32))], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), rows)], names=staged.fieldNames())
                block += 1
                if len(numbers) > EPOCH_WORDS:
                    yield dictionary(epoch, numbers)
                    numbers.clear()
                    epoch, block = uuid.uuid4().hex, 0
        if numbers:
            yield dictionary(epoch, numbers)

    def dictionary(epoch: str, numbers: dict[str, int]) -> pa.RecordBatch:
        import xxhash

        words = [w.encode() for w in numbers]
        part = np.fromiter((xxhash.xxh3_64_intdigest(w) % PARTS for w in words), np.int64, len(words))
        order = np.argsort(part, kind="stable")
        parts, starts = np.unique(part[order], return_index=True)
        groups = np.split(order, starts[1:])
        packed = [_pack_words([words[i] for i in g.tolist()]) for g in groups]
        n = len(groups)
        return pa.RecordBatch.from_arrays([pa.array([epoch] * n), pa.nulls(n, pa.int32()), pa.array(parts, pa.int32()), pa.array([pack(np.diff(g, prepend=0)) for g in groups], pa.binary()), pa.array([x[0] for x in packed], pa.binary()), pa.array([x[1] for x in packed], pa.binary()), pa.nulls(n, pa.list_(row_type))], names=staged.fieldNames())

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with arrow_batches(spark, BATCH_BYTES):
        blocks, held = materialize_buckets(df.mapInArrow(split, staged), "word-numbers", n_parts, "epoch")
    use = T.StructType([T.StructField("epoch", T.StringType()), T.StructField("codes", binary), T.StructField("used", binary)])
    fold_in = T.StructType([T.StructField("uses", T.ArrayType(use)), T.StructField("fresh", T.BooleanType()), T.StructField("words", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("long_words", T.ArrayType(binary))])
    uses_type = arrow_type(fold_in["uses"].dataType)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of words not seen before, each with the epochs that use no words beyond those of this row and the rows before."""
        pieces, seen, fresh = Pieces(shared.value), dict[bytes, int](), True

        def row(new: list[bytes], uses: list[dict]) -> pa.RecordBatch:
            long_words = [w for w in new if len(w) > LONG_BYTES and w not in shared.value]
            columns = [pa.array([uses], uses_type), pa.array([fresh]), _lists([pieces.of(new)]), pa.array([long_words], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=fold_in.fieldNames())

        new, uses, size = [], [], 0
        for batch in batches:
            for epoch, codes, lengths, data in ([x[i].as_py() for x in batch.columns] for i in range(batch.num_rows)):
                if len(seen) > FOLDED_WORDS:
                    if uses:
                        yield row(new, uses)
                    new, uses, size, seen, fresh = [], [], 0, {}, True
                words = _unpack_words(lengths, data)
                unseen = [w for w in words if w not in seen]
                seen.update(zip(unseen, range(len(seen), len(seen) + len(unseen)), strict=True))
                new += unseen
                while len(new) > WORDS_AT_ONCE:
                    yield row(new[:WORDS_AT_ONCE], uses)
                    new, uses, size, fresh = new[WORDS_AT_ONCE:], [], 0, False
                uses.append({"epoch": epoch, "codes": codes, "used": pack(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))})
                size += len(words)
                if size >= USED_AT_ONCE:
                    yield row(new, uses)
                    new, uses, size, fresh = [], [], 0, False
        if uses:
            yield row(new, uses)

    by_part = held.where("block is null").select("epoch", "codes", "lengths", "words", "part").repartitionByRange(n_parts, "part").sortWithinPartitions("part").drop("part")
    shared = spark.sparkContext.broadcast(ranks)
    tables = spark.createDataFrame(pa.table({k: pa.array([x]) for k, x in zip("de", merge_tables(ranks), strict=True)}))
    folded = by_part.mapInArrow(distinct, fold_in).crossJoin(F.broadcast(tables)).select("uses", "fresh", F.expr(FOLD).alias("word_ids"), "long_words")
    answer = T.StructType([T.StructField("epoch", T.StringType()), T.StructField("codes", binary), T.StructField("lengths", binary), T.StructField("words", binary)])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each epoch and class: the numbers of its words, how many ids each has, and the ids."""
        flat, lengths = [], []
        for batch in batches:
            for i in range(batch.num_rows):
                uses, fresh, _, long_words = (x[i].as_py() if k != 2 else None for k, x in enumerate(batch.columns))
                if fresh:
                    flat, lengths = [], []
                ids, n_ids = folded_ids(batch.column(2).slice(i, 1).flatten(), long_words, shared.value)
                flat.append(ids)
                lengths.append(n_ids)
                if not uses:
                    continue
                flat, lengths = [np.concatenate(flat)], [np.concatenate(lengths)]
                starts, out = np.cumsum(lengths[0]) - lengths[0], []
                for x in uses:
                    size = lengths[0][which := unpack(x["used"])]
                    out.append((x["epoch"], x["codes"], pack(size), pack(flat[0][_ranges(starts[which], size)])))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string() if not k else pa.binary()) for k in range(4)], names=answer.fieldNames())

    ids = folded.mapInArrow(answers, answer).groupBy(F.col("epoch").alias("of")).agg(F.collect_list(F.struct("codes", "lengths", "words")).alias("answers"))
    # the first block of an epoch gets the ids; both sides are dealt by epoch, the blocks by the buckets that they lie in
    first = (F.col("epoch") == F.col("of")) & (F.col("block") == 0)
    both = blocks.where("block is not null").join(ids.hint("merge"), first, "left")
    by_epoch = both.sortWithinPartitions("epoch", "block").select("epoch", "codes", "rows", "answers")
    pieces = _pieces(spark, ranks) if decoded_col else None
    out = T.StructType([*carried_fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, binary)] if decoded_col else [])])

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        epoch, starts, size, flat = None, None, None, None
        for batch in batches:
            epochs, codes = batch.column(0).to_pylist(), batch.column(1)
            for i in range(batch.num_rows):
                if epochs[i] != epoch:
                    epoch = epochs[i]
                    parts = [(np.cumsum(unpack(x["codes"])), unpack(x["lengths"]), unpack(x["words"]).astype(np.int32)) for x in batch.column(3)[i].as_py() or []]
                    numbers, own, flat = (np.concatenate(x) for x in (zip(*parts, strict=True) if parts else [[np.empty(0, np.int64)]] * 3))
                    starts, size = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
                    starts[numbers], size[numbers] = np.cumsum(own) - own, own
                    parts = None
                rows = batch.column(2).slice(i, 1).flatten()
                which = unpack(codes[i].as_py())
                n_ids = size[which]
                ends = np.concatenate([[0], np.cumsum(n_ids)])
                bounds = np.concatenate([[0], np.cumsum(rows.field("n_codes").to_numpy())])
                lists = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(flat[_ranges(starts[which], n_ids)], pa.int32()))
                yield pa.RecordBatch.from_arrays([*[rows.field(n) for n in names], lists, *([_decoded(lists, pieces.value)] if decoded_col else [])], names=out.fieldNames())

    return by_epoch.mapInArrow(string, out)


def _lists(values: list[pa.ListArray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.concat_arrays(values))


def _ranges(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each start and its size, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(starts - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _pieces(spark: SparkSession, ranks: dict[bytes, int]):
    """All binary pieces by id, as one array and its bounds, broadcast; as large as the vocabulary."""
    held = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        held[rank] = token
    return spark.sparkContext.broadcast((np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])))


def _decoded(lists: pa.Array, pieces: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """The pieces of each list of ids, one after the other; a null stays null."""
    data, bounds = pieces
    ids, n_ids = lists.flatten().to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    size = bounds[ids + 1] - bounds[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    offsets = ends[np.concatenate([[0], np.cumsum(n_ids)])].astype(np.int32)
    own = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[_ranges(bounds[ids], size)].tobytes())])
    return pc.if_else(lists.is_valid(), own, pa.scalar(None, pa.binary())) if lists.null_count else own


def bpe_decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that an array of ids stands for: its binary pieces, one after the other. Null for null ids."""
    pieces = _pieces(df.sparkSession, ranks)
    at = df.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column(at)
            n_ids = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            out = [_decoded(lists.slice(a, b - a), pieces.value) for a, b in _blocks(n_ids)]
            yield batch, [pa.concat_arrays(out) if out else pa.array([], pa.binary())]

    return append_columns(df, [T.StructField(out_col, T.BinaryType())], decode)
