"""Exact Jaccard self-join on word shingles by token-combination prefixes (operator 10).

Texts of one shingle set form a class; classes are joined, copies are never expanded.

Signatures. All shingles follow one order: unshared ones first, then rare, then frequent ones, by hash within each. With
T = n - o + 1, where o = ceil(t n) is the least overlap that a partner needs, a set's prefix is extended until its tokens
count T: an unshared or rare token counts 1, a frequent token counts 1 unless it is the first of its sub-class in the
prefix. Unshared tokens need no index, rare ones are indexed alone, frequent ones as all pairs within a sub-class. Of the n tokens at most n - o miss in a partner, so some sub-class
has two tokens in both prefixes, or some rare token is in both: two linked sets share a signature. Frequent sub-classes are
dealt by hash; their number depends on the size band of the set (bands grow by 1 / t, so partners are at most one band
apart, and each set is indexed for its own band and the one below). Frequent means found in frequent_df sets or more; the
bar rises with the corpus so that the broadcast set of frequent tokens never exceeds MAX_FREQUENT. Unshared means
that a bitmap of fixed size, with a bit for all shingles found in two sets or more, doesn't have it. The counts cover every
shingle of every document; a fuller bitmap or another bar gives the same result, only the work differs.

Size and position filter. If a rare token is the first in order that two sets have in common, either overlaps the other by
its shared tokens from there on at most (by all its shared tokens, for a pair of frequent ones); this bound must reach
t / (1 + t) (n + m) for both. A pair that links passes in the bucket of its first common token.

Verification. The buckets of one signature are streamed in order; only buckets of two or more classes live on. First each
member is compared with the bucket's leader, the member that can overlap most, so a large group of near copies costs
its size and not its square. Components of these links are found on the executors. A bucket that then spans several
components is open: its pairs of different components are first ruled out by parity sketches. A set's sketch has a bit for
each of 2^k cells, set if an odd number of its tokens falls there; the sketches of two sets differ in as many bits as their
symmetric difference has tokens at most, and a link allows (1 - t) / (1 + t) (n + m) of those at most, so ruling out loses
nothing. Of the pairs that stay, each member's nearest one is verified and the components joined; then all that stay
between different components are verified. Open buckets with the same members count once, and those of over BLOCK
members are dealt out as pairs of blocks, so that a task holds two blocks at most. Sets are compared by their full 64-bit
hashes. A pair meets in many buckets; it is skipped where the FIRST_SIGS least open signatures of both members show an
earlier one.

Defined results: a text without words has the empty set and links with nothing; null ids stay as rows and take no part;
rows of one id each link by their own text. See also shingles.py.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import binary_column
from plumbline.llm.components import connected_components
from plumbline.llm.shingles import Shingler, mix
from plumbline.runtime import discard, materialize, ship

MAX_FREQUENT = 4_000_000
RANGES = 1024
#: Bits of the map of shared shingles.
SHARED_BITS = 1 << 27
#: Cells a task gathers before it packs them.
CELLS_AT_ONCE = 4_000_000
#: Bits of the filter over classes that have a partner to be compared with.
FILTER_BITS = 1 << 25
CLASSES_SEEN = 200_000
#: Members of a block of an open bucket; bytes of the sketches that are compared at once.
BLOCK = 2_000
FIRST_SIGS = 8
AT_ONCE = 1 << 21
#: Powers of two that bound a sketch's bits.
SKETCH_LEAST, SKETCH_MOST = 8, 15


def class_of(tokens: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def band_edges(t: Fraction, top: int = 1 << 40) -> list[int]:
    edges = [1]
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * t.denominator // t.numerator)))
    return edges


def signatures(tokens: np.ndarray, frequent: np.ndarray, shared: np.ndarray, t: Fraction, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a sorted token set, and how much it can overlap a partner that it first meets there."""
    n = len(tokens)
    need = n - (-(-n * t.numerator // t.denominator)) + 1
    bit = (tokens >> np.uint64(64 - SHARED_BITS.bit_length() + 1)).astype(np.int64)
    tokens = tokens[(shared[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)]
    need -= n - len(tokens)
    own = len(tokens)
    if need <= 0:
        return tokens[:0], np.empty(0, np.int64)
    if len(frequent) and len(tokens):
        cells = (tokens >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(frequent, cells), len(frequent) - 1)
        often = frequent[at] == cells
    else:
        often = np.zeros(len(tokens), bool)
    rare = tokens[~often]
    if len(rare) >= need:
        return rare[:need], own - np.arange(need)
    out, hot = [rare], tokens[often]
    band = int(np.searchsorted(edges, n, side="right")) - 1
    for b in {band, max(band - 1, 0)}:
        m = max(1, edges[b] // 4)
        sub = (mix(hot ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(sub, kind="stable")
        s = sub[order]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
        first = np.zeros(len(hot), bool)
        first[order[starts]] = True  # of its sub-class, in the global order
        reach = np.searchsorted(np.cumsum(~first) + len(rare), need)
        inside = np.arange(len(hot)) <= reach
        keep = order[inside[order]]
        s, h = sub[keep], hot[keep]
        step = 1
        while step < len(s):  # all pairs within a sub-class
            same = s[step:] == s[:-step]
            if not same.any():
                break
            out.append(mix(h[:-step][same] * np.uint64(0x9E3779B97F4A7C15) + h[step:][same]) ^ np.uint64((b + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1))
            step += 1
    out = np.concatenate(out)
    most = np.full(len(out), own)
    most[: len(rare)] -= np.arange(len(rare))
    return out, most


def _profile(df: DataFrame, text_col: str, id_col: str, k: int) -> DataFrame:
    """kind 0: the class and set size of each row; kind 1: packed shingle cells of a range with their counts."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("span", T.IntegerType()), T.StructField("cells", T.BinaryType())])

    def pack(gathered: list[np.ndarray]) -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(gathered), return_counts=True)
        bounds = np.searchsorted(cells, np.arange(1, RANGES, dtype=np.uint64) << np.uint64(32 - RANGES.bit_length() + 1))
        spans, blobs = [], []
        for i, (c, q) in enumerate(zip(np.split(cells, bounds), np.split(counts, bounds), strict=True)):
            if len(c):
                often = np.flatnonzero(q > 1)
                parts = [np.diff(c, prepend=np.uint32(0)).astype(np.uint32), often.astype(np.uint32), q[often].astype(np.uint32)]
                blobs.append(len(c).to_bytes(4, "little") + zlib.compress(b"".join(p.tobytes() for p in parts), 1))
                spans.append(i)
        none = pa.nulls(len(spans), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([1] * len(spans), pa.int32()), none, none, none, pa.array(spans, pa.int32()), pa.array(blobs, pa.binary())], names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, gathered, size, seen = Shingler(k), [], 0, set()
        for batch in batches:
            ns, classes = [], []
            for text in binary_column(batch, text_col):
                tokens = shingle(text)
                ns.append(len(tokens))
                classes.append(c := class_of(tokens))
                if len(tokens) and c not in seen:
                    seen.add(c)
                    gathered.append((tokens >> np.uint64(32)).astype(np.uint32))
                    size += len(tokens)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=schema.fieldNames())
            if size >= CELLS_AT_ONCE:
                yield pack(gathered)
                gathered, size = [], 0
            if len(seen) > CLASSES_SEEN:
                seen.clear()
        if gathered:
            yield pack(gathered)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _frequent(profile: DataFrame, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle cells in bar sets or more, sorted, at most MAX_FREQUENT by the choice of bar; the bitmap of cells in two
    sets or more. A task holds the distinct cells of one range at a time."""

    def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = int.from_bytes(blob[:4], "little")
        x = np.frombuffer(zlib.decompress(blob[4:]), np.uint32)
        often, q = np.split(x[n:], 2)
        own = np.ones(n, np.int64)
        own[often] = q
        return np.cumsum(x[:n], dtype=np.uint32), own

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        cells, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        return cells[starts], np.add.reduceat(counts, starts)

    def finish(span: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        cells, counts = summed(parts)
        bits = np.zeros(SHARED_BITS // RANGES, np.uint8)
        bits[(cells[counts > 1] >> np.uint32(33 - SHARED_BITS.bit_length())) - span * len(bits)] = 1
        return pa.RecordBatch.from_arrays([pa.array([span], pa.int32()), pa.array([cells[counts >= bar].tobytes()]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], names=["span", "often", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by span; the parts of a span are summed whenever they have doubled."""
        at, parts, size, floor = None, [], 0, 0
        for batch in batches:
            for span, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if span != at:
                    if parts:
                        yield finish(at, parts)
                    at, parts, size, floor = span, [], 0, 0
                parts.append(unpack(blob.as_py()))
                size += len(parts[-1][0])
                if size > 2 * floor + 100_000:
                    parts = [summed(parts)]
                    size = floor = len(parts[0][0])
        if parts:
            yield finish(at, parts)

    n_parts = int(profile.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = profile.where("kind = 1").select("span", "cells").repartition(n_parts, "span").sortWithinPartitions("span")
    found = cells.mapInArrow(merge, "span int, often binary, bits binary").toArrow()
    often, shared = [np.empty(0, np.uint32)], np.zeros(SHARED_BITS // 8, np.uint8)
    part = len(shared) // RANGES
    for span, a, b in zip(found.column("span").to_pylist(), found.column("often"), found.column("bits"), strict=True):
        often.append(np.frombuffer(a.as_buffer(), np.uint32))
        shared[span * part : (span + 1) * part] = np.frombuffer(b.as_buffer(), np.uint8)
    return np.sort(np.concatenate(often)), shared


LIVE = T.StructType([T.StructField(n, T.LongType()) for n in ("sig", "cls", "n", "most", "lead", "lead_n", "lead_most")])


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sig, leaders first: those of buckets of two or more classes, each with its bucket's leader."""
    held, lead = tuple(np.empty(0, np.int64) for _ in range(4)), None

    def out(rows, leads):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows, *leads)], names=LIVE.fieldNames())

    def finish(rows, lead):
        """Whole buckets; lead belongs to the first one, if part of it has gone out."""
        sig = rows[0]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(starts, len(sig)))
        bucket = np.repeat(np.arange(len(starts)), size)
        leads = [x[starts] for x in rows[1:]]
        keep = (size > 1)[bucket]
        if lead is not None and lead[0] == sig[0]:
            for x, first in zip(leads, lead[1:], strict=True):
                x[0] = first
            keep |= bucket == 0
        if keep.any():
            yield out(tuple(x[keep] for x in rows), [x[bucket][keep] for x in leads])

    for batch in batches:
        rows = tuple(np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
        sig, cls = rows[:2]
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])
        if not fresh.all():  # copies of a class from several tasks
            rows = tuple(x[fresh] for x in rows)
        sig = rows[0]
        cut = int(np.searchsorted(sig, sig[-1])) if len(sig) else 0
        if cut:
            yield from finish(tuple(x[:cut] for x in rows), lead)
            rows, lead = tuple(x[cut:] for x in rows), None
        if len(rows[0]) > 100_000:  # a hot bucket goes out in parts
            if lead is None:
                lead = tuple(x[0] for x in rows)
            yield from finish(tuple(x[:-1] for x in rows), lead)
            rows = tuple(x[-1:] for x in rows)
        held = rows
    if len(held[0]):
        yield from finish(held, lead)


def parity_sketch(tokens: np.ndarray) -> bytes:
    """A bit for each of 2^k cells, at least twice as many as tokens if SKETCH_MOST allows it: the parity of its tokens."""
    cells = 1 << min(max((2 * len(tokens) - 1).bit_length(), SKETCH_LEAST), SKETCH_MOST)
    counts = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def open_pairs(sig: int, cls: np.ndarray, size: np.ndarray, comp: np.ndarray, part: np.ndarray | None, sketches: list[bytes], firsts: np.ndarray, t: Fraction, nearest: bool) -> set[tuple[int, int]]:
    """The pairs of different components (and parts) that sizes and sketches don't rule out, but those that an earlier cell
    has; nearest: one for each member and sketch size, the one whose sketch differs least."""
    found: set[tuple[int, int]] = set()
    width = np.array([len(x) for x in sketches])
    by_width = {w: (at, np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1)) for w in np.unique(width) for at in [np.flatnonzero(width == w)]}
    num, den = t.numerator, t.denominator
    for w, (rows, own) in by_width.items():
        while True:
            if w in by_width:
                others, theirs = by_width[w]
                step = max(1, AT_ONCE // (int(w) * len(others)))
                for a in range(0, len(rows), step):
                    at = rows[a : a + step]
                    both = size[at][:, None] + size[others][None]
                    may = (comp[at][:, None] != comp[others][None]) & (np.minimum(size[at][:, None], size[others][None]) * den >= np.maximum(size[at][:, None], size[others][None]) * num)
                    if part is not None:
                        may &= part[at][:, None] != part[others][None]
                    if not may.any():
                        continue
                    differ = np.bitwise_count(own[a : a + step][:, None] ^ theirs[None]).sum(axis=2, dtype=np.int64)
                    i, j = np.nonzero(may & (differ * (den + num) <= both * (den - num)))
                    x, y = at[i], others[j]
                    earlier = np.zeros(len(x), bool)
                    for k in range(firsts.shape[1]):
                        earlier |= (firsts[x, k] < sig) & (firsts[y] == firsts[x, k][:, None]).any(axis=1)
                    i, j, x, y = i[~earlier], j[~earlier], x[~earlier], y[~earlier]
                    if nearest and len(i):
                        order = np.lexsort((differ[i, j], i))
                        best = order[np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1]]))]
                        x, y = x[best], y[best]
                    x, y = cls[x], cls[y]
                    found.update(zip(np.maximum(x, y).tolist(), np.minimum(x, y).tolist(), strict=True))
            if w <= (1 << SKETCH_LEAST) // 8:
                break
            half = own.shape[1] // 2  # folded to the next smaller size
            w, own = w // 2, own[:, :half] ^ own[:, half:]
    return found


def _cross(t: Fraction, nearest: bool):
    """Of rows (sig, i, j, part, cls, n, comp, sketch, s0 .. s7) sorted by the first three: the open pairs of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(table: pa.Table) -> pa.RecordBatch:
            sig, i, j, part, cls, size, comp = (table.column(c).to_numpy() for c in range(7))
            sketches, found = table.column(7).to_pylist(), set()
            firsts = np.stack([table.column(8 + k).to_numpy() for k in range(FIRST_SIGS)], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(sig)], strict=True):
                if b - a > 1:
                    found |= open_pairs(int(sig[a]), cls[a:b], size[a:b], comp[a:b], part[a:b] if i[a] != j[a] else None, sketches[a:b], firsts[a:b], t, nearest)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            held = pa.concat_tables([held, pa.table(batch)]) if held is not None else pa.table(batch)
            if not held.num_rows:
                continue
            key = [held.column(c).to_numpy() for c in range(3)]
            cut = int(np.flatnonzero(np.logical_and.reduce([k == k[-1] for k in key]))[0])  # the last cell may go on
            if cut:
                yield pairs(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield pairs(held)

    return run


def _verify(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) of classes that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if len(u) > len(v):
                    u, v = v, u
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both = int((v[at] == u).sum())
                keep.append(t.denominator * both >= t.numerator * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("u")), "a")
    return own.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("v")), "b").select("a", "b", "u", "v").mapInArrow(run, "a long, b long")


def similar_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle_words: int = 5, threshold: Fraction = Fraction(3, 4), frequent_df: int = 64) -> DataFrame:
    """(id_col, n_shingles, component_id) of each row; a component is named by its least id."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    profile = materialize(_profile(docs, "text", "doc", shingle_words), "profile")
    rows = profile.where("kind = 0").select("doc", "n", "cls")
    total = rows.agg(F.sum("n")).first()[0] or 0
    frequent = spark.sparkContext.broadcast(_frequent(profile, max(frequent_df, -(-total // MAX_FREQUENT))))
    bounds = np.array(band_edges(threshold))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, (often, shared_), seen = Shingler(shingle_words), frequent.value, set()
        for batch in batches:
            sigs, most, meta = [], [], []
            for text in binary_column(batch, "text"):
                tokens = shingle(text)
                if len(tokens) < 3:  # only equal sets link
                    continue
                c = class_of(tokens)
                if c not in seen:
                    seen.add(c)
                    s, m = signatures(tokens, often, shared_, threshold, bounds)
                    if len(s):
                        sigs.append(s)
                        most.append(m)
                        meta.append((len(s), c, len(tokens)))
            if len(seen) > CLASSES_SEEN:
                seen.clear()
            if sigs:
                counts, *rest = (np.array(x, np.int64) for x in zip(*meta, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), *(pa.array(np.repeat(x, counts)) for x in rest), pa.array(np.concatenate(most))], names=["sig", "cls", "n", "most"])

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = docs.mapInArrow(post, "sig long, cls long, n long, most long")
    live = materialize(postings.repartition(n_parts, "sig").sortWithinPartitions("sig", F.expr("(n - most) * 1000 div n"), "cls", "n").mapInArrow(_live, LIVE), "live")

    words = live.select(F.pmod(F.xxhash64("cls"), F.lit(FILTER_BITS)).alias("bit")).select((F.col("bit") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)  # of a fixed size; a hit by chance only costs work
    found = words.toArrow()
    bits[found.column("w").to_numpy()] = found.column("m").to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, held, seen = Shingler(shingle_words), shared.value, set()
        for batch in batches:
            classes, blobs, sketches = [], [], []
            for text in binary_column(batch, "text"):
                tokens = shingle(text)
                if len(tokens) < 3:
                    continue
                c = class_of(tokens)
                bit = xxhash.xxh64_intdigest(c.to_bytes(8, "little", signed=True), seed=42) % FILTER_BITS
                if int(held[bit >> 6]) >> (bit & 63) & 1 and c not in seen:
                    seen.add(c)
                    classes.append(c)
                    blobs.append(tokens.tobytes())
                    sketches.append(parity_sketch(tokens))
            if len(seen) > CLASSES_SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(blobs, pa.binary()), pa.array(sketches, pa.binary())], names=["cls", "tokens", "sketch"])

    sets = materialize(docs.mapInArrow(gather, "cls long, tokens binary, sketch binary").groupBy("cls").agg(F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "sets")

    num, den = threshold.numerator, threshold.denominator
    fits = (F.col("n") * den >= F.col("lead_n") * num) & (F.col("lead_n") * den >= F.col("n") * num) & (F.least("most", "lead_most") * (num + den) >= (F.col("n") + F.col("lead_n")) * num)
    led = live.where((F.col("cls") != F.col("lead")) & fits).select(F.greatest("cls", "lead").alias("a"), F.least("cls", "lead").alias("b")).distinct()
    links = materialize(_verify(materialize(led, "pairs"), sets, threshold), "links")
    comps = connected_components(links)
    members = live.select("sig", "cls", "n")
    for nearest in (True, False):
        open_ = materialize(_open(members, comps, sets), "open")
        cells = open_.repartition(n_parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
        pairs = materialize(cells.mapInArrow(_cross(threshold, nearest), "a long, b long").distinct(), "pairs")
        more = materialize(_verify(pairs, sets, threshold), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = connected_components(links)
        members = open_.where("i = part and j = part").select("sig", "cls", "n")
        discard(pairs)

    least = rows.where("n > 0").groupBy("cls").agg(F.min("doc").alias("least"))
    least = materialize(least.join(comps.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "least", F.coalesce("component", "cls").alias("comp")), "least")
    named = materialize(least.groupBy("comp").agg(F.min("least").alias("least")), "named")
    of_class = materialize(least.select("cls", "comp").join(named, "comp").select("cls", "least"), "names")
    discard(live, sets, least, named)
    frequent.unpersist()
    shared.unpersist()
    return rows.join(of_class, "cls", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))


def _open(members: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """The members (sig, cls, n) of buckets of several components, dealt out to cells (sig, i, j): a bucket's blocks i and j,
    of which a member's own is part. Of buckets with the same members, one stays."""
    label = comps.select(F.col("node").alias("cls"), F.col("component").alias("comp"))
    labelled = members.join(label, "cls", "left").select("sig", "cls", "n", F.coalesce("comp", "cls").alias("comp"))
    buckets = labelled.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("h"), F.sum(F.shiftright(F.xxhash64(F.lit(7), "cls"), 28)).alias("g"))
    once = buckets.where("lo <> hi").groupBy("size", "h", "g").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64(F.lit(11), "cls"), F.col("blocks")).cast("int")
    open_ = labelled.join(once, "sig").withColumn("part", part)
    padded = F.concat(F.slice(F.array_sort(F.collect_list("sig")), 1, FIRST_SIGS), F.array_repeat(F.lit((1 << 63) - 1), FIRST_SIGS))
    firsts = open_.groupBy("cls").agg(padded.alias("sigs")).select("cls", *[F.col("sigs")[i].alias(f"s{i}") for i in range(FIRST_SIGS)])
    dealt = open_.join(sets.select("cls", "sketch").join(firsts, "cls"), "cls")
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("sig", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cls", "n", "comp", "sketch", *[f"s{i}" for i in range(FIRST_SIGS)])
