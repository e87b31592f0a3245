"""Exact line deduplication over documents by range-partitioned hashes (operator 7).

A line's key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z in lower case. A key of at least min_chars code
points that min_docs or more documents hold keeps its lines in the largest doc_id that holds it and loses them elsewhere.

Keys are hashed to 120 bits in the JVM. The (hash, document, position) rows are range-partitioned by hash and document,
so that even one key with a third of all rows is dealt over many tasks, sorted by hash, document (largest first) and
position, and streamed: the first document of a run keeps its lines, the second waits until a third is seen, later ones
lose theirs at once, so a run of any length holds the rows of the documents before the min_docs-th and no others. A task
knows nothing beyond its range: rows of its first run, and those that its last run still holds, are handed on with a summary of one row,
and the summaries (two for each task at most) settle it. What comes out is a compressed keep bitmap for each document that
loses lines, not text.

Defined results: null and empty texts have one empty line; rows of one doc_id count as one document, each row's lines
stay or go alike; a null doc_id never loses or claims a line. Other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WS_CHARS, append_columns, binary_column
from plumbline.runtime import materialize, ship

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP, PENDING, SUMMARY = 0, 1, 2
MARKED = T.StructType([T.StructField(n, T.LongType()) for n in ("kind", "h1", "h2", "doc", "pos", "n_docs")])


def line_rows(docs: DataFrame, text_col: str, id_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, pos) of every line whose key is long enough."""
    lines = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    key = F.translate(F.trim(F.col("line"), F.lit(WS_CHARS)), A_Z, a_z)
    digest = F.md5(F.col("key").cast("binary"))
    half = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("long")
    return lines.select("doc", F.col("pos").cast("long"), key.alias("key")).where(F.length("key") >= min_chars).select(half(1).alias("h1"), half(16).alias("h2"), "doc", "pos")


def _mark(min_docs: int):
    """Streams rows sorted by key, document (descending) and position; see the module's text."""

    def emit(kind, rows, n_docs=0):
        h1, h2, doc, pos = rows
        n = len(doc)
        full = lambda v: np.full(n, v, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (full(kind), h1, h2, doc, pos, full(n_docs))], names=MARKED.fieldNames())

    def settle(rows):
        """Rows of whole runs that begin and end in this task."""
        h1, h2, doc, _ = rows
        new_key = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        new_doc = new_key | np.concatenate([[True], doc[1:] != doc[:-1]])
        run = np.cumsum(new_key) - 1
        starts = np.flatnonzero(new_key)
        n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        lost = (n_docs[run] >= min_docs) & (doc != doc[starts][run])
        if lost.any():
            yield emit(DROP, tuple(x[lost] for x in rows))

    class Run:
        """The run that is open; edge: it may have begun in the task before, so its top document isn't known."""

        def __init__(self, rows, edge: bool):
            self.first, self.edge, self.docs, self.last, self.held = tuple(x[:1] for x in rows), edge, 0, None, []

        def holds(self, rows) -> bool:
            return rows[0][0] == self.first[0][0] and rows[1][0] == self.first[1][0]

        def take(self, rows):
            doc = rows[2]
            self.docs += 1 + int((doc[1:] != doc[:-1]).sum()) - (doc[0] == self.last)
            self.last = doc[-1]
            if self.edge:
                yield emit(PENDING, rows)
                return
            self.held.append(tuple(x[doc != self.first[2][0]] for x in rows))
            if self.docs >= min_docs:
                yield from self.drop(DROP)

        def drop(self, kind):
            rows = tuple(map(np.concatenate, zip(*self.held, strict=True))) if self.held else ((),) * 4
            self.held = []
            if len(rows[2]):
                yield emit(kind, rows)

        def end(self, last: bool):
            """last: the task ends with it, and the run may go on in the next one."""
            if last:
                yield from self.drop(PENDING)
            if last or self.edge:
                yield emit(SUMMARY, self.first, self.docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            rows = tuple(batch.column(i).to_numpy() for i in range(4))
            while len(rows[0]):
                h1, h2 = rows[:2]
                change = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
                if open_ is None or open_.holds(rows):
                    end = int(change[0]) if len(change) else len(h1)
                    open_ = open_ or Run(rows, True)
                    yield from open_.take(tuple(x[:end] for x in rows))
                else:
                    yield from open_.end(False)
                    end = int(change[-1]) if len(change) else 0
                    if end:
                        yield from settle(tuple(x[:end] for x in rows))
                    open_ = Run(tuple(x[end:] for x in rows), False)
                rows = tuple(x[end:] for x in rows)
        if open_ is not None:
            yield from open_.end(True)

    return run


def dropped_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, pos) of every line that goes. One shuffle of 32-byte rows; a task holds a batch and the rows of min_docs - 2
    documents."""
    spark = docs.sparkSession
    ship(spark)
    rows = line_rows(docs, text_col, id_col, min_chars)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, F.col("h1"), F.col("h2"), F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc(), "pos")
    marked = materialize(ranged.mapInArrow(_mark(min_docs), MARKED), "line-marks")
    edges = marked.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n_docs").alias("all_docs"), F.max("doc").alias("top"))
    settled = marked.where(F.col("kind") == PENDING).join(F.broadcast(edges.where(F.col("all_docs") >= min_docs)), ["h1", "h2"]).where(F.col("doc") != F.col("top"))  # two rows a task at most
    return marked.where(F.col("kind") == DROP).select("doc", "pos").unionByName(settled.select("doc", "pos"))


def keep_bitmaps(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id_col, keep_bitmap) of each document that loses lines: a zlib-compressed bitmap, one bit for each line up to the
    last that goes, 1 for a line that stays, least significant bit first; lines beyond its end stay."""
    drops = dropped_lines(docs, text_col, id_col, min_chars, min_docs)
    lists = drops.groupBy("doc").agg(F.collect_set("pos").alias("pos"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for i in range(batch.num_rows):
                lost = batch.column(1).slice(i, 1).flatten().to_numpy()
                bits = np.ones(int(lost.max()) + 1, np.uint8)
                bits[lost] = 0
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes() + len(bits).to_bytes(8, "little"), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], names=[id_col, "keep_bitmap"])

    return lists.mapInArrow(pack, T.StructType([T.StructField(id_col, T.LongType()), T.StructField("keep_bitmap", T.BinaryType())]))


def read_bitmap(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.unpackbits(np.frombuffer(raw[:-8], np.uint8), bitorder="little")[: int.from_bytes(raw[-8:], "little")].astype(bool)


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 20, min_docs: int = 3, lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """The documents with the lines taken out, and the numbers of lines before and of lines that went."""
    maps = keep_bitmaps(docs, text_col, id_col, min_chars, min_docs).withColumnsRenamed({id_col: "__pl_doc", "keep_bitmap": "__pl_keep"})
    joined = docs.join(maps.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col("__pl_doc"), "left").drop("__pl_doc")
    text_type = T.StringType()

    def apply(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, keep in zip(binary_column(batch, text_col), binary_column(batch, "__pl_keep"), strict=True):
                n = (text or b"").count(b"\n") + 1
                lost = 0
                if keep is not None and text is not None:
                    bits = read_bitmap(keep)
                    stays = [x for i, x in enumerate(text.split(b"\n")) if i >= len(bits) or bits[i]]
                    lost = n - len(stays)
                    text = b"\n".join(stays)
                texts.append(text)
                n_lines.append(n)
                n_dropped.append(lost)
            yield batch, [pa.array(texts, pa.binary()).cast(pa.string()), n_lines, n_dropped]

    fields = [T.StructField(text_col, text_type), T.StructField(lines_col, T.LongType()), T.StructField(dropped_col, T.LongType())]
    return append_columns(joined, fields, apply).drop("__pl_keep")
