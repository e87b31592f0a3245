"""Point sets: the complete result of a query, kept in order and bound to what it was taken from by digests."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import Bounds, PlumblineError, Transform
from plumbline.operators import index, workspace
from plumbline.sources.spans import content_digest, ordered_batches

#: The columns that a set's content hash covers.
CONTENT = ["ordinal", "tx", "ty", "tz", "classification"]


def hashes(rows: DataFrame) -> DataFrame:
    """One row: (exact_count, point_id_hash, content_hash) of a query's rows; both digests follow the ordinals."""
    ids, content = content_digest(rows, ["ordinal"]), content_digest(rows, CONTENT)
    count = rows.agg(F.count("*").alias("exact_count"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(count).join(one(ids.withColumnRenamed("content_hash", "point_id_hash")), "k").join(one(content), "k").drop("k")


def terminal_summary(points: DataFrame, rows: DataFrame, bounds: Bounds | None, transform: Transform, block_points: int) -> DataFrame:
    """hashes, and how many points the blocks hold that had to be read for them (all without a box)."""
    blocks = index.blocks(points, transform, block_points)
    read = (blocks if bounds is None else index.candidates(blocks, bounds)).agg(F.coalesce(F.sum("point_count"), F.lit(0)).alias("candidate_count"))
    return hashes(rows).withColumn("k", F.lit(1)).join(read.withColumn("k", F.lit(1)), "k").select("candidate_count", "exact_count", "point_id_hash", "content_hash")


def span_facts(points: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """One row for a span list: spans, points, and the digest of the points found there."""
    from plumbline.sources.spans import read_spans

    found = read_spans(points, spans)
    return hashes(found).select(F.lit(len(spans)).cast("long").alias("spans"), F.lit(sum(c for _, c in spans)).cast("long").alias("points"), F.col("exact_count").alias("found"), "point_id_hash")


@dataclass(frozen=True)
class Facts:
    source_id: str
    seq: int
    candidate_count: int
    exact_count: int
    point_id_hash: str
    content_hash: str


class PointSet:
    """A stored set: rows by ordinal in a folder that all executors reach, and its facts, written last."""

    def __init__(self, spark: SparkSession, root: str, facts: Facts):
        self.spark, self.root, self.facts = spark, root, facts

    @classmethod
    def build(cls, spark: SparkSession, root: str, snapshot: DataFrame, source_id: str, seq: int, transform: Transform, bounds: Bounds | None = None, classification: int | None = None, block_points: int = index.BLOCK_POINTS, limit: int | None = None) -> PointSet:
        """Runs the query once over a pinned snapshot; more points than the limit are an error, not a shorter set."""
        os.makedirs(root, exist_ok=False)
        hit = workspace.query(snapshot, transform, bounds, classification).select(CONTENT)
        hit.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.parquet(os.path.join(root, "rows"))
        made = cls(spark, root, Facts(source_id, seq, 0, 0, "", ""))
        row = terminal_summary(snapshot, made.rows(), bounds, transform, block_points).first()
        if limit is not None and row.exact_count > limit:
            raise PlumblineError(f"{row.exact_count} points; the limit is {limit}")
        made.facts = Facts(source_id, seq, row.candidate_count, row.exact_count, row.point_id_hash, row.content_hash)
        with open(os.path.join(root, "facts.json"), "x") as f:
            json.dump(asdict(made.facts), f)
        return made

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> PointSet:
        """Reads the facts and holds the rows against them."""
        with open(os.path.join(root, "facts.json")) as f:
            found = cls(spark, root, Facts(**json.load(f)))
        row = hashes(found.rows()).first()
        if (row.exact_count, row.point_id_hash, row.content_hash) != (found.facts.exact_count, found.facts.point_id_hash, found.facts.content_hash):
            raise PlumblineError("the stored points differ from the set's facts")
        return found

    def rows(self) -> DataFrame:
        return self.spark.read.schema(", ".join(f"{c} long" for c in CONTENT)).parquet(os.path.join(self.root, "rows"))

    def ids(self, rows: int = 65_536):
        """The ordinals in order, in bounded batches; every call starts anew."""
        return ordered_batches(self.rows().select("ordinal"), "ordinal", rows)

    def entries(self, rows: int = 65_536):
        """Ordinals with the class that held at the pinned revision."""
        return ordered_batches(self.rows().select("ordinal", "classification"), "ordinal", rows)
