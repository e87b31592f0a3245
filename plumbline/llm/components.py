"""Connected components of an edge table, all on the executors: alternating large and small stars, or a single task's
union-find where the edges are counted and few."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import discard, materialize, ship

#: Edges that one task takes at most: 16 bytes each, some 100 MB of a dictionary.
LOCAL_EDGES = 500_000


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large) or smaller neighbours to the least of its neighbourhood."""
    sides = _both(edges)
    if not large:
        sides = sides.where("b < a")
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = sides.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    kept = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component's name is its least node.

    Up to local_edges distinct edges, counted first, one task unites; beyond, stars do, with the same result. The number of
    their rounds grows with the logarithm of the longest path. Every round is written to the shared folder, so a lost
    executor costs one round at most. Nothing but a count and a checksum comes to the driver.
    """
    ship(edges.sparkSession)
    state = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if state.count() <= local_edges:
        found = materialize(state.coalesce(1).mapInArrow(_union, "node long, component long"), "components")
        discard(state)
        return found
    before = None
    while True:
        print_ = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_ == before or not print_[0]:
            break
        before = print_
        last, state = state, materialize(_star(_star(state, True), False), "stars")
        discard(last)
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
