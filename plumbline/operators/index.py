"""Spatial index: ordinal blocks with zone maps, a bounding-volume hierarchy over them, and bottom-k samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import unsigned_order, with_priority
from plumbline.model import Bounds, PlumblineError, Transform

BLOCK_POINTS, SAMPLE_POINTS = 65_536, 4_096
BOX = [f"{n}_{a}" for a in "xyz" for n in ("min", "max")]


def blocks(points: DataFrame, transform: Transform, block_points: int = BLOCK_POINTS) -> DataFrame:
    """A row for each block of ordinals: first ordinal, count, world bounds. Partial aggregates move, points don't."""
    block = F.expr(f"ordinal div {block_points}")
    agg = points.groupBy(block.alias("block_id")).agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("point_count"), *[f(f"t{a}").alias(f"{n}_t{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return agg.select("block_id", "first_ordinal", "point_count", *[transform.column(i, f"{n}_t{a}").alias(f"{n}_{a}") for i, a in enumerate("xyz") for n in ("min", "max")])


def intersects(bounds: Bounds) -> F.Column:
    """Closed on all faces."""
    out = F.lit(True)
    for i, a in enumerate("xyz"):
        out = out & (F.col(f"max_{a}") >= bounds.low[i]) & (F.col(f"min_{a}") <= bounds.high[i])
    return out


def candidates(block_table: DataFrame, bounds: Bounds) -> DataFrame:
    """Every block that may hold a point of the box."""
    return block_table.where(intersects(bounds))


def pruned_query(points: DataFrame, block_table: DataFrame, bounds: Bounds, transform: Transform, block_points: int = BLOCK_POINTS) -> DataFrame:
    """The box's points: candidate blocks by semi-join, tick ranges the scan can use, then the exact test."""
    keep = candidates(block_table, bounds).select("block_id")
    near = F.lit(True)
    for i, a in enumerate("xyz"):
        low, high = bounds.tick_range(transform, i)
        near = near & F.col(f"t{a}").between(low, high)
    hit = points.where(near & bounds.contains(*[transform.column(i) for i in range(3)])).withColumn("block_id", F.expr(f"ordinal div {block_points}"))
    return hit.join(keep, "block_id", "left_semi").drop("block_id")


def bottom_k(points: DataFrame, group: F.Column, k: int = SAMPLE_POINTS) -> DataFrame:
    """The k points of least (priority, ordinal) in each group. A group with more rows than a task likes is cut in salted
    parts first: bottom-k of bottom-k is bottom-k."""
    salted = with_priority(points.withColumn("node_id", group), "ordinal", "__priority").withColumn("__priority", unsigned_order(F.col("__priority")))
    order = ["__priority", "ordinal"]
    part = Window.partitionBy("node_id", F.pmod(F.col("__priority"), F.lit(16))).orderBy(*order)
    few = salted.withColumn("__n", F.row_number().over(part)).where(F.col("__n") <= k)
    whole = Window.partitionBy("node_id").orderBy(*order)
    return few.withColumn("__n", F.row_number().over(whole)).where(F.col("__n") <= k).drop("__n", "__priority")


def plan_tree(spark: SparkSession, block_table: DataFrame, sample_points: int = SAMPLE_POINTS, max_blocks: int = 1_000_000) -> DataFrame:
    """2 x leaves - 1 nodes over the blocks, numbered breadth-first: median splits on the longest axis of the centroids.

    Works on one row for each 65,536 points, on the driver, under a limit that fails rather than cuts.
    """
    rows = [r.asDict() for r in block_table.limit(max_blocks + 1).collect()]
    if len(rows) > max_blocks:
        raise PlumblineError(f"more than {max_blocks} blocks")
    if not rows:
        return spark.createDataFrame([], _NODE)
    for r in rows:
        r["centre"] = [r[f"min_{a}"] * 0.5 + r[f"max_{a}"] * 0.5 for a in "xyz"]
    out, level = [], [(rows, None)]
    nxt: list = []
    while level:
        for members, parent in level:
            node = len(out)
            box = {f"min_{a}": min(r[f"min_{a}"] for r in members) for a in "xyz"} | {f"max_{a}": max(r[f"max_{a}"] for r in members) for a in "xyz"}
            covered = sum(r["point_count"] for r in members)
            leaf = len(members) == 1
            diagonal = 0.0 if leaf else min(math.hypot(math.hypot(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]), box["max_z"] - box["min_z"]), 1.7976931348623157e308)
            out.append((node, parent, *[box[c] for c in BOX], covered, covered if leaf else min(covered, sample_points), diagonal, members[0]["first_ordinal"] if leaf else None, members[0]["block_id"] if leaf else None))
            if not leaf:
                extent = [max(r["centre"][i] for r in members) - min(r["centre"][i] for r in members) for i in range(3)]
                axis = extent.index(max(extent))
                members = sorted(members, key=lambda r: (r["centre"][axis], r["first_ordinal"]))
                half = len(members) // 2
                nxt += [(members[:half], node), (members[half:], node)]
        level, nxt = nxt, []
    return spark.createDataFrame(out, _NODE)


_NODE = "node_id long, parent_id long, " + ", ".join(f"{c} double" for c in BOX) + ", covered long, display_count long, geometric_error double, first_ordinal long, block_id long"


def tree_violations(nodes: DataFrame) -> DataFrame:
    """Rows that break the tree's rules: a child outside its parent, counts that don't add up, an id before its parent's."""
    p = nodes.select(F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in BOX], F.col("covered").alias("p_covered"))
    kids = nodes.where("parent_id is not null").join(p, "parent_id")
    out = F.lit(False)
    for a in "xyz":
        out = out | (F.col(f"min_{a}") < F.col(f"p_min_{a}")) | (F.col(f"max_{a}") > F.col(f"p_max_{a}"))
    bad = kids.where(out | (F.col("node_id") <= F.col("parent_id"))).select("node_id")
    sums = kids.groupBy("parent_id", "p_covered").agg(F.sum("covered").alias("s"), F.count("*").alias("n")).where("s <> p_covered or n <> 2").select(F.col("parent_id").alias("node_id"))
    return bad.unionByName(sums)


def ancestors(nodes: DataFrame) -> DataFrame:
    """(leaf block_id, node_id) for every internal ancestor, by as many joins as the tree is deep."""
    at = nodes.where("block_id is not null").select("block_id", F.col("parent_id").alias("node_id")).where("node_id is not null")
    up = nodes.select("node_id", "parent_id")
    out = at
    depth = math.ceil(math.log2(max(2, nodes.count()))) + 1
    for _ in range(depth):
        at = at.join(F.broadcast(up), "node_id").select("block_id", F.col("parent_id").alias("node_id")).where("node_id is not null")  # a node for 32,768 points
        out = out.unionByName(at)
    return out


def node_samples(points: DataFrame, nodes: DataFrame, block_points: int = BLOCK_POINTS, k: int = SAMPLE_POINTS) -> DataFrame:
    """The display sample of every internal node: k least of its blocks' samples, blocks cut to their k least first."""
    few = bottom_k(points, F.expr(f"ordinal div {block_points}"), k).withColumnRenamed("node_id", "block_id")
    spread = few.join(ancestors(nodes), "block_id").drop("block_id")
    return bottom_k(spread.withColumnRenamed("node_id", "own"), F.col("own"), k).drop("own")


def merge_adjacent(spans: DataFrame) -> DataFrame:
    """Unites spans that touch exactly."""
    from plumbline.sources.spans import normalize_spans

    return normalize_spans(spans)
