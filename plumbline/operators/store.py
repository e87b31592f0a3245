"""The stored index: blocks, hierarchy and display samples of a source, built once, opened afterwards, resumed in between.

Layout of a complete index: points (sorted by ordinal, a file for each run of blocks), blocks, nodes, samples, and
manifest.json with the digests of all but the points, whose digest is the source's. While it is built, all of it lies in
<root>.work: frames of FRAME_BLOCKS blocks, each with a JSON file written after its rows. A frame whose rows contradict its
file is built again. The finished folder gets its name by one rename, so an incomplete index is never opened.
"""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import Bounds, PlumblineError, Transform
from plumbline.operators import index
from plumbline.sources.spans import content_digest

FRAME_BLOCKS = 256
BLOCK_COLUMNS = ["block_id", "first_ordinal", "point_count", *index.BOX]
NODE_COLUMNS = ["node_id", "parent_id", *index.BOX, "covered", "display_count", "geometric_error", "first_ordinal", "block_id"]


@dataclass(frozen=True)
class Recipe:
    """What samples carry besides positions."""

    attributes: tuple[str, ...] = ()
    block_points: int = index.BLOCK_POINTS
    sample_points: int = index.SAMPLE_POINTS

    def check(self, points: DataFrame) -> None:
        """Intensity and class come together; colours are all there or none."""
        have = set(self.attributes)
        if missing := have - set(points.columns):
            raise PlumblineError(f"no such attributes: {sorted(missing)}")
        colours = have & {"red", "green", "blue"}
        if have and not {"intensity", "classification"} <= have or colours and len(colours) < 3:
            raise PlumblineError("samples for inspection need intensity and class, and all three colours or none")


def _table_digest(df: DataFrame, key: str, columns: list[str]) -> str:
    """Of rows by key; unsigned or repeated keys don't occur in these tables."""
    return content_digest(df.withColumn("ordinal", F.col(key)).select("ordinal", *[c for c in columns if c != "ordinal"]), [c for c in columns if c != "ordinal"]).first()[0]


class Index:
    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root, manifest
        self.transform, self.recipe = Transform(*map(tuple, manifest["transform"])), Recipe(**manifest["recipe"] | {"attributes": tuple(manifest["recipe"]["attributes"])})

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, name))

    def points(self) -> DataFrame:
        return self.table("points").drop("frame")

    def candidates(self, bounds: Bounds, max_blocks: int | None = None) -> DataFrame:
        """The blocks that may hold a point of the box; more of them than the limit are an error."""
        hit = index.candidates(self.table("blocks"), bounds)
        if max_blocks is not None and hit.limit(max_blocks + 1).count() > max_blocks:
            raise PlumblineError(f"more than {max_blocks} candidate blocks")
        return hit

    def visited(self, bounds: Bounds) -> DataFrame:
        """(node_id) of the nodes that a walk from the root looks at: the root, and the children of nodes that the box meets."""
        nodes = self.table("nodes")
        met = nodes.where(index.intersects(bounds)).select(F.col("node_id").alias("parent_id"))
        return nodes.where("parent_id is null").select("node_id").unionByName(nodes.join(met, "parent_id").select("node_id"))

    def query(self, bounds: Bounds) -> DataFrame:
        """The box's points. The spans of the candidate blocks, united, bound the ordinals, so the scan skips row groups;
        the blocks themselves are a semi-join, and the exact test follows."""
        blocks = self.candidates(bounds)
        reach = blocks.agg(F.min("first_ordinal"), F.max(F.col("first_ordinal") + F.col("point_count"))).first()
        if reach[0] is None:
            return self.points().where(F.lit(False))
        near = F.col("ordinal").between(reach[0], reach[1] - 1)
        for i, a in enumerate("xyz"):
            near = near & F.col(f"t{a}").between(*bounds.tick_range(self.transform, i))
        exact = bounds.contains(*[self.transform.column(i) for i in range(3)])
        hit = self.points().where(near & exact).withColumn("block_id", F.expr(f"ordinal div {self.recipe.block_points}"))
        return hit.join(blocks.select("block_id"), "block_id", "left_semi").drop("block_id")

    def read_node(self, node_id: int, max_points: int | None = None) -> DataFrame:
        """All points of a leaf, the sample of an inner node; a node that isn't there or is too large is an error."""
        row = self.table("nodes").where(F.col("node_id") == node_id).first()
        if row is None:
            raise PlumblineError(f"no node {node_id}")
        if max_points is not None and row.display_count > max_points:
            raise PlumblineError(f"node {node_id} has {row.display_count} points; the limit is {max_points}")
        carried = ["ordinal", "tx", "ty", "tz", *self.recipe.attributes]
        if row.block_id is not None:
            rows = self.points().where(F.col("ordinal").between(row.first_ordinal, row.first_ordinal + row.covered - 1))
        else:
            rows = self.table("samples").where(F.col("node_id") == node_id)
        return rows.select(*carried, *self.transform.columns())

    def relative(self, rows: DataFrame, origin: tuple[float, float, float]) -> DataFrame:
        """Single-precision coordinates about an origin; a value that doesn't stay finite is an error."""
        return relative_positions(rows, origin)


def relative_positions(rows: DataFrame, origin: tuple[float, float, float]) -> DataFrame:
    """(ordinal, rx, ry, rz): world less origin, narrowed to floats that must be finite."""
    out = []
    for a, o in zip("xyz", origin, strict=True):
        v = (F.col(a) - F.lit(o)).cast("float")
        out.append(F.when(F.isnan(v) | (F.abs(v) > 3.4028235e38), F.raise_error(F.lit("a position isn't finite about this origin")).cast("float")).otherwise(v).alias(f"r{a}"))
    return rows.select("ordinal", *out)


def sample_problems(points: DataFrame, samples: DataFrame, nodes: DataFrame, recipe: Recipe) -> DataFrame:
    """(node_id, ordinal) of samples that are not the least of their node's points, or miss."""
    held = samples.select("node_id", "ordinal")
    due = index.node_samples(points.select("ordinal"), nodes, recipe.block_points, recipe.sample_points).select("node_id", "ordinal")
    return held.exceptAll(due).unionByName(due.exceptAll(held))


def _frames(points: DataFrame, recipe: Recipe) -> DataFrame:
    return points.withColumn("frame", F.expr(f"ordinal div {recipe.block_points * FRAME_BLOCKS}"))


def build(spark: SparkSession, root: str, points: DataFrame, source_id: str, transform: Transform, recipe: Recipe = Recipe(), fresh: bool = False, stop_after: str | None = None) -> Index:
    """Opens a complete index of this source and recipe, else goes on with what is there, else builds it. fresh: a target
    that exists is an error. stop_after ("frames" or "tree") ends early, as a crash would."""
    if os.path.exists(os.path.join(root, "manifest.json")):
        if fresh:
            raise PlumblineError("the target exists")
        return open_index(spark, root, source_id, recipe)
    recipe.check(points)
    work = root + ".work"
    about = {"source": source_id, "transform": [list(transform.offset), list(transform.scale)], "recipe": asdict(recipe) | {"attributes": list(recipe.attributes)}}
    header = os.path.join(work, "header.json")
    if os.path.exists(header):
        with open(header) as f:
            if json.load(f) != about:
                shutil.rmtree(work)  # of another source or recipe
    os.makedirs(work, exist_ok=True)
    _publish(header, about)
    stored, done = os.path.join(work, "points"), os.path.join(work, "frames")
    os.makedirs(done, exist_ok=True)
    good = _good_frames(spark, stored, done)
    for name in os.listdir(stored) if os.path.isdir(stored) else []:
        if name.startswith("frame=") and int(name[6:]) not in good:
            shutil.rmtree(os.path.join(stored, name))
    framed = _frames(points.select("ordinal", "tx", "ty", "tz", *recipe.attributes), recipe)
    rest = framed.where(~F.col("frame").isin(*good)) if good else framed
    rest.repartitionByRange("frame", "ordinal").sortWithinPartitions("frame", "ordinal").write.mode("append").partitionBy("frame").parquet(stored)
    for frame, n, check in _frame_checks(spark, stored):
        _publish(os.path.join(done, f"{frame}.json"), {"rows": n, "check": check})
    if stop_after == "frames":
        raise PlumblineError("stopped after the frames")
    own = spark.read.parquet(stored).drop("frame")
    index.blocks(own, transform, recipe.block_points).select(BLOCK_COLUMNS).sort("block_id").write.mode("overwrite").parquet(os.path.join(work, "blocks"))
    blocks = spark.read.parquet(os.path.join(work, "blocks"))
    index.plan_tree(spark, blocks, recipe.sample_points).select(NODE_COLUMNS).sort("node_id").write.mode("overwrite").parquet(os.path.join(work, "nodes"))
    if stop_after == "tree":
        raise PlumblineError("stopped after the tree")
    nodes = spark.read.parquet(os.path.join(work, "nodes"))
    samples = index.node_samples(own, nodes, recipe.block_points, recipe.sample_points)
    samples.repartitionByRange("node_id", "ordinal").sortWithinPartitions("node_id", "ordinal").write.mode("overwrite").parquet(os.path.join(work, "samples"))
    _publish(os.path.join(work, "manifest.json"), about | {"digests": _digests(spark, work)})
    shutil.rmtree(done)
    os.rename(work, root)
    return open_index(spark, root, source_id, recipe)


def open_index(spark: SparkSession, root: str, source_id: str, recipe: Recipe) -> Index:
    """A complete index of this source and recipe, its tables held against the manifest; anything else is an error."""
    with open(os.path.join(root, "manifest.json")) as f:
        manifest = json.load(f)
    if manifest["source"] != source_id:
        raise PlumblineError("the index is of another source")
    if manifest["recipe"] != asdict(recipe) | {"attributes": list(recipe.attributes)}:
        raise PlumblineError("the index has another recipe")
    if _digests(spark, root) != manifest["digests"]:
        raise PlumblineError("the index doesn't match its manifest")
    return Index(spark, root, manifest)


def _digests(spark: SparkSession, folder: str) -> dict[str, str]:
    read = lambda name: spark.read.parquet(os.path.join(folder, name))
    points, samples = read("points").drop("frame"), read("samples")
    check = points.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*points.columns)).alias("h")).first()
    ranked = samples.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*samples.columns)).alias("h")).first()
    return {
        "blocks": _table_digest(read("blocks"), "block_id", BLOCK_COLUMNS),
        "nodes": _table_digest(read("nodes").withColumnRenamed("first_ordinal", "first"), "node_id", ["first" if c == "first_ordinal" else c for c in NODE_COLUMNS]),
        "points": f"{check.n}:{check.h}",
        "samples": f"{ranked.n}:{ranked.h}",
    }


def _frame_checks(spark: SparkSession, stored: str) -> list[tuple[int, int, int]]:
    rows = spark.read.parquet(stored)
    own = [c for c in rows.columns if c != "frame"]
    return [tuple(r) for r in rows.groupBy("frame").agg(F.count("*"), F.bit_xor(F.xxhash64(*own))).collect()]  # a row for 2^24 points


def _good_frames(spark: SparkSession, stored: str, done: str) -> list[int]:
    if not os.path.isdir(stored) or not any(n.startswith("frame=") for n in os.listdir(stored)):
        return []
    said = {}
    for name in os.listdir(done):
        if name.endswith(".json"):
            with open(os.path.join(done, name)) as f:
                said[int(name[:-5])] = json.load(f)
    return [f for f, n, h in _frame_checks(spark, stored) if said.get(f) == {"rows": n, "check": h}]


def _publish(path: str, facts: dict) -> None:
    with open(path + ".new", "w") as f:
        json.dump(facts, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".new", path)
