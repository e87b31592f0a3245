"""Persistent surfaces and exact QA reports: prepared once for a lineage, opened afterwards, resumed in between."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import Bounds, PlumblineError, SpatialReference, Transform
from plumbline.operators import qa, terrain, workspace
from plumbline.sources.spans import content_digest, ordered_batches


@dataclass(frozen=True)
class Recipe:
    ground_class: int = 2
    bounds: Bounds | None = None

    def digest(self) -> str:
        b = self.bounds
        return hashlib.sha256(json.dumps(["recipe", self.ground_class, b and [b.low, b.high]]).encode()).hexdigest()


def ground_input(snapshot: DataFrame, recipe: Recipe, transform: Transform, reference: SpatialReference | None) -> DataFrame:
    """The ground points of a snapshot; a metric reference is required."""
    terrain.require_metric(reference)
    return workspace.query(snapshot, transform, recipe.bounds, recipe.ground_class).select("ordinal", "tx", "ty", "tz")


@dataclass(frozen=True)
class Surface:
    vertices: DataFrame
    faces: DataFrame
    descriptor: dict
    disposition: str  # opened, built or resumed


def _hashes(v: DataFrame, f: DataFrame) -> tuple[str, str]:
    geometry = content_digest(v.withColumnRenamed("ordinal", "point").withColumn("ordinal", F.col("vertex_id") - 1), ["vertex_id", "point", "tx", "ty", "tz"]).first()[0]
    topology = content_digest(f.withColumn("ordinal", F.col("face_id") - 1), ["v1", "v2", "v3"]).first()[0]
    return geometry, topology


def _artifact(descriptor: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in descriptor.items() if k != "artifact"}, sort_keys=True).encode()).hexdigest()


def _publish(path: str, facts: dict) -> None:
    with open(path + ".new", "w") as f:
        json.dump(facts, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".new", path)


def prepare(spark: SparkSession, root: str, snapshot: DataFrame, lineage: str, recipe: Recipe, transform: Transform, reference: SpatialReference | None) -> Surface:
    """Opens the surface of this lineage and recipe if it is complete, else builds it; a verified input that an earlier
    attempt left is used again. The descriptor is written last, so an incomplete surface is never opened."""
    key = hashlib.sha256(f"{lineage}|{recipe.digest()}|{transform}".encode()).hexdigest()
    folder, done = os.path.join(root, key), os.path.join(root, key, "descriptor.json")
    paths = {n: os.path.join(folder, n) for n in ("input", "vertices", "faces")}
    if os.path.exists(done):
        with open(done) as f:
            d = json.load(f)
        if d["artifact"] != _artifact(d):
            raise PlumblineError("the stored descriptor is damaged")
        v, fa = spark.read.schema(terrain.VERTEX).parquet(paths["vertices"]), spark.read.schema(terrain.FACE).parquet(paths["faces"])
        if list(_hashes(v, fa)) != [d["geometry"], d["topology"]] or any(r.n for r in terrain.surface_violations(v, fa, transform.scale[:2]).collect()):
            raise PlumblineError("the stored surface doesn't match its descriptor")
        return Surface(v, fa, d, "opened")
    terrain.require_metric(reference)
    read = lambda: spark.read.schema("ordinal long, tx long, ty long, tz long").parquet(paths["input"])
    known, own = os.path.join(folder, "input.json"), ["ordinal", "tx", "ty", "tz"]
    resumed = False
    if os.path.exists(known):
        with open(known) as f:
            resumed = json.load(f) == {"lineage": lineage, "input": content_digest(read(), own).first()[0]}
    if not resumed:  # not there, or not what was written
        ground_input(snapshot, recipe, transform, reference).write.mode("overwrite").parquet(paths["input"])
        _publish(known, {"lineage": lineage, "input": content_digest(read(), own).first()[0]})
    points = read()
    with open(known) as f:
        input_hash = json.load(f)["input"]
    v, fa = terrain.derive(points, transform.scale[:2])
    v.write.mode("overwrite").parquet(paths["vertices"])
    fa.write.mode("overwrite").parquet(paths["faces"])
    v, fa = spark.read.schema(terrain.VERTEX).parquet(paths["vertices"]), spark.read.schema(terrain.FACE).parquet(paths["faces"])
    n, m = v.count(), fa.count()
    geometry, topology = _hashes(v, fa)
    d = {"lineage": lineage, "recipe": recipe.digest(), "reference": reference.canonical_bytes().hex(), "transform": [list(transform.offset), list(transform.scale)], "input": input_hash, "vertices": n, "faces": m, "hull": terrain.hull_size(n, m), "geometry": geometry, "topology": topology}
    d["artifact"] = _artifact(d)
    _publish(done, d)
    return Surface(v, fa, d, "resumed" if resumed else "built")


def vertex_batches(surface: Surface, rows: int = 65_536):
    """The vertices in order of their ids, as Arrow batches of a bounded size. Each call starts anew."""
    yield from ordered_batches(surface.vertices, "vertex_id", rows)


def face_batches(surface: Surface, rows: int = 65_536):
    """The faces in order of their ids, as Arrow batches of a bounded size."""
    yield from ordered_batches(surface.faces, "face_id", rows)


def results_digest(report: Report, lineage: str, artifact: str, below: float, above: float) -> str:
    """One digest of a report's ordered results, bound to the snapshot, the surface and the tolerance."""
    parts = [["qa", lineage, artifact, below.hex(), above.hex()]]
    for df, key in ((report.source_points, "ordinal"), (report.check_points, "id"), (report.profile, "idx")):
        if df is not None:
            named = df if key == "ordinal" else df.withColumn("ordinal", F.col(key))
            own = [c for c in ("ordinal", "x", "y", "z", "face_id", "surface_z", "residual", "tolerance") if c in named.columns]
            parts.append([key, own, content_digest(named, own).first()[0]])
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def compare(before: Surface, after: Surface) -> DataFrame:
    """Faces added and removed; surfaces of different recipes don't compare."""
    for part in ("recipe", "reference", "transform"):
        if json.dumps(before.descriptor[part]) != json.dumps(after.descriptor[part]):
            raise PlumblineError(f"the surfaces differ in their {part}")
    return terrain.compare_surfaces((before.vertices, before.faces), (after.vertices, after.faces))


@dataclass(frozen=True)
class Report:
    source_points: DataFrame
    check_points: DataFrame
    profile: DataFrame | None
    statistics: DataFrame
    tolerance: DataFrame


def exact_qa(verts: DataFrame, faces: DataFrame, transform: Transform, rows: DataFrame, checks: DataFrame, below: float, above: float, cell: float, profile: tuple[tuple[float, float], tuple[float, float], int] | None = None) -> Report:
    """Residuals of snapshot rows (any class) and check points; stations of a profile are located but are no residuals."""
    qa.require_unique(checks)
    world = qa.world_faces(faces, verts, transform)
    own = rows.select("ordinal", *transform.columns())
    source = qa.residuals(qa.locate(own, world, cell, ["ordinal"]), below, above)
    check = qa.residuals(qa.locate(checks, world, cell, ["id"]), below, above)
    both = source.select("residual", "tolerance").unionByName(check.select("residual", "tolerance"))
    stations = profile and qa.locate(qa.profile_stations(rows.sparkSession, *profile), world, cell, ["idx"])
    return Report(source, check, stations, qa.statistics(both), qa.tolerance_summary(both))
