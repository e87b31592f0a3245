"""Comparing a returned surface with its reference: vertex match, face sets, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_within(reference: DataFrame, returned: DataFrame, horizontal: float, vertical: float) -> DataFrame:
    """(ref_id, ret_id, d_east, d_north, d_plan, d_up) of all pairs within both tolerances, edges included.

    A band join: points meet in cells of the tolerance's size, the reference in its own and the eight around it. Both sides
    are shuffled: the planner goes by the size of packed files, and would send a whole side through the driver.
    """
    size = max(horizontal, 1e-9)
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = reference.select(F.col("id").alias("ref_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), cell("x").alias("u"), cell("y").alias("v")).withColumn("s", F.explode(around))
    a = a.select("ref_id", "ax", "ay", "az", (F.col("u") + F.col("s.i")).alias("u"), (F.col("v") + F.col("s.j")).alias("v"))
    b = returned.select(F.col("id").alias("ret_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"), cell("x").alias("u"), cell("y").alias("v"))
    de, dn, du = F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")), F.abs(F.col("bz") - F.col("az"))
    out = a.join(b.hint("merge"), ["u", "v"]).select("ref_id", "ret_id", de.alias("d_east"), dn.alias("d_north"), F.hypot(de, dn).alias("d_plan"), du.alias("d_up"))
    return out.where((F.col("d_plan") <= horizontal) & (F.col("d_up") <= vertical))


def match_problems(matches: DataFrame, reference: DataFrame, returned: DataFrame) -> DataFrame:
    """(side, id, matches) of the points without exactly one match. Counts for each point are a table, not to be broadcast."""
    out = None
    for side, table, key in (("reference", reference, "ref_id"), ("returned", returned, "ret_id")):
        n = matches.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("matches"))
        bad = table.select("id").join(n.hint("merge"), "id", "left").select(F.lit(side).alias("side"), "id", F.coalesce("matches", F.lit(0)).cast("long").alias("matches")).where("matches <> 1")
        out = bad if out is None else out.unionByName(bad)
    return out


def match_exact(reference: DataFrame, returned: DataFrame) -> DataFrame:
    return reference.select(F.col("id").alias("ref_id"), "x", "y", "z").join(returned.select(F.col("id").alias("ret_id"), "x", "y", "z"), ["x", "y", "z"]).select("ref_id", "ret_id")


def canonical_faces(faces: DataFrame) -> DataFrame:
    """Rotated so that the least id comes first; the winding stays."""
    a, b, c = F.col("v1"), F.col("v2"), F.col("v3")
    first = F.when((a <= b) & (a <= c), F.struct(a.alias("v1"), b.alias("v2"), c.alias("v3"))).when((b <= a) & (b <= c), F.struct(b.alias("v1"), c.alias("v2"), a.alias("v3"))).otherwise(F.struct(c.alias("v1"), a.alias("v2"), b.alias("v3")))
    return faces.select(first.alias("f")).select("f.*")


def topology_drift(reference: DataFrame, returned: DataFrame, matches: DataFrame) -> DataFrame:
    """(side, v1, v2, v3): faces of one side only, in the reference's ids."""
    moved = returned.select("v1", "v2", "v3")
    for i in (1, 2, 3):
        moved = moved.join(matches.select(F.col("ret_id").alias(f"v{i}"), F.col("ref_id").alias(f"r{i}")), f"v{i}")
    moved = canonical_faces(moved.select(*[F.col(f"r{i}").alias(f"v{i}") for i in (1, 2, 3)]))
    own = canonical_faces(reference.select("v1", "v2", "v3"))
    lost = own.exceptAll(moved).select(F.lit("reference").alias("side"), "v1", "v2", "v3")
    return lost.unionByName(moved.exceptAll(own).select(F.lit("returned").alias("side"), "v1", "v2", "v3"))


def drift_summary(drift: DataFrame, sample: int = 16) -> DataFrame:
    """(side, faces, face_check, sample) of the faces that one side has alone: how many, a check that doesn't depend on
    their order, and the first few."""
    first = Window.partitionBy("side").orderBy("v1", "v2", "v3")
    few = drift.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample)  # a report of the first few, by design
    listed = few.groupBy("side").agg(F.array_sort(F.collect_list(F.array("v1", "v2", "v3"))).alias("sample"))
    return drift.groupBy("side").agg(F.count("*").alias("faces"), F.bit_xor(F.xxhash64("v1", "v2", "v3")).alias("face_check")).join(listed, "side")


def bad_faces(faces: DataFrame, points: DataFrame) -> DataFrame:
    """(reason, v1, v2, v3): repeated corners, missing points, no area, or a face that is there twice."""
    f = faces.select("v1", "v2", "v3")
    same = f.where("v1 = v2 or v2 = v3 or v1 = v3").withColumn("reason", F.lit("repeated_corner"))
    twice = canonical_faces(f).select(F.array_sort(F.array("v1", "v2", "v3")).alias("k")).groupBy("k").count().where("count > 1").select(*[F.col("k")[i].alias(f"v{i + 1}") for i in range(3)]).withColumn("reason", F.lit("duplicate"))
    c = f
    for i in (1, 2, 3):
        c = c.join(points.select(F.col("id").alias(f"v{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")), f"v{i}", "left")
    lost = c.where("x1 is null or x2 is null or x3 is null").select("v1", "v2", "v3").withColumn("reason", F.lit("missing_point"))
    flat = c.where("(x2 - x1) * (y3 - y1) = (y2 - y1) * (x3 - x1)").where("v1 <> v2 and v2 <> v3 and v1 <> v3").select("v1", "v2", "v3").withColumn("reason", F.lit("no_area"))
    out = same
    for x in (twice, lost, flat):
        out = out.unionByName(x)
    return out.select("reason", "v1", "v2", "v3")
