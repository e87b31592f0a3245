"""Check points, residuals, tolerances and profiles over a surface."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import orientation, tolerance_class
from plumbline.model import PlumblineError, Transform
from plumbline.operators.terrain import with_corners
from plumbline.runtime import ship


def world_faces(faces: DataFrame, verts: DataFrame, transform: Transform) -> DataFrame:
    c = with_corners(faces, verts)
    return c.select("face_id", *[transform.column("xyz".index(a), f"{a}{i}").alias(f"{a}{i}") for i in (1, 2, 3) for a in "xyz"])


#: Relative error of a side's area in doubles, with room to spare: beyond it, the sign is sure.
SLACK = 1e-15


def _holds(x1, y1, x2, y2, x3, y3, x, y) -> bool:
    """Whether the closed triangle holds the point, in exact fractions; a point without coordinates is nowhere."""
    if None in (x, y):
        return False
    a, b, c, p = ((Fraction(u), Fraction(v)) for u, v in ((x1, y1), (x2, y2), (x3, y3), (x, y)))
    return all((s[0] - r[0]) * (p[1] - r[1]) - (s[1] - r[1]) * (p[0] - r[0]) >= 0 for r, s in ((b, c), (c, a), (a, b)))


def locate(queries: DataFrame, faces: DataFrame, cell: float, keys: list[str]) -> DataFrame:
    """Each query point (keys, x, y, ...) with the lowest face that holds it, edges included, and the height there; nulls
    are gaps.

    A range join by a grid: faces go to the cells that their boxes touch, points to theirs, and only equal cells meet. The
    exact test and the least face follow; a point's candidates are the few faces of a cell. Doubles decide where their error
    bound allows; points on or next to an edge are decided in exact fractions.
    """
    if not cell > 0:
        raise PlumblineError("cells need a size")
    ship(queries.sparkSession)
    index = lambda c: F.floor(c / cell).cast("long")
    boxes = faces.select("*", *[F.sequence(index(F.least(*[F.col(f"{a}{i}") for i in (1, 2, 3)])), index(F.greatest(*[F.col(f"{a}{i}") for i in (1, 2, 3)]))).alias(f"c{a}") for a in "xy"])
    cells = boxes.withColumn("__cx", F.explode("cx")).withColumn("__cy", F.explode("cy")).drop("cx", "cy")
    q = queries.withColumns({"__cx": index(F.col("x")), "__cy": index(F.col("y"))})
    col = lambda i: (F.col(f"x{i}"), F.col(f"y{i}"))
    point = (F.col("x"), F.col("y"))
    sides = ((2, 3), (3, 1), (1, 2))
    area = [orientation(*col(a), *col(b), *point) for a, b in sides]
    total = orientation(*col(1), *col(2), *col(3))
    height = (area[0] / total) * F.col("z1") + (area[1] / total) * F.col("z2") + (1.0 - area[0] / total - area[1] / total) * F.col("z3")
    near = q.join(cells, ["__cx", "__cy"])
    slack = [SLACK * (F.abs(F.col(f"x{b}") - F.col(f"x{a}")) * F.abs(F.col("y") - F.col(f"y{a}")) + F.abs(F.col(f"y{b}") - F.col(f"y{a}")) * F.abs(F.col("x") - F.col(f"x{a}"))) for a, b in sides]
    sure, beyond = F.lit(True), F.lit(False)
    for v, e in zip(area, slack, strict=True):
        sure, beyond = sure & (v > e), beyond | (v < -e)
    names = near.columns
    spots = [names.index(c) for c in ("x1", "y1", "x2", "y2", "x3", "y3", "x", "y")]

    def exact(batches):
        import pyarrow as pa

        for batch in batches:
            held = [batch.column(i).to_pylist() for i in spots]
            yield batch.filter(pa.array([_holds(*values) for values in zip(*held, strict=True)], pa.bool_()))

    found = near.where(sure).unionByName(near.where(~sure & ~beyond).mapInArrow(exact, near.schema))
    hit = found.groupBy(*keys).agg(F.min(F.struct("face_id", height.alias("surface_z"))).alias("hit"))
    return queries.join(hit.select(*keys, "hit.face_id", "hit.surface_z"), keys, "left")


def residuals(located: DataFrame, below: float, above: float) -> DataFrame:
    """residual = observed - surface, with its class; gaps stay as rows of nulls."""
    if not (below >= 0 and above >= 0):
        raise PlumblineError("tolerances are not negative")
    r = F.col("z") - F.col("surface_z")
    return located.withColumn("residual", r).withColumn("tolerance", tolerance_class(r, below, above))


def statistics(rows: DataFrame) -> DataFrame:
    """Covered, gaps, least, greatest, mean and RMS; the RMS is scaled by the greatest magnitude, so it can't overflow.
    Without covered points all but the counts are null."""
    held = rows.agg(F.max(F.abs("residual")).alias("m"), F.count("residual").alias("n")).first()
    m, n = held.m or 1.0, held.n
    scaled = F.col("residual") / m
    own = rows.where("residual is not null")
    mean = compensated_sum(own.select(scaled.alias("v"))) / n * m if n else None
    rms = math.sqrt(compensated_sum(own.select((scaled * scaled).alias("v"))) / n) * m if n else None
    return rows.agg(F.count("residual").alias("covered"), F.count_if(F.col("residual").isNull()).alias("gaps"), F.min("residual").alias("min"), F.max("residual").alias("max"), F.lit(mean).cast("double").alias("mean"), F.lit(rms).cast("double").alias("rms"))


def compensated_sum(values: DataFrame) -> float:
    """The sum of a column of doubles, without the rounding of each addition: a batch gives its correctly rounded sum and
    what that leaves out, and these pairs are summed exactly. Order and partitions don't show in the result."""

    ship(values.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column(0).drop_null().to_pylist()
            high = math.fsum(own)
            yield pa.RecordBatch.from_arrays([pa.array([high, math.fsum([*own, -high])])], names=["part"])

    return math.fsum(r.part for r in values.mapInArrow(run, "part double").toLocalIterator())  # two for a batch


def tolerance_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("tolerance") == t).alias(t) for t in ("below", "within", "above")], F.count_if(F.col("tolerance").isNull()).alias("gap"))


def profile_stations(spark: SparkSession, start: tuple[float, float], end: tuple[float, float], intervals: int) -> DataFrame:
    """intervals + 1 stations from start to end; the ends are exact, those between interpolated."""
    if intervals < 1 or start == end:
        raise PlumblineError("a profile needs two ends and an interval")
    length = math.hypot(end[0] - start[0], end[1] - start[1])
    part = F.col("idx") / F.lit(float(intervals))
    between = lambda a, b: F.when(F.col("idx") == 0, a).when(F.col("idx") == intervals, b).otherwise(F.lit(a) + (b - a) * part)
    return spark.range(intervals + 1).select(F.col("id").alias("idx")).select("idx", (F.lit(length) * F.col("idx") / float(intervals)).alias("station_m"), between(start[0], end[0]).alias("x"), between(start[1], end[1]).alias("y"))


def freshness(stale_snapshot: Column, stale_surface: Column, has_surface: Column) -> Column:
    """How a report stands to the current snapshot and surface."""
    return (
        F.when(stale_snapshot & stale_surface, "stale_snapshot_and_surface")
        .when(stale_snapshot, "stale_snapshot")
        .when(stale_surface, "stale_surface")
        .when(has_surface, "current")
        .otherwise("snapshot_only_current")
    )


def require_unique(ids: DataFrame) -> None:
    if ids.groupBy("id").count().where("count > 1 or id = 0").limit(1).count():
        raise PlumblineError("check point ids must be unique and not 0")
