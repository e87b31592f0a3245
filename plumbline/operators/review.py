"""Selection through a camera's screen rectangle over whole snapshots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geometry import Camera
from plumbline.model import PlumblineError, Transform


def rectangle(first: tuple[float, float], second: tuple[float, float], width: int, height: int) -> tuple[float, float, float, float]:
    """(left, top, right, bottom) from two corners in any order, inside the viewport."""
    if not all(map(math.isfinite, (*first, *second))):
        raise PlumblineError("corners must be finite")
    left, right = sorted((first[0], second[0]))
    top, bottom = sorted((first[1], second[1]))
    if left < 0 or top < 0 or right > width or bottom > height:
        raise PlumblineError("the rectangle leaves the viewport")
    return left, top, right, bottom


def replace_highlights(ids: DataFrame, limit: int) -> DataFrame:
    """A new set of highlighted ids; the limit holds for what is handed in, before repeats go."""
    if ids.limit(limit + 1).count() > limit:
        raise PlumblineError(f"more than {limit} highlights")
    return ids.select("ordinal").distinct()


def screen_through(rows: DataFrame, camera: Camera, transform: Transform, rect: tuple[float, float, float, float], width: int, height: int, classification: int | None = None, check: bool = True) -> DataFrame:
    """Rows whose projection lies in the rectangle, edges included. With check, a projection that isn't finite is an error
    even where the class filter would drop the row."""
    view = camera.projected(*[transform.column(i) for i in range(3)], width, height)
    seen = rows.withColumns({"__depth": view["depth"], "px": view["px"], "py": view["py"], "__inside": view["inside"]})
    if check:
        finite = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
        odd = ~finite("__depth") | (F.col("__inside") & ~(finite("px") & finite("py")))
        seen = seen.withColumn("__inside", F.when(odd, F.raise_error(F.lit("a projection is not finite"))).otherwise(F.col("__inside")))
    left, top, right, bottom = rect
    hit = seen.where(F.col("__inside") & F.col("px").between(left, right) & F.col("py").between(top, bottom))
    if classification is not None:
        hit = hit.where(F.col("classification") == classification)
    return hit.drop("__depth", "__inside")
