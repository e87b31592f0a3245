"""The data model: integer ticks are the truth, world coordinates are derived from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class PlumblineError(ValueError):
    """A request that cannot be met; nothing is truncated or guessed instead."""


@dataclass(frozen=True)
class Transform:
    """World = tick x scale + offset, in that order, on every axis."""

    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    scale: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def __post_init__(self):
        if not all(map(math.isfinite, self.offset)) or not all(math.isfinite(s) and s > 0 for s in self.scale):
            raise PlumblineError("offsets must be finite, scales finite and positive")

    def column(self, axis: int, name: str | None = None) -> Column:
        c = F.col(name or ("tx", "ty", "tz")[axis]).cast("double")
        return c * F.lit(self.scale[axis]) + F.lit(self.offset[axis])

    def columns(self) -> list[Column]:
        return [self.column(i).alias("xyz"[i]) for i in range(3)]

    def world(self, ticks: tuple[int, int, int]) -> tuple[float, ...]:
        return tuple(t * s + o for t, s, o in zip(ticks, self.scale, self.offset, strict=True))


@dataclass(frozen=True)
class Bounds:
    """A closed box of world coordinates."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]

    def __post_init__(self):
        if not all(math.isfinite(v) for v in (*self.low, *self.high)) or any(a > b for a, b in zip(self.low, self.high, strict=True)):
            raise PlumblineError("bounds must be finite with low <= high")

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        """All faces belong to the box."""
        out = F.lit(True)
        for c, a, b in zip((x, y, z), self.low, self.high, strict=True):
            out = out & (c >= a) & (c <= b)
        return out

    def tick_range(self, transform: Transform, axis: int) -> tuple[int, int]:
        """Ticks outside can't be inside the box; one tick of slack either way, since the exact test is on world values."""
        s, o = transform.scale[axis], transform.offset[axis]
        return math.floor((self.low[axis] - o) / s) - 1, math.ceil((self.high[axis] - o) / s) + 1


#: The EPSG codes of linear units.
LINEAR_UNITS = {9001: "metre", 9002: "foot", 9003: "us_survey_foot"}


@dataclass(frozen=True)
class SpatialReference:
    horizontal_epsg: int
    vertical_epsg: int
    axes: str = "easting,northing,elevation"
    horizontal_unit: str | None = "metre"
    vertical_unit: str | None = "metre"
    provenance: str = "callerDeclaration"

    def is_metric_survey(self) -> bool:
        return self.axes == "easting,northing,elevation" and self.horizontal_unit == self.vertical_unit == "metre"

    def canonical_bytes(self) -> bytes:
        units = {"metre": 1, "foot": 2, "us_survey_foot": 3}
        flags = [1 if self.axes == "easting,northing,elevation" else 0, units.get(self.horizontal_unit, 0), units.get(self.vertical_unit, 0), 1 if self.provenance == "sourceMetadata" else 2]
        return self.horizontal_epsg.to_bytes(4, "little") + self.vertical_epsg.to_bytes(4, "little") + bytes(flags) + bytes(4)
