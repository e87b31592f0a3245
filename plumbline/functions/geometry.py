"""Scalar functions as Spark columns: everything here stays in generated code."""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import PlumblineError

#: The sample order's domain and the multipliers of its 64-bit mixing.
ORDINAL_DOMAIN = 0x706E637472610401
STEP, MUL_1, MUL_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _wrap_mul(x: Column, constant: int) -> Column:
    """x * constant mod 2^64 on 16-bit limbs, so that no intermediate overflows."""
    a = [F.shiftrightunsigned(x, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    b = [constant >> 16 * i & 0xFFFF for i in range(4)]
    out, carry = [], F.lit(0).cast("long")
    for k in range(4):
        total = carry
        for i in range(k + 1):
            total = total + a[i] * b[k - i]
        out.append(total.bitwiseAND(0xFFFF))
        carry = F.shiftright(total, 16)
    return out[0].bitwiseOR(F.shiftleft(out[1], 16)).bitwiseOR(F.shiftleft(out[2], 32)).bitwiseOR(F.shiftleft(out[3], 48))


def _wrap_add(x: Column, constant: int) -> Column:
    low = x.bitwiseAND(0xFFFFFFFF) + (constant & 0xFFFFFFFF)
    high = F.shiftrightunsigned(x, 32) + (constant >> 32) + F.shiftright(low, 32)
    return low.bitwiseAND(0xFFFFFFFF).bitwiseOR(F.shiftleft(high.bitwiseAND(0xFFFFFFFF), 32))


def with_priority(df: DataFrame, ordinal: str = "ordinal", out: str = "priority") -> DataFrame:
    """Adds the pseudo-random sample priority of an ordinal, as the signed form of an unsigned 64-bit value.

    In steps of one column each, so that no step repeats the text of the one before.
    """
    v = F.col(out)
    mixed = lambda n: v.bitwiseXOR(F.shiftrightunsigned(v, n))
    df = df.withColumn(out, F.col(ordinal).cast("long").bitwiseXOR(F.lit(_signed(ORDINAL_DOMAIN)))).withColumn(out, _wrap_add(v, STEP))
    for shift, constant in ((30, MUL_1), (27, MUL_2)):
        df = df.withColumn(out, mixed(shift)).withColumn(out, _wrap_mul(v, constant))
    return df.withColumn(out, mixed(31))


def unsigned_order(v: Column) -> Column:
    """Sorts signed forms as the unsigned values that they stand for."""
    return v.bitwiseXOR(F.lit(-(1 << 63)))


def unsigned_value(v: Column) -> Column:
    d = v.cast("decimal(20,0)")
    return F.when(v < 0, d + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a, b, c in doubles; for integer ticks of any size see orientation_sign."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def orientation_sign(ax, ay, bx, by, cx, cy, wide: bool = False) -> Column:
    """-1, 0 or 1 by the side of a, b on which c lies: exact for all 64-bit ticks; if wide, for all of up to 37 digits.

    Both products are taken apart into limbs, whose sums fit decimals; carries go up, and the highest limb decides.
    """
    base, n, digits = (10**13, 3, 38) if wide else (1 << 32, 2, 20)
    limb = F.lit(base).cast("decimal(38,0)")
    tick = lambda v: v.cast(f"decimal({digits},0)")
    rest = lambda v: F.pmod(v.cast("decimal(38,0)"), limb)
    up = lambda v: ((v.cast("decimal(38,0)") - rest(v)) / limb).cast("decimal(38,0)")

    def limbs(v: Column) -> list[Column]:
        low = []
        for _ in range(n - 1):
            low.append(rest(v).cast("decimal(14,0)"))
            v = up(v)
        return [*low, v.cast("decimal(16,0)")]

    p, q, r, s = map(limbs, (tick(bx) - tick(ax), tick(cy) - tick(ay), tick(by) - tick(ay), tick(cx) - tick(ax)))
    left, below = None, []
    for k in range(2 * n - 1):
        sums = [p[i] * q[k - i] - r[i] * s[k - i] for i in range(n) if 0 <= k - i < n]
        column = reduce(operator.add, sums if left is None else [*sums, up(left)]).cast("decimal(38,0)")
        left = column
        below.append(rest(column) > 0)
    return F.when(left > 0, 1).when(left < 0, -1).when(reduce(operator.or_, below[:-1]), 1).otherwise(0)


def tolerance_class(residual: Column, below: float, above: float) -> Column:
    """Both limits are within."""
    return F.when(residual < -below, "below").when(residual > above, "above").when(residual.isNotNull(), "within")


def canonical_zero(c: Column) -> Column:
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


# Display mappings.

#: Colours of classes 0 to 18; the multipliers and shifts for other classes; the neutral colour.
CLASS_COLOURS = [
    (120, 120, 120), (155, 155, 155), (139, 95, 57), (80, 180, 80), (45, 150, 45), (20, 110, 20), (220, 70, 70), (200, 200, 200), (170, 120, 220), (80, 150, 230),
    (60, 100, 210), (40, 180, 210), (230, 170, 60), (220, 120, 40), (235, 80, 150), (170, 70, 170), (255, 220, 80), (100, 220, 190), (245, 245, 245),
]
OTHER_CLASS = ((73, 41), (151, 97), (199, 17))
NEUTRAL = (190, 205, 220)


def grey(v: Column) -> Column:
    """An intensity as an opaque colour of three equal parts."""
    c = scale_u16(v)
    return F.array(c, c, c, F.lit(255).cast("long"))


def scale_u16(v: Column) -> Column:
    return F.floor((v * 255 + 32767) / 65535).cast("long")


def class_colour(c: Column) -> list[Column]:
    out = []
    for axis, (times, plus) in enumerate(OTHER_CLASS):
        table = F.array(*[F.lit(rgb[axis]).cast("long") for rgb in CLASS_COLOURS])
        out.append(F.coalesce(F.get(table, c.cast("int")), F.pmod(c * times + plus, F.lit(256))))
    return out


def normalised_elevation(z: Column, low: float, high: float) -> Column:
    if low >= high:
        return F.lit(0.5)
    middle = low / 2 + high / 2
    return F.when(z <= low, 0.0).when(z >= high, 1.0).when(z <= middle, 0.5 * ((z - low) / (middle - low))).otherwise(0.5 + 0.5 * ((z - middle) / (high - middle)))


def ramp_colour(position: Column, stops: list[tuple[int, int, int]]) -> list[Column]:
    """Piecewise linear between the stops, halves rounded away from zero; position is from 0 to 1."""
    at = position * float(len(stops) - 1)
    low = F.least(F.floor(at), F.lit(len(stops) - 2)).cast("int")
    part = at - low
    out = []
    for axis in range(3):
        table = F.array(*[F.lit(float(s[axis])) for s in stops])
        a, b = F.get(table, low), F.get(table, low + 1)
        out.append(F.round(a + (b - a) * part).cast("long"))
    return out


def display_colour(mapping: str, attributes: dict[str, Column], low: float = 0.0, high: float = 1.0, stops: list[tuple[int, int, int]] = ()) -> Column:
    """The opaque colour (red, green, blue, alpha) of a point under a mapping: neutral, elevation, rgb, intensity or class.
    A mapping whose attributes aren't there is an error."""
    need = {"neutral": [], "elevation": ["z"], "rgb": ["red", "green", "blue"], "intensity": ["intensity"], "class": ["classification"]}
    if mapping not in need:
        raise PlumblineError(f"no such mapping: {mapping}")
    if missing := [a for a in need[mapping] if a not in attributes]:
        raise PlumblineError(f"the mapping needs {missing}")
    opaque = F.lit(255).cast("long")
    if mapping == "intensity":
        return grey(attributes["intensity"])
    if mapping == "neutral":
        parts = [F.lit(v).cast("long") for v in NEUTRAL]
    elif mapping == "rgb":
        parts = [scale_u16(attributes[c]) for c in ("red", "green", "blue")]
    elif mapping == "class":
        parts = class_colour(attributes["classification"])
    else:
        parts = ramp_colour(normalised_elevation(attributes["z"], low, high), list(stops))
    return F.array(*parts, opaque)


def circumcentre(ax, ay, bx, by, cx, cy) -> tuple[Column, Column]:
    """The centre of the circle through three points; nulls where they lie on one line."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - ax, cy - ay
    d = 2.0 * (ux * vy - uy * vx)
    u2, v2 = ux * ux + uy * uy, vx * vx + vy * vy
    return F.when(d != 0, ax + (vy * u2 - uy * v2) / d), F.when(d != 0, ay + (ux * v2 - vx * u2) / d)


def density_point_size(pixels: float, points: Column) -> Column:
    return F.least(F.greatest(0.55 * F.sqrt(F.lit(float(pixels)) / points), F.lit(1.0)), F.lit(4.0))


def fade_weight(step: Column) -> Column:
    return F.round(255.0 * step / 8).cast("long")


# Cameras.

Vec = tuple[float, float, float]


def _sub(a: Vec, b: Vec) -> Vec:
    return (a[0] - b[0], a[1] - b[1], a[2] - b[2])


def _dot(a: Vec, b: Vec) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _unit(a: Vec) -> Vec:
    n = math.sqrt(_dot(a, a))
    if not math.isfinite(n) or n <= 0:
        raise PlumblineError("a camera needs three directions that differ")
    return (a[0] / n, a[1] / n, a[2] / n)


@dataclass(frozen=True)
class Camera:
    """Perspective with fov_radians, else orthographic with world_height."""

    eye: Vec
    target: Vec
    up: Vec = (0.0, 0.0, 1.0)
    near: float = 0.1
    far: float = 1e6
    fov_radians: float | None = None
    world_height: float | None = None

    def __post_init__(self):
        if (self.fov_radians is None) == (self.world_height is None) or not 0 < self.near < self.far < math.inf:
            raise PlumblineError("give either a field of view or a world height, and 0 < near < far")
        self.basis()

    def basis(self) -> tuple[Vec, Vec, Vec]:
        """Forward, right, up."""
        forward = _unit(_sub(self.target, self.eye))
        right = _unit(_cross(forward, self.up))
        return forward, right, _cross(right, forward)

    def projected(self, x: Column, y: Column, z: Column, width: int, height: int) -> dict[str, Column]:
        """depth, px and py (pixels from the top left) and inside (the frustum, edges included)."""
        rel = [c - e for c, e in zip((x, y, z), self.eye, strict=True)]
        forward, right, up = self.basis()
        along = lambda v: rel[0] * v[0] + rel[1] * v[1] + rel[2] * v[2]
        depth, h, v = along(forward), along(right), along(up)
        inside = (depth >= self.near) & (depth <= self.far)
        if self.fov_radians is not None:
            vs = depth * math.tan(self.fov_radians * 0.5)
            hs = vs * (width / height)
            inside = inside & (depth > 0)
        else:
            vs, hs = F.lit(self.world_height * 0.5), F.lit(self.world_height * 0.5 * (width / height))
        nx, ny = F.when(hs > 0, h / hs), F.when(vs > 0, v / vs)
        inside = inside & nx.between(-1.0, 1.0) & ny.between(-1.0, 1.0)
        return {"depth": depth, "px": (nx + 1.0) * width / 2.0, "py": (F.lit(1.0) - ny) * height / 2.0, "inside": F.coalesce(inside, F.lit(False))}

    def planes(self, width: int, height: int) -> list[tuple[Vec, float]]:
        """The six inward normals (of length 1) with their offsets relative to the eye."""
        f, r, u = self.basis()
        mix = lambda a, k, b, s: tuple(a[i] * k + s * b[i] for i in range(3))
        neg = lambda a: tuple(-v for v in a)
        aspect = width / height
        if self.fov_radians is not None:
            tv = math.tan(self.fov_radians * 0.5)
            raw = [(f, -self.near), (neg(f), self.far), (mix(f, tv * aspect, r, 1), 0.0), (mix(f, tv * aspect, r, -1), 0.0), (mix(f, tv, u, 1), 0.0), (mix(f, tv, u, -1), 0.0)]
        else:
            hv = self.world_height / 2
            raw = [(f, -self.near), (neg(f), self.far), (r, hv * aspect), (neg(r), hv * aspect), (u, hv), (neg(u), hv)]
        return [(tuple(c / (n := math.sqrt(_dot(v, v))) for c in v), d / n) for v, d in raw]

    def matrix(self, aspect: float) -> list[float]:
        """The view-projection matrix by columns, in single precision: x and y from -1 to 1, depth from 0 to 1."""
        import numpy as np

        f, r, u = (np.array(v) for v in self.basis())
        eye = np.array(self.eye)
        view = np.eye(4)
        view[:3, :3] = [r, u, -f]
        view[:3, 3] = [-r @ eye, -u @ eye, f @ eye]
        out = np.zeros((4, 4))
        reach = self.near - self.far
        if self.fov_radians is not None:
            k = 1.0 / math.tan(self.fov_radians * 0.5)
            out[0, 0], out[1, 1], out[2, 2], out[2, 3], out[3, 2] = k / aspect, k, self.far / reach, self.near * self.far / reach, -1.0
        else:
            h = self.world_height
            out[0, 0], out[1, 1], out[2, 2], out[2, 3], out[3, 3] = 2.0 / (h * aspect), 2.0 / h, 1.0 / reach, self.near / reach, 1.0
        return (out @ view).T.astype(np.float32).ravel().tolist()

    def sees(self, box: dict[str, Column], width: int, height: int) -> Column:
        """Whether a box (min_x .. max_z) is outside no plane, with slack for rounding."""
        out = F.lit(True)
        for normal, offset in self.planes(width, height):
            support = [box[f"max_{a}"] if c >= 0 else box[f"min_{a}"] for c, a in zip(normal, "xyz", strict=True)]
            value = F.lit(offset)
            size = F.lit(abs(offset))
            for c, s, e in zip(normal, support, self.eye, strict=True):
                value = value + c * (s - e)
                size = size + abs(c) * (F.abs(s) + abs(e))
            out = out & ~(value < -(size * 1e-15 * 8))
        return out

    def screen_error(self, box: dict[str, Column], error: Column, height: int) -> Column:
        if self.world_height is not None:
            return error * float(height) / self.world_height
        forward = self.basis()[0]
        depth, radius = F.lit(0.0), F.lit(0.0)
        for c, a, e in zip(forward, "xyz", self.eye, strict=True):
            depth = depth + c * ((box[f"min_{a}"] + box[f"max_{a}"]) / 2 - e)
            radius = radius + abs(c) * ((box[f"max_{a}"] - box[f"min_{a}"]) / 2)
        scale = height / (2 * math.tan(self.fov_radians * 0.5))
        return error * scale / F.greatest(depth - radius, F.lit(self.near))


def refines(error: Column, was_refined: Column, max_error: float, hysteresis: float) -> Column:
    return F.when(was_refined, error >= max_error - hysteresis).otherwise(error > max_error + hysteresis)
