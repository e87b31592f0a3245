"""Triangulated terrain surfaces: grids in pure SQL form, points in general position by an exact kernel."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import orientation_sign
from plumbline.model import PlumblineError, SpatialReference
from plumbline.runtime import materialize, ship

VERTEX, FACE = "vertex_id long, ordinal long, tx long, ty long, tz long", "face_id long, v1 long, v2 long, v3 long"


def require_metric(reference: SpatialReference | None) -> None:
    if reference is None or not reference.is_metric_survey():
        raise PlumblineError("terrain needs eastings, northings and elevations in metres")


def duplicate_positions(points: DataFrame) -> DataFrame:
    """(tx, ty, points, conflicting): plan positions held more than once, and whether their heights differ."""
    return points.groupBy("tx", "ty").agg(F.count("*").alias("points"), (F.min("tz") != F.max("tz")).alias("conflicting")).where("points > 1")


def vertices(points: DataFrame) -> DataFrame:
    """Numbered from 1 in the order (tx, ty, tz, ordinal)."""
    from plumbline.views import with_ordinals

    numbered = with_ordinals(points.select(F.col("ordinal").alias("id"), "tx", "ty", "tz"), ["tx", "ty", "tz", "id"])
    return numbered.select((F.col("ordinal") + 1).alias("vertex_id"), F.col("id").alias("ordinal"), "tx", "ty", "tz")


def grid_vertices(points: DataFrame, side: int) -> DataFrame:
    """On a full grid the order is closed-form: no sort."""
    return points.select((F.col("tx") * side + F.col("ty") + 1).alias("vertex_id"), "ordinal", "tx", "ty", "tz")


def grid_faces(spark: SparkSession, rows: int, side: int) -> DataFrame:
    """Faces of a full grid of rows of side points: every cell is cocircular and takes the diagonal of smaller ids; ids are closed-form."""
    cells = spark.range((rows - 1) * (side - 1)).select(F.col("id").alias("cell"), F.expr(f"id div {side - 1}").alias("i"), (F.col("id") % (side - 1)).alias("j"))
    a = (F.col("i") * side + F.col("j") + 1).alias("a")
    two = F.array(F.struct((F.col("cell") * 2 + 1).alias("face_id"), F.col("a").alias("v1"), (F.col("a") + side).alias("v2"), (F.col("a") + side + 1).alias("v3")), F.struct((F.col("cell") * 2 + 2).alias("face_id"), F.col("a").alias("v1"), (F.col("a") + side + 1).alias("v2"), (F.col("a") + 1).alias("v3")))
    return cells.select("cell", a).select(F.explode(two).alias("f")).select("f.*")


def hull_size(vertex_count: int, face_count: int) -> int:
    """Euler's relation for a triangulated disc."""
    return 2 * vertex_count - 2 - face_count


def _orient(p, q, r) -> int:
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def _in_circle(a, b, c, d) -> int:
    """Positive if d lies inside the circle through a, b, c (counter-clockwise). Exact on integers."""
    ax, ay, bx, by, cx, cy = a[0] - d[0], a[1] - d[1], b[0] - d[0], b[1] - d[1], c[0] - d[0], c[1] - d[1]
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    return ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx)


def triangulate(points: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The Delaunay triangulation of distinct integer points, sorted by (x, y), as canonical faces of 1-based ids."""
    return sorted((a + 1, b + 1, c + 1) for (a, b), c in _edges(points).items() if a < b and a < c)


def _edges(points: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Of the same triangulation, with ids from 0: each directed edge with the third corner of the face on its left.

    Points join the hull from left to right; edges flip while a circle holds the opposite point. Of a cocircular pair of
    diagonals the one with smaller ids stays. All signs are exact integers, so the result doesn't depend on rounding.
    """
    n = len(points)
    if n < 3:
        raise PlumblineError("a surface needs three points")
    k = next((i for i in range(2, n) if _orient(points[0], points[1], points[i])), None)
    if k is None:
        raise PlumblineError("all points lie on one line")
    opposite: dict[tuple[int, int], int] = {}

    def add(a: int, b: int, c: int) -> None:
        opposite[a, b], opposite[b, c], opposite[c, a] = c, a, b

    def drop(a: int, b: int, c: int) -> None:
        del opposite[a, b], opposite[b, c], opposite[c, a]

    def legalize(stack: list[tuple[int, int]]) -> None:
        while stack:
            a, b = stack.pop()
            c, d = opposite.get((a, b)), opposite.get((b, a))
            if c is None or d is None:
                continue
            circle = _in_circle(points[a], points[b], points[c], points[d])
            if circle < 0 or circle == 0 and (min(a, b), max(a, b)) < (min(c, d), max(c, d)):
                continue
            if _orient(points[c], points[d], points[b]) <= 0 or _orient(points[d], points[c], points[a]) <= 0:
                continue  # not a convex quadrilateral
            drop(a, b, c)
            drop(b, a, d)
            add(c, d, b)
            add(d, c, a)
            stack += [(a, d), (d, b), (b, c), (c, a)]

    # The first k points lie on one line; point k makes a fan over it.
    left = _orient(points[0], points[1], points[k]) > 0
    for i in range(k - 1):
        add(*((i, i + 1, k) if left else (i + 1, i, k)))
    hull = [*range(k), k] if left else [*range(k - 1, -1, -1), k]  # counter-clockwise
    after = {v: hull[(i + 1) % len(hull)] for i, v in enumerate(hull)}
    before = {w: v for v, w in after.items()}
    legalize([e for e in list(opposite)])
    last = k
    for p in range(k + 1, n):
        start = end = last  # the rightmost point of the hull sees the new one
        changed = []
        while _orient(points[end], points[after[end]], points[p]) < 0:
            nxt = after[end]
            add(nxt, end, p)
            changed += [(nxt, end), (end, p), (p, nxt)]
            end = nxt
        while _orient(points[before[start]], points[start], points[p]) < 0:
            prv = before[start]
            add(start, prv, p)
            changed += [(start, prv), (prv, p), (p, start)]
            start = prv
        if start == end:
            raise PlumblineError("a point is not visible from the hull; positions repeat")
        walk = after[start]
        while walk != end:
            walk, gone = after[walk], walk
            del after[gone], before[gone]
        after[start], before[p], after[p], before[end] = p, start, end, p
        legalize(changed)
        last = p
    return opposite


#: Inputs up to so many points are triangulated on the driver; beyond, a tile holds about TILE of them and a margin of so
#: many mean distances of points around it, or less if more than FULL times TILE would meet in it.
WHOLE, TILE, MARGIN, FULL = 4096, 2000, 4.0, 4
_CELL = "kind int, a long, b long, c long"  # 0: the corners of a face; 1: an open vertex and its ticks; 2: an edge with a settled face on its left


def _within(box: list, frame: list) -> list:
    """The box, with None for sides that have no points beyond them."""
    return [None if (v <= f if i < 2 else v >= f) else v for i, (v, f) in enumerate(zip(box, frame, strict=True))]


def _settled(plane: list[tuple[int, int]], own: list[bool], box: list, frame: list, num: int, den: int) -> tuple[list, list[int]]:
    """(faces, open): of the triangulation of all points in a box, the faces of its own vertices that no point beyond the box
    can change, and the own vertices with others besides. Boxes and frame: lowest x and y, highest x and y, in ticks."""
    try:
        opposite = _edges(plane)
    except PlumblineError:
        return [], [i for i, mine in enumerate(own) if mine]
    side = _within(box, frame)
    unit = (num, den, num, den)
    x0, y0, x1, y1 = (None if v is None else v * u for v, u in zip(side, unit, strict=True))
    corners = []  # of what lies between box and frame
    for i, v in enumerate(side):
        if v is not None:
            rest = list(frame)
            rest[(i + 2) % 4] = v - 1 if i < 2 else v + 1
            corners += [(rest[j] * num, rest[k] * den) for j in (0, 2) for k in (1, 3)]
    faces, bad = [], set()
    for (a, b), c in opposite.items():
        if (b, a) not in opposite and (own[a] or own[b]) and any(_orient(plane[a], plane[b], q) < 0 for q in corners):
            bad |= {a, b}
        if a > b or a > c or not (own[a] or own[b] or own[c]):
            continue
        ax, ay = plane[a]
        bx, by, cx, cy = plane[b][0] - ax, plane[b][1] - ay, plane[c][0] - ax, plane[c][1] - ay
        d, b2, c2 = 2 * (bx * cy - by * cx), bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d  # quotients of integers, rounded once
        r = math.hypot(ux, uy) * (1 + 1e-9)
        if (x0 is None or ux - r >= x0 - ax) and (y0 is None or uy - r >= y0 - ay) and (x1 is None or ux + r <= x1 - ax) and (y1 is None or uy + r <= y1 - ay):
            faces.append((a, b, c))
        else:
            bad |= {a, b, c}
    return faces, [i for i in sorted(bad) if own[i]]


def _between(plane: list[tuple[int, int]], settled: set[tuple[int, int]], alone: bool) -> list[tuple[int, int, int]]:
    """The faces that have open vertices only, from the triangulation of these. It also covers what settled vertices' faces
    cover: such faces lie on the side of an edge where a settled face is, or are reached from there across other edges."""
    if not alone and (not settled or len(plane) < 3):
        return []
    try:
        opposite = _edges(plane)
    except PlumblineError:
        if alone:
            raise
        return []
    canonical = lambda a, b, c: (a, b, c) if a < b and a < c else (b, c, a) if b < c else (c, a, b)
    covered, todo = set(), [e for e in settled if e in opposite]
    while todo:
        a, b = todo.pop()
        c = opposite[a, b]
        face = canonical(a, b, c)
        if face in covered:
            continue
        covered.add(face)
        todo += [(q, p) for p, q in ((a, b), (b, c), (c, a)) if (p, q) not in settled and (q, p) not in settled and (q, p) in opposite]
    return [(a, b, c) for (a, b), c in opposite.items() if a < b and a < c and (a, b, c) not in covered]


def _tiles(verts: DataFrame, n: int, frame: list, ratio: Fraction) -> tuple[list, list]:
    """(territories, boxes) of tiles with like numbers of points. The territories cover the plane once. They come from
    approximate quantiles: only the tiles' sizes hang on these."""
    import numpy as np

    wide, high = (frame[2] - frame[0] + 1) * ratio.numerator, (frame[3] - frame[1] + 1) * ratio.denominator
    tiles = -(-n // TILE)
    strips = max(1, min(tiles, round(math.sqrt(tiles * (wide / high)))))
    rows = max(1, round(tiles / strips))
    at = lambda c, k: F.percentile_approx(c, F.array(*[F.lit(i / k) for i in range(1, k)]), F.lit(10_000)) if k > 1 else F.array().cast("array<long>")
    edges = lambda found: sorted(set(found))
    xs = edges(verts.agg(at("tx", strips)).first()[0])

    def strip(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([pa.array(np.searchsorted(xs, batch.column(0).to_numpy(), side="right"), pa.int64()), batch.column(1)], ["strip", "ty"])

    found = {r[0]: edges(r[1]) for r in verts.select("tx", "ty").mapInArrow(strip, "strip long, ty long").groupBy("strip").agg(at("ty", rows)).collect()}
    low, top = -(1 << 63), (1 << 63) - 1
    own, boxes = [], []
    cuts = lambda c: list(zip([low, *c], [*(v - 1 for v in c), top], strict=True))
    for i, (x0, x1) in enumerate(cuts(xs)):
        for y0, y1 in cuts(found.get(i, [])):
            own.append([x0, y0, x1, y1])
            boxes.append([max(x0, frame[0]), max(y0, frame[1]), min(x1, frame[2]), min(y1, frame[3])])
    return own, boxes


def _widened(box: list, share: float, ratio: Fraction) -> list:
    num, den = ratio.numerator, ratio.denominator
    apart = math.sqrt((box[2] - box[0] + 1) * num * (box[3] - box[1] + 1) * den / TILE)
    mx, my = math.ceil(MARGIN * share * (apart / num)), math.ceil(MARGIN * share * (apart / den))
    low, top = -(1 << 63), (1 << 63) - 1
    return [max(low, box[0] - mx), max(low, box[1] - my), min(top, box[2] + mx), min(top, box[3] + my)]


def _tiled(verts: DataFrame, n: int, frame: list, ratio: Fraction, max_vertices: int) -> DataFrame:
    """(v1, v2, v3), once each, of any number of vertices.

    A tile triangulates all points of its widened box. A face whose circle stays inside holds for the whole table; a vertex
    with such faces only is settled. If the settled ones were taken out, faces of other vertices alone would stay as they
    are, so these come from a triangulation of the open vertices. Cocircular points are fanned from their least id
    everywhere, which is a triangulation under a fixed perturbation, so tiles agree.
    """
    import numpy as np

    ship(verts.sparkSession)
    num, den = ratio.numerator, ratio.denominator
    own, boxes = _tiles(verts, n, frame, ratio)
    share = [1.0] * len(own)
    rows = verts.select("vertex_id", "tx", "ty")

    def deal(reach: list, count: bool):
        lows, highs = np.array([b[:2] for b in reach], np.int64), np.array([b[2:] for b in reach], np.int64)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                i, x, y = (batch.column(k).to_numpy() for k in range(3))
                if not len(i):
                    continue
                near = np.nonzero((lows[:, 0] <= x.max()) & (highs[:, 0] >= x.min()) & (lows[:, 1] <= y.max()) & (highs[:, 1] >= y.min()))[0]
                for t in near.tolist():
                    b, o = reach[t], own[t]
                    at = np.nonzero((x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3]))[0]
                    if not len(at):
                        continue
                    if count:
                        yield pa.record_batch([pa.array([t], pa.int32()), pa.array([len(at)], pa.int64())], ["tile", "n"])
                        continue
                    u, v = x[at], y[at]
                    mine = (u >= o[0]) & (u <= o[2]) & (v >= o[1]) & (v <= o[3])
                    yield pa.record_batch([pa.array(np.full(len(at), t, np.int32)), pa.array(i[at]), pa.array(u), pa.array(v), pa.array(mine)], ["tile", "id", "x", "y", "own"])

        return run

    for _ in range(8):
        reach = [_widened(b, s, ratio) if s else b for b, s in zip(boxes, share, strict=True)]
        held = rows.mapInArrow(deal(reach, True), "tile int, n long").groupBy("tile").agg(F.sum("n").alias("n")).where(F.col("n") > FULL * TILE).collect()
        full = [r.tile for r in held if share[r.tile]]
        if not full:
            break
        for t in full:
            share[t] = share[t] / 4 if share[t] > 0.01 else 0.0

    def cell(key, table):
        import pyarrow as pa

        table = table.sort_by("id")
        i, x, y, mine = (table.column(c).to_pylist() for c in ("id", "x", "y", "own"))
        faces, left = _settled([(u * num, v * den) for u, v in zip(x, y, strict=True)], mine, reach[key[0].as_py()], frame, num, den)
        out = [[0] * len(faces) + [1] * len(left), *([i[f[k]] for f in faces] + [w[j] for j in left] for k, w in enumerate((i, x, y)))]
        return pa.table([pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:])], ["kind", "a", "b", "c"])

    dealt = rows.mapInArrow(deal(reach, False), "tile int, id long, x long, y long, own boolean").repartition(min(len(own), 50 + len(own) // 4), "tile")
    cells = materialize(dealt.groupBy("tile").applyInArrow(cell, _CELL), "tiles")
    faces, left = cells.where("kind = 0").select(F.col("a").alias("v1"), F.col("b").alias("v2"), F.col("c").alias("v3")).distinct(), cells.where("kind = 1")
    open_ = left.count()
    if not open_:
        return faces
    if open_ > max_vertices:
        raise PlumblineError(f"more than {max_vertices} vertices are left open by their tiles")
    alone = open_ == n
    corner = faces.select("v1", "v2", "v3", F.explode(F.array("v1", "v2", "v3")).alias("id")).join(left.select(F.col("a").alias("id")).hint("merge"), "id")
    two = corner.groupBy("v1", "v2", "v3").agg(F.collect_set("id").alias("k")).where("size(k) = 2")
    has = lambda c: F.array_contains("k", F.col(c))
    edge = F.when(~has("v3"), F.struct(F.col("v1").alias("a"), F.col("v2").alias("b"))).when(~has("v1"), F.struct(F.col("v2").alias("a"), F.col("v3").alias("b"))).otherwise(F.struct(F.col("v3").alias("a"), F.col("v1").alias("b")))
    edges = two.select(edge.alias("e")).select(F.lit(2).alias("kind"), "e.a", "e.b", F.lit(0).cast("long").alias("c"))

    def rest(table):
        import pyarrow as pa

        table = table.sort_by([("kind", "ascending"), ("a", "ascending")])
        kind, a, b, c = (table.column(k).to_pylist() for k in ("kind", "a", "b", "c"))
        m = kind.index(2) if 2 in kind else len(kind)
        at = {v: k for k, v in enumerate(a[:m])}
        found = _between([(u * num, v * den) for u, v in zip(b[:m], c[:m], strict=True)], {(at[p], at[q]) for p, q in zip(a[m:], b[m:], strict=True)}, alone)
        return pa.table([pa.array([a[f[k]] for f in found], pa.int64()) for k in range(3)], ["v1", "v2", "v3"])

    more = left.unionByName(edges).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(rest, "v1 long, v2 long, v3 long")
    return faces.unionByName(more).distinct()


def derive(points: DataFrame, scale_xy: tuple[float, float] = (1.0, 1.0), max_vertices: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of points in general position. Any number of them, by tiles; what tiles can't decide from the points
    around them (at most max_vertices, else it fails) meets in one task. Few points are triangulated on the driver."""
    from plumbline.views import with_ordinals

    spark = points.sparkSession
    ratio = Fraction(scale_xy[0]) / Fraction(scale_xy[1])
    points = points.select("tx", "ty", "tz", "ordinal")
    rows = points.limit(WHOLE + 1).collect()
    if len(rows) > WHOLE:
        v = vertices(points)
        if duplicate_positions(v).limit(1).count():
            raise PlumblineError("two points share a plan position")
        n, *frame = v.agg(F.count("*"), F.min("tx"), F.min("ty"), F.max("tx"), F.max("ty")).first()
        try:
            f = with_ordinals(_tiled(v, n, frame, ratio, max_vertices), ["v1", "v2", "v3"])
        except PythonException as e:
            if "all points lie on one line" in str(e):
                raise PlumblineError("all points lie on one line") from e
            raise
        return v, f.select((F.col("ordinal") + 1).alias("face_id"), "v1", "v2", "v3")
    rows = sorted(tuple(r) for r in rows)
    if len({r[:2] for r in rows}) < len(rows):
        raise PlumblineError("two points share a plan position")
    faces = triangulate([(r[0] * ratio.numerator, r[1] * ratio.denominator) for r in rows])
    v = spark.createDataFrame([(i + 1, r[3], r[0], r[1], r[2]) for i, r in enumerate(rows)], VERTEX)
    return v, spark.createDataFrame([(i + 1, *f) for i, f in enumerate(faces)], FACE)


def with_corners(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """Faces with the ticks of their corners: x1 .. z3."""
    out = faces
    for i in (1, 2, 3):
        out = out.join(verts.select(F.col("vertex_id").alias(f"v{i}"), F.col("tx").alias(f"x{i}"), F.col("ty").alias(f"y{i}"), F.col("tz").alias(f"z{i}")), f"v{i}")
    return out


def _forbidden(inner: DataFrame, ratio: Fraction) -> DataFrame:
    """Of inner edges (p, q) with the corners o and d across, in ticks: those whose circle through p, q, o holds d.

    Doubles decide wherever their error bound allows; only what they leave open goes to Python's exact integers.
    """
    ship(inner.sparkSession)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    ((ax, ay), (bx, by), (cx, cy)) = (((wide(f"{a}x") - wide("dx")).cast("double") * float(ratio), (wide(f"{a}y") - wide("dy")).cast("double")) for a in ("p", "q", "o"))
    lift = [x * x + y * y for x, y in ((ax, ay), (bx, by), (cx, cy))]
    crosses = [(bx * cy, cx * by), (cx * ay, ax * cy), (ax * by, bx * ay)]
    det, size = F.lit(0.0), F.lit(0.0)
    for l2, (u, v) in zip(lift, crosses, strict=True):
        det, size = det + l2 * (u - v), size + l2 * (F.abs(u) + F.abs(v))
    open_ = inner.withColumns({"det": det, "slack": size * 1e-13})
    names = [f"{a}{b}" for a in "pqod" for b in "xy"]
    num, den = ratio.numerator, ratio.denominator

    def exact(batches):
        import pyarrow as pa

        for batch in batches:
            held = [[v * (num if i % 2 == 0 else den) for v in batch.column(i).to_pylist()] for i in range(8)]
            inside = [_in_circle(*((held[2 * k][r], held[2 * k + 1][r]) for k in range(4))) > 0 for r in range(batch.num_rows)]
            yield batch.filter(pa.array(inside, pa.bool_()))

    sure = open_.where("det > slack").select(names)
    return sure.unionByName(open_.where("abs(det) <= slack or isnan(det)").select(names).mapInArrow(exact, ", ".join(f"{n} long" for n in names)))


def surface_violations(verts: DataFrame, faces: DataFrame, scale_xy: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(rule, n): faces not counter-clockwise or not canonical, edges of more than two faces, unused vertices, and inner
    edges that a circle forbids, in the plane of the scaled positions. A sound surface has n = 0 throughout."""
    c = with_corners(faces, verts)
    turned = c.where(orientation_sign(*[F.col(x) for x in ("x1", "y1", "x2", "y2", "x3", "y3")]) <= 0)
    uneven = faces.where("v1 > v2 or v1 > v3 or v2 = v3")
    edges = c.select("face_id", F.explode(F.array(*[F.struct(F.col(f"v{a}").alias("p"), F.col(f"v{b}").alias("q"), F.col(f"x{a}").alias("px"), F.col(f"y{a}").alias("py"), F.col(f"x{b}").alias("qx"), F.col(f"y{b}").alias("qy"), F.col(f"x{o}").alias("ox"), F.col(f"y{o}").alias("oy")) for a, b, o in ((1, 2, 3), (2, 3, 1), (3, 1, 2))])).alias("e")).select("face_id", "e.*")
    shared = edges.groupBy("p", "q").count().where("count > 1")
    unused = verts.join(faces.select(F.explode(F.array("v1", "v2", "v3")).alias("vertex_id")), "vertex_id", "left_anti")
    mate = edges.select(F.col("q").alias("p"), F.col("p").alias("q"), F.col("ox").alias("dx"), F.col("oy").alias("dy"))
    inner = edges.join(mate, ["p", "q"])
    circle = _forbidden(inner, Fraction(scale_xy[0]) / Fraction(scale_xy[1]))
    parts = [("orientation", turned), ("canonical", uneven), ("edge", shared), ("unused", unused), ("circle", circle)]
    out = None
    for rule, df in parts:
        one = df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def face_keys(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """Faces by the sorted ordinals of their corners: comparable across surfaces."""
    out = faces
    for i in (1, 2, 3):
        out = out.join(verts.select(F.col("vertex_id").alias(f"v{i}"), F.col("ordinal").alias(f"o{i}")), f"v{i}")
    return out.select(F.array_sort(F.array("o1", "o2", "o3")).alias("key")).select(*[F.col("key")[i].alias(f"k{i + 1}") for i in range(3)])


def compare_surfaces(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(change, k1, k2, k3) of the faces that one surface has and the other has not."""
    a, b = face_keys(before[1], before[0]), face_keys(after[1], after[0])
    both = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy("k1", "k2", "k3").agg(F.sum(F.when(F.col("s") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("s") == 2, 1).otherwise(0)).alias("n2"))
    return both.where("(n1 > 0) <> (n2 > 0)").select(F.when(F.col("n1") > 0, "removed").otherwise("added").alias("change"), "k1", "k2", "k3")


def change_bounds(changed: DataFrame, points: DataFrame) -> DataFrame:
    """Extremes, in ticks, of the vertices of changed faces."""
    hit = changed.select(F.explode(F.array("k1", "k2", "k3")).alias("ordinal")).distinct().join(points, "ordinal")
    return hit.agg(F.count("*").alias("vertices"), *[f(f"t{a}").alias(f"{n}_t{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
