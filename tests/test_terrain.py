"""Triangulation, location and statistics against brute force and closed forms."""

import random

import pytest

from plumbline.model import PlumblineError, SpatialReference, Transform
from plumbline.operators import qa, terrain
from plumbline.operators.terrain import _in_circle, _orient, hull_size, triangulate


def test_cocircular_square_takes_the_smaller_diagonal():
    assert triangulate([(0, 0), (0, 10), (10, 0), (10, 10)]) == [(1, 3, 4), (1, 4, 2)]


@pytest.mark.parametrize("seed", range(20))
def test_delaunay_properties(seed):
    rnd = random.Random(seed)
    pts = sorted({(rnd.randint(0, 14), rnd.randint(0, 14)) for _ in range(rnd.randint(5, 60))})
    faces = triangulate(pts)
    for a, b, c in faces:
        p, q, r = pts[a - 1], pts[b - 1], pts[c - 1]
        assert _orient(p, q, r) > 0 and a < b and a < c
        assert all(_in_circle(p, q, r, x) <= 0 for x in pts)
    assert {v for f in faces for v in f} == set(range(1, len(pts) + 1))


def test_no_surface():
    for pts in ([(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 2), (5, 5)]):
        with pytest.raises(PlumblineError):
            triangulate(pts)


def test_closed_forms(spark):
    side = 9
    rows = [(i * side + j, i, j, i + 2 * j) for i in range(side) for j in range(side)]
    points = spark.createDataFrame(rows, "ordinal long, tx long, ty long, tz long")
    v, f = terrain.derive(points)
    assert f.count() == 2 * (side - 1) ** 2 and hull_size(v.count(), f.count()) == 4 * (side - 1)
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, terrain.grid_faces(spark, side, side).select(f.columns).collect()))
    assert all(r.n == 0 for r in terrain.surface_violations(v, f).collect())
    few = points.where("ordinal <> 40")
    change = terrain.compare_surfaces((v, f), terrain.derive(few)).groupBy("change").count().collect()
    assert {r["change"]: r["count"] for r in change} == {"added": 4, "removed": 6}


def test_plane_residuals(spark):
    points = spark.createDataFrame([(0, 0, 0, 0), (1, 10, 0, 10), (2, 10, 10, 20), (3, 0, 10, 10)], "ordinal long, tx long, ty long, tz long")
    v, f = terrain.derive(points)
    faces = qa.world_faces(f, v, Transform())
    checks = spark.createDataFrame([(1, 5.0, 5.0, 11.0), (2, 5.0, 5.0, 9.5), (3, 20.0, 20.0, 0.0), (4, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    qa.require_unique(checks)
    r = qa.residuals(qa.locate(checks, faces, 4.0, ["id"]), 0.5, 0.5)
    got = {x.id: (x.face_id, x.residual, x.tolerance) for x in r.collect()}
    assert got == {1: (1, 1.0, "above"), 2: (1, -0.5, "within"), 3: (None, None, None), 4: (1, 0.0, "within")}
    s = qa.statistics(r).first()
    assert (s.covered, s.gaps, s.min, s.max) == (3, 1, -0.5, 1.0)
    assert qa.statistics(r.where("id = 3")).first().mean is None
    stations = qa.locate(qa.profile_stations(spark, (0.0, 0.0), (10.0, 10.0), 2), faces, 4.0, ["idx"]).orderBy("idx").collect()
    assert [x.surface_z for x in stations] == [0.0, 10.0, 20.0]


def test_points_next_to_edges_are_decided_exactly(spark):
    from fractions import Fraction

    rnd = random.Random(9)
    faces, checks, want = [], [], {}
    for i in range(200):
        x0 = 1000.0 * i
        corners = [(x0 + rnd.random(), rnd.random()), (x0 + 3 + rnd.random(), rnd.random() / 3), (x0 + rnd.random(), 3 + rnd.random())]
        t = rnd.random()
        x, y = (a + (b - a) * t for a, b in zip(corners[0], corners[1]))  # on an edge, but for rounding
        faces.append((i + 1, *[v for c in corners for v in (*c, 1.0)]))
        checks.append((i + 1, x, y, 2.0))
        exact = [tuple(map(Fraction, c)) for c in corners]
        want[i + 1] = _orient(exact[0], exact[1], (Fraction(x), Fraction(y))) >= 0
    f = spark.createDataFrame(faces, "face_id long, " + ", ".join(f"{a}{i} double" for i in (1, 2, 3) for a in "xyz"))
    q = spark.createDataFrame([*checks, (999, None, 1.0, 1.0)], "id long, x double, y double, z double")
    got = {r.id: r.face_id is not None for r in qa.locate(q, f, 4.0, ["id"]).collect()}
    assert got == want | {999: False} and 20 < sum(want.values()) < 180


def test_huge_residuals_do_not_overflow(spark):
    r = spark.createDataFrame([(1e200,), (-1e200,), (1e200,), (1e200,)], "residual double")
    s = qa.statistics(r).first()
    assert s.rms == pytest.approx(1e200) and s["mean"] == pytest.approx(5e199)


def test_metric_gate():
    terrain.require_metric(SpatialReference(32647, 5703))
    for bad in (None, SpatialReference(32647, 5703, horizontal_unit="foot")):
        with pytest.raises(PlumblineError):
            terrain.require_metric(bad)
