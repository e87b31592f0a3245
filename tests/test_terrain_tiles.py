"""Triangulation by tiles against the triangulation of all points at once."""

import random

import pytest

from plumbline.model import PlumblineError
from plumbline.operators import terrain


def shapes():
    rnd = random.Random(11)
    yield "grid", (1, 1), {(i, j) for i in range(30) for j in range(20)}
    yield "holes", (1, 1), {(i, j) for i in range(30) for j in range(30) if rnd.random() < 0.6 and not (8 < i < 20 and 5 < j < 22)}
    yield "random", (1, 1), {(rnd.randint(0, 10**9), rnd.randint(0, 10**9)) for _ in range(600)}
    yield "scaled", (0.1, 0.25), {(rnd.randint(-(10**17), 10**17), rnd.randint(0, 10**17)) for _ in range(500)}
    yield "clusters", (1, 1), {(x + rnd.randint(0, 40), y + rnd.randint(0, 40)) for x, y in ((0, 0), (10**6, 3), (500, 10**5), (90, 90)) for _ in range(150)}
    yield "curve", (1, 1), {(i, i * i) for i in range(300)}  # no tile settles anything
    yield "lines", (1, 1), {(i, 0) for i in range(300)} | {(0, j) for j in range(300)} | {(150, 299)}
    yield "ends", (1, 1), {(s * ((1 << 62) - rnd.randint(0, 50)), rnd.randint(0, 50)) for s in (-1, 1) for _ in range(150)}


@pytest.mark.parametrize(("name", "scale", "points"), [pytest.param(*s, id=s[0]) for s in shapes()])
def test_tiles_agree_with_the_whole(spark, monkeypatch, name, scale, points):
    from fractions import Fraction

    rnd, plan = random.Random(2), sorted(points)
    ratio = Fraction(scale[0]) / Fraction(scale[1])
    want = terrain.triangulate([(x * ratio.numerator, y * ratio.denominator) for x, y in plan])
    rows = [(1000 + i, x, y, i % 7) for i, (x, y) in enumerate(plan)]
    rnd.shuffle(rows)
    monkeypatch.setattr(terrain, "WHOLE", 10)
    monkeypatch.setattr(terrain, "TILE", 40)
    v, f = terrain.derive(spark.createDataFrame(rows, "ordinal long, tx long, ty long, tz long"), scale)
    assert sorted(map(tuple, f.collect())) == [(i + 1, *t) for i, t in enumerate(want)]
    assert {(r.vertex_id, r.ordinal, r.tx, r.ty, r.tz) for r in v.collect()} == {(i + 1, 1000 + i, x, y, i % 7) for i, (x, y) in enumerate(plan)}
    assert f.columns == ["face_id", "v1", "v2", "v3"] and v.columns == ["vertex_id", "ordinal", "tx", "ty", "tz"]


def test_tiles_fail_as_the_whole_does(spark, monkeypatch):
    monkeypatch.setattr(terrain, "WHOLE", 10)
    monkeypatch.setattr(terrain, "TILE", 40)
    make = lambda rows: spark.createDataFrame(rows, "ordinal long, tx long, ty long, tz long")
    with pytest.raises(PlumblineError, match="one line"):
        terrain.derive(make([(i, 3 * i, 2 * i, 0) for i in range(200)]))
    with pytest.raises(PlumblineError, match="share a plan position"):
        terrain.derive(make([(i, i % 199, i % 199 % 7, 0) for i in range(200)]))
    with pytest.raises(PlumblineError, match="more than 50 vertices"):
        terrain.derive(make([(i, i, i * i, 0) for i in range(300)]), max_vertices=50)


def test_only_open_vertices_meet_in_one_task(spark):
    """Of a full grid beyond what the driver takes, tiles settle everything."""
    side = 70
    points = spark.range(side * side).selectExpr("id AS ordinal", f"id div {side} AS tx", f"id % {side} AS ty", "id % 5 AS tz")
    _, f = terrain.derive(points, max_vertices=100)
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, terrain.grid_faces(spark, side, side).collect()))
