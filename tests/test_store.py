"""Stored indexes, point sets, audits, exact predicates, digests and spans."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.model import Bounds, PlumblineError, SpatialReference, Transform
from plumbline.operators import audit, index, point_set, store, surfaces, terrain, workspace
from plumbline.sources import spans as sp

T = Transform((100.25, -50.5, 1000.0), (0.25, 0.5, 2.0))
BOX = Bounds((95.0, -60.0, 990.0), (105.0, -45.0, 1010.0))


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(5003).selectExpr("id as ordinal", "id % 97 - 48 as tx", "(id div 97) % 89 - 44 as ty", "id % 17 - 8 as tz", "(7 * id + id div 11) % 8 as classification", "id * 257 % 65536 as intensity")


def test_index_builds_opens_and_resumes(spark, points, tmp_path):
    recipe = store.Recipe(("intensity", "classification"), 256, 64)
    first = store.build(spark, str(tmp_path / "i"), points, "s", T, recipe)
    again = store.build(spark, str(tmp_path / "i"), points.limit(0), "s", T, recipe)  # opens; nothing is read from the source
    assert first.manifest == again.manifest
    want = {r.ordinal for r in workspace.query(points, T, BOX).collect()}
    assert {r.ordinal for r in again.query(BOX).collect()} == want and len(want) > 100
    assert not again.query(Bounds((1e6, 0.0, 0.0), (2e6, 1.0, 1.0))).count()
    nodes = {r.node_id: r for r in again.table("nodes").collect()}
    assert len(nodes) == 2 * 20 - 1 and again.visited(BOX).count() <= len(nodes)
    leaf = next(n for n in nodes.values() if n.block_id == 3)
    assert [r.ordinal for r in again.read_node(leaf.node_id).orderBy("ordinal").collect()] == list(range(768, 1024))
    root = again.read_node(0, max_points=64)
    assert root.count() == 64 and root.columns == ["ordinal", "tx", "ty", "tz", "intensity", "classification", "x", "y", "z"]
    assert store.sample_problems(points, again.table("samples"), again.table("nodes"), recipe).count() == 0
    for bad in (lambda: again.read_node(999), lambda: again.read_node(0, max_points=3), lambda: again.candidates(BOX, 1), lambda: store.build(spark, str(tmp_path / "i"), points, "s", T, recipe, fresh=True), lambda: store.open_index(spark, again.root, "other", recipe), lambda: store.open_index(spark, again.root, "s", store.Recipe((), 256, 64)), lambda: store.Recipe(("intensity",)).check(points)):
        with pytest.raises(PlumblineError):
            bad()
    cut = str(tmp_path / "cut")
    with pytest.raises(PlumblineError):
        store.build(spark, cut, points, "s", T, recipe, stop_after="frames")
    frames = os.path.join(cut + ".work", "frames")
    name = sorted(os.listdir(frames))[0]
    with open(os.path.join(frames, name), "w") as f:
        json.dump({"rows": 1, "check": 0}, f)  # a frame whose rows contradict its file is built again
    assert store.build(spark, cut, points, "s", T, recipe).manifest == first.manifest
    shutil.rmtree(os.path.join(cut, "blocks"))
    first.table("blocks").where("block_id > 0").write.parquet(os.path.join(cut, "blocks"))
    with pytest.raises(PlumblineError, match="manifest"):
        store.open_index(spark, cut, "s", recipe)


def test_relative_positions_stay_finite(spark, points):
    world = points.select("ordinal", *T.columns())
    assert store.relative_positions(world, (100.0, -50.0, 1000.0)).agg(F.max(F.abs("rx"))).first()[0] < 13
    with pytest.raises(Exception, match="finite"):
        store.relative_positions(world, (-1e300, 0.0, 0.0)).collect()


def test_point_sets(spark, points, tmp_path):
    made = point_set.PointSet.build(spark, str(tmp_path / "p"), points, "s", 0, T, BOX, 3, 256)
    found = point_set.PointSet.open(spark, made.root)
    want = sorted((r.ordinal, r.classification) for r in workspace.query(points, T, BOX, 3).collect())
    assert found.facts == made.facts and found.facts.exact_count == len(want) <= found.facts.candidate_count
    for _ in range(2):  # repeatable
        assert [x for b in found.ids(7) for x in b.column("ordinal").to_pylist()] == [o for o, _ in want]
    assert [tuple(r.values()) for b in found.entries(1000) for r in b.to_pylist()] == want
    assert all(b.num_rows <= 7 for b in found.ids(7))
    empty = point_set.PointSet.build(spark, str(tmp_path / "e"), points, "s", 0, T, None, 99, 256)
    assert empty.facts.exact_count == 0 and list(empty.ids()) == []
    with pytest.raises(PlumblineError):
        point_set.PointSet.build(spark, str(tmp_path / "l"), points, "s", 0, T, BOX, limit=3)
    shutil.rmtree(os.path.join(made.root, "rows"))
    points.limit(5).select(point_set.CONTENT).write.parquet(os.path.join(made.root, "rows"))
    with pytest.raises(PlumblineError):
        point_set.PointSet.open(spark, made.root)


def test_audits_and_recovery(spark, points, tmp_path):
    w = workspace.Workspace.create(spark, str(tmp_path / "w"), points, "s", T)
    some = points.where("ordinal in (1, 4, 7)")
    assert w.set_classification("a", some, 6, 0).state == "committed" and w.revert_head("b", 1).state == "committed"
    up, down, root = audit.audit(w, 1), audit.audit(w, 2), audit.audit(w, 0)
    assert up.changed_points == 3 and sorted((b, a, n) for a, b, n in down.transitions) == sorted(up.transitions)
    assert up.position_hash == down.position_hash and up.footprint == down.footprint and up.digest() != down.digest()
    assert root.transitions == [] and root.footprint is None and root.kind == "root"
    with pytest.raises(PlumblineError):
        audit.audit(w, 3)
    with pytest.raises(Exception, match="source"):
        audit.revision_audit(spark.createDataFrame([(99_999, 1, 2)], "ordinal long, before long, after long"), points, T).collect()
    w.close()
    path = os.path.join(w.root, "revisions.jsonl")
    with open(path) as f:
        lines = f.readlines()
    with open(path, "a") as f:
        f.write('{"seq": 3, "torn')
    again = workspace.Workspace.open(spark, w.root, points, T)
    assert again.head() == 2 and again.set_classification("c", some, 5, 2).seq == 3
    again.close()
    with open(path, "w") as f:
        f.writelines([lines[0].replace('"seq": 1', '"seq": 7'), lines[1]])
    with pytest.raises(PlumblineError, match="damaged"):
        workspace.Workspace.open(spark, w.root, points)
    with open(path, "w") as f:
        f.writelines(lines[:1])
    shutil.rmtree(os.path.join(w.root, "revision_rows", "seq=1"))
    with pytest.raises(PlumblineError, match="rows of revision 1"):
        workspace.Workspace.open(spark, w.root, points)


def test_orientation_is_exact_on_any_ticks(spark):
    rnd = random.Random(5)
    top = (1 << 63) - 1
    rows = [(-top, -top, top, top, 0, 0), (-top, -top, top, top, 0, 1), (-top, -top, top, top, 1, 0), (-top, -top, top, top - 1, top - 1, top - 1)]
    rows += [tuple(rnd.choice([rnd.randint(-top, top), rnd.randint(-9, 9)]) for _ in range(6)) for _ in range(300)]
    names = ["ax", "ay", "bx", "by", "cx", "cy"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{n} long" for n in names))
    got = {r.i: r.s for r in df.select("i", g.orientation_sign(*map(F.col, names)).alias("s")).collect()}
    for i, (ax, ay, bx, by, cx, cy) in enumerate(rows):
        v = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        assert got[i] == (v > 0) - (v < 0)


def test_surfaces_far_apart_and_scaled(spark, tmp_path):
    rnd = random.Random(3)
    for scale, reach in (((0.25, 1.0, 0.1), 10**3), ((0.1, 0.25, 1.0), 10**11), ((1.0, 1.0, 1.0), 10**17)):
        spots = {(rnd.randint(-reach, reach), rnd.randint(-reach, reach)) for _ in range(40)}
        p = spark.createDataFrame([(i, x, y, i, 2) for i, (x, y) in enumerate(sorted(spots))], "ordinal long, tx long, ty long, tz long, classification long")
        args = (p, str(reach), surfaces.Recipe(), Transform((0.0, 0.0, 0.0), scale), SpatialReference(32647, 5703))
        made = surfaces.prepare(spark, str(tmp_path), *args)
        assert [r.n for r in terrain.surface_violations(made.vertices, made.faces, scale[:2]).collect()] == [0] * 5
        assert surfaces.prepare(spark, str(tmp_path), *args).disposition == "opened"
        assert sum(b.num_rows for b in surfaces.face_batches(made, 10)) == made.descriptor["faces"]
        ids = [x for b in surfaces.vertex_batches(made, 10) for x in b.column("vertex_id").to_pylist()]
        assert ids == list(range(1, len(spots) + 1))


def test_digests_are_framed(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "~"), ("", "a"), ("a", "")]
    made = {sp.content_digest(spark.createDataFrame([(0, *r)], "ordinal long, x string, y string"), ["x", "y"]).first()[0] for r in rows}
    two = [sp.content_digest(spark.createDataFrame(r, "ordinal long, x string"), ["x"]).first()[0] for r in ([(0, "a"), (1, "b")], [(0, "a1:b")], [(0, "b"), (1, "a")])]
    assert len(made | set(two)) == len(rows) + 3


@pytest.mark.parametrize("seed", range(3))
def test_spans_unite_across_partitions(spark, seed):
    rnd = random.Random(seed)
    spans = [(rnd.randint(0, 4000), rnd.randint(0, 30)) for _ in range(300)] + ([(100, 3000)] if seed == 2 else [])
    want, held = [], sorted({o for a, n in spans for o in range(a, a + n)})
    for o in held:
        if want and want[-1][1] == o:
            want[-1][1] += 1
        else:
            want.append([o, o + 1])
    got = sp.normalize_spans(spark.createDataFrame(spans, "first_ordinal long, point_count long")).collect()
    assert sorted((r.first_ordinal, r.point_count) for r in got) == [(a, b - a) for a, b in want]
    assert index.merge_adjacent(spark.createDataFrame([], "first_ordinal long, point_count long")).count() == 0


def test_display_and_geometry(spark):
    import math

    import numpy as np

    one = spark.createDataFrame([(3.0, 65535, 0, 32768, 2, 1285)], "z double, red long, green long, blue long, classification long, intensity long")
    a = {c: F.col(c) for c in one.columns}
    ramp = [(0, 0, 0), (100, 50, 10)]
    got = one.select(*[g.display_colour(m, a, 2.0, 4.0, ramp).alias(m) for m in ("neutral", "elevation", "rgb", "intensity", "class")]).first()
    assert got == ([190, 205, 220, 255], [50, 25, 5, 255], [255, 0, 128, 255], [5, 5, 5, 255], [139, 95, 57, 255])
    for bad in (("rgb", {}), ("heat", a)):
        with pytest.raises(PlumblineError):
            g.display_colour(*bad)
    x, y = g.circumcentre(*(F.lit(float(v)) for v in (0, 0, 4, 0, 0, 2)))
    flat = g.circumcentre(*(F.lit(float(v)) for v in (0, 0, 1, 1, 2, 2)))[0]
    assert one.select(x, y, flat).first()[0:3] == (2.0, 1.0, None)
    for camera in (g.Camera((0.0, -10.0, 2.0), (0.0, 0.0, 0.0), near=1.0, far=100.0, fov_radians=1.0), g.Camera((0.0, -10.0, 2.0), (0.0, 0.0, 0.0), near=1.0, far=100.0, world_height=8.0)):
        p = (1.0, 3.0, -0.5)
        clip = np.array(camera.matrix(16 / 9)).reshape(4, 4).T @ [*p, 1.0]
        seen = one.select(*[c.alias(n) for n, c in camera.projected(*map(F.lit, p), 1600, 900).items()]).first()
        assert math.isclose((clip[0] / clip[3] + 1) * 800, seen.px, rel_tol=1e-4) and math.isclose((1 - clip[1] / clip[3]) * 450, seen.py, rel_tol=1e-4)
        assert 0 <= clip[2] / clip[3] <= 1


def test_reports(spark):
    from plumbline.operators import qa, review, roundtrip

    values = spark.createDataFrame([(v,) for v in [1e16, 1.0, -1e16] * 50], "v double")
    assert qa.compensated_sum(values) == 50.0 == qa.compensated_sum(values.repartition(7))
    drift = spark.createDataFrame([("reference", 1, 2, i) for i in range(40)] + [("returned", 5, 6, 7)], "side string, v1 long, v2 long, v3 long")
    got = {r.side: r for r in roundtrip.drift_summary(drift).collect()}
    assert got["reference"].faces == 40 and got["reference"].sample == [[1, 2, i] for i in range(16)] and got["returned"].sample == [[5, 6, 7]]
    ids = spark.createDataFrame([(1,), (1,), (2,)], "ordinal long")
    assert review.replace_highlights(ids, 3).count() == 2
    with pytest.raises(PlumblineError):
        review.replace_highlights(ids, 2)
    entries = spark.createDataFrame([("a", "x", "passed"), ("a", "y", "failed"), ("b", "x", "passed")], "project string, firm string, disposition string")
    assert tuple(audit.report_summary(entries).first()) == (3, 2, 1, 0, 2, 2)
    with pytest.raises(Exception, match="disposition"):
        audit.report_summary(entries.withColumn("disposition", F.lit("odd"))).collect()


def test_synthetic_points(spark):
    from plumbline import views

    whole = views.synthetic_points(spark, 1000, 40)
    parts = views.synthetic_points(spark, 300, 40).unionByName(views.synthetic_points(spark, 700, 40, 300))
    assert whole.count() == 1000 and not whole.exceptAll(parts).count() and not terrain.duplicate_positions(whole).count()


def test_strict_surface_files(spark, tmp_path):
    from plumbline.sources import landxml

    points = spark.createDataFrame([(i, x, y, i) for i, (x, y) in enumerate([(0, 0), (0, 5), (5, 0), (5, 6)])], "ordinal long, tx long, ty long, tz long")
    good = str(tmp_path / "a.xml")
    landxml.write(*terrain.derive(points), Transform(), SpatialReference(32647, 5703), good)
    assert landxml.check_strict(good) == (4, 2)
    with open(good) as f:
        text = f.read()
    for i, (a, b) in enumerate([("<Faces>", "<Faces><F>1 2</F>"), ('id="2"', 'id="1"'), ("</Surface>", "</Surface><Surface name='b'/>"), ("LandXML-1.2\" xmlns", "LandXML-1.1\" xmlns"), ("<Pnts>", "<Pnts><Q/>"), ("<Pnts>", "<Pnts>x"), ("<?xml version=\"1.0\" encoding=\"UTF-8\"?>", "<!DOCTYPE a>"), ("TIN", "grid"), ('linearUnit="meter"', 'linearUnit="foot"'), ("</LandXML>", ""), (">0 0 0<", ">0 nan 0<")]):
        bad = tmp_path / f"{i}.xml"
        assert a in text, a
        bad.write_text(text.replace(a, b, 1))
        with pytest.raises(PlumblineError):
            landxml.check_strict(str(bad))
    with pytest.raises(PlumblineError):
        landxml.check_strict(good, max_rows=3)
    assert landxml.valid_date("2024-02-29") and not landxml.valid_date("2023-02-29") and landxml.valid_time("23:59:59Z") and not landxml.valid_time("23:59:60Z")


def test_pull_scans(spark, points):
    spans = sp.check_spans([(10, 5), (100, 300)], 5003)
    pull = sp.Pull(points, spans, ["tx"], max_bytes=16 * 64)
    got = []
    first, part = sp.slice_batch(sp.Pull(points, spans).next(), 2, 5)
    assert first == 12 and part.column("ordinal").to_pylist() == [12, 13, 14]
    with pytest.raises(PlumblineError):
        sp.slice_batch(part, 0, 4)
    while (batch := pull.next()) is not None:
        assert batch.column_names == ["ordinal", "tx"] and batch.num_rows <= 64
        got += batch.column("ordinal").to_pylist()
    assert got == [*range(10, 15), *range(100, 400)]
    broken = sp.Pull(points.where("ordinal <> 120"), spans)
    with pytest.raises(PlumblineError):
        while broken.next() is not None:
            pass
    assert broken.next() is None and broken.error
    for bad in (lambda: sp.Pull(points, spans, ["tx"], max_bytes=3), lambda: sp.Pull(points, spans, ["tx"] * 5000)):
        with pytest.raises(PlumblineError):
            bad()
