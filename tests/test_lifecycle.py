"""Catalogue, persistent surfaces, exact QA, file comparison, background jobs."""

import os
import threading

import pytest

from plumbline.cli import compare_files, main
from plumbline.jobs import Cancelled, Job
from plumbline.model import Bounds, PlumblineError, SpatialReference, Transform
from plumbline.operators import surfaces
from plumbline.sources import catalog, landxml

METRIC = SpatialReference(32647, 5703)


def grid(spark, side=4):
    return spark.createDataFrame([(i * side + j, i, j, i * j, 2) for i in range(side) for j in range(side)], "ordinal long, tx long, ty long, tz long, classification long")


def test_catalog(spark):
    rows, schema = [(-2, 4, 9, 2), (0, 5, 10, 7), (7, -3, 11, 2)], "tx long, ty long, tz long, classification int"
    df, record = catalog.from_points(spark, rows, schema, Transform((1.0, 0.0, 0.0), (0.5, 1.0, 1.0)))
    assert record.point_count == 3 and record.low == (0.0, -3.0, 9.0) and record.high == (4.5, 5.0, 11.0)
    again = catalog.verify(df.repartition(3), Transform((1.0, 0.0, 0.0), (0.5, 1.0, 1.0)), "memory")
    catalog.match(record, again)
    _, other = catalog.from_points(spark, rows[:2], schema)
    with pytest.raises(PlumblineError):
        catalog.match(record, other)
    with pytest.raises(PlumblineError):
        catalog.verify(df.where("ordinal <> 1"), Transform(), "memory")
    with pytest.raises(PlumblineError):
        catalog.verify(df, Transform(), "memory", declared=Bounds((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)))


def test_declared_columns_and_background_opening(spark):
    import pyarrow as pa

    table = pa.table({"tx": [1, 2], "ty": [3, 4], "tz": [5, 6], "classification": pa.array([2, 2], pa.int32())})
    kinds = {"tx": "bigint", "ty": "bigint", "tz": "bigint", "classification": "int"}
    df, record = catalog.from_columns(spark, table, Transform(), kinds, 2, Bounds((0.0, 0.0, 0.0), (9.0, 9.0, 9.0)))
    assert df.count() == record.point_count == 2
    _, same = catalog.open_memory(spark, [(1, 3, 5, 2), (2, 4, 6, 2)], "tx long, ty long, tz long, classification int").wait(60)
    assert same.content_hash == record.content_hash
    for bad in ((kinds, 3, None), (kinds | {"classification": "bigint"}, 2, None), (kinds | {"red": "int"}, 2, None), (kinds, 2, Bounds((0.0, 0.0, 0.0), (1.0, 9.0, 9.0)))):
        with pytest.raises(PlumblineError):
            catalog.from_columns(spark, table, Transform(), *bad)


def test_surfaces_open_and_resume(spark, tmp_path):
    args = (grid(spark), "lineage", surfaces.Recipe(), Transform(), METRIC)
    first = surfaces.prepare(spark, str(tmp_path), *args)
    assert first.disposition == "built" and (first.descriptor["vertices"], first.descriptor["faces"], first.descriptor["hull"]) == (16, 18, 12)
    second = surfaces.prepare(spark, str(tmp_path), *args)
    assert second.disposition == "opened" and second.descriptor == first.descriptor and surfaces.compare(first, second).count() == 0
    done = next(os.path.join(d, f) for d, _, fs in os.walk(tmp_path) for f in fs if f == "descriptor.json")
    os.remove(done)
    assert surfaces.prepare(spark, str(tmp_path), *args).disposition == "resumed"
    with pytest.raises(PlumblineError):
        surfaces.prepare(spark, str(tmp_path), grid(spark), "other", surfaces.Recipe(), Transform(), None)


def test_exact_qa(spark, tmp_path):
    points = spark.createDataFrame([(0, 0, 0, 0, 2), (1, 10, 0, 10, 2), (2, 10, 10, 20, 2), (3, 0, 10, 10, 2)], grid(spark).schema)
    s = surfaces.prepare(spark, str(tmp_path), points, "plane", surfaces.Recipe(), Transform(), METRIC)
    checks = spark.createDataFrame([(1, 5.0, 5.0, 11.0), (2, 5.0, 5.0, 9.5), (3, 20.0, 20.0, 0.0)], "id long, x double, y double, z double")
    r = surfaces.exact_qa(s.vertices, s.faces, Transform(), points, checks, 0.5, 0.5, 4.0, ((0.0, 0.0), (10.0, 10.0), 2))
    assert [x.surface_z for x in r.profile.orderBy("idx").collect()] == [0.0, 10.0, 20.0]
    one, t = r.statistics.first(), r.tolerance.first()
    assert (one.covered, one.gaps) == (6, 1) and (t.below, t.within, t.above, t.gap) == (0, 5, 1, 1)


def test_compare_files(spark, tmp_path):
    s = surfaces.prepare(spark, str(tmp_path / "s"), grid(spark), "x", surfaces.Recipe(), Transform(), METRIC)
    a, b = str(tmp_path / "a.xml"), str(tmp_path / "b.xml")
    landxml.write(s.vertices, s.faces, Transform(), METRIC, a)
    landxml.write(s.vertices, s.faces, Transform((0.25, 0.0, 0.0)), METRIC, b)
    assert compare_files(spark, a, a, 0, 0)["equal"] and compare_files(spark, a, b, 0.25, 0.0)["equal"]
    assert compare_files(spark, a, b, 0, 0)["reason"] == "vertex_match"
    landxml.write(s.vertices, s.faces.where("face_id > 1"), Transform(), METRIC, str(tmp_path / "c.xml"))
    assert compare_files(spark, a, str(tmp_path / "c.xml"), 0, 0)["reason"] == "counts"


def test_cli_inspects_runs(tmp_path, capsys):
    from plumbline.workflow import Run

    Run(str(tmp_path), "r", {}).advance({}, stop_after="comparison")
    assert main(["inspect", str(tmp_path)]) == 0 and '"complete": false' in capsys.readouterr().out
    assert main(["verify", str(tmp_path)]) == 1


def test_jobs(spark):
    assert Job(spark, lambda job: spark.range(5).count()).wait(60) == 5
    gate = threading.Event()

    def slow(job):
        gate.wait(30)
        job.check()

    parent = Job(spark, slow)
    child = Job(spark, slow, parent)
    parent.cancel()
    gate.set()
    for job in (parent, child):
        with pytest.raises(Cancelled):
            job.wait(60)
