"""LAS and LandXML files, spans, workspaces, journals, views, streams."""

import json
import struct

import numpy as np
import pytest

from plumbline.functions.geometry import MUL_1, MUL_2, ORDINAL_DOMAIN, STEP, unsigned_value, with_priority
from plumbline.model import Bounds, PlumblineError, SpatialReference, Transform
from plumbline.operators import index, terrain, workspace
from plumbline.plans.view import Budget, Planner, RequestQueue
from plumbline.sources import landxml, las, spans
from plumbline.streaming import render_state
from plumbline.workflow import PHASES, Journal, Run, ensure_report


def las_bytes(fmt: int, rows: list[dict], extra: int = 0, geo: list[int] | None = None) -> bytes:
    vlr = b""
    if geo is not None:
        payload = struct.pack(f"<{len(geo)}H", *geo)
        vlr = struct.pack("<2x16sHH32s", b"LASF_Projection", 34735, len(payload), b"") + payload
    head = 375
    body = b"".join(_record(fmt, r) + bytes(range(extra)) for r in rows)
    h = bytearray(head)
    h[:4] = b"LASF"
    h[24:26] = bytes((1, 4))
    struct.pack_into("<HIIBHI", h, 94, head, head + len(vlr), 1 if vlr else 0, fmt, las.RECORD_BYTES[fmt] + extra, len(rows) if fmt < 6 else 0)
    struct.pack_into("<3d", h, 131, 0.25, 0.5, 2.0)
    struct.pack_into("<3d", h, 155, 100.0, -50.0, 1000.0)
    struct.pack_into("<6d", h, 179, 1e9, -1e9, 1e9, -1e9, 1e9, -1e9)
    struct.pack_into("<Q", h, 247, len(rows))
    return bytes(h) + vlr + body


def _record(fmt: int, r: dict) -> bytes:
    kind = np.dtype(las._fields(fmt))
    out = np.zeros(1, kind)
    for k, v in r.items():
        if k in kind.names:
            out[k] = v
    return out.tobytes()


@pytest.mark.parametrize("fmt", range(11))
def test_las_formats(spark, tmp_path, fmt):
    rows = [{"x": -2 + i, "y": 4 - i, "z": 9 + i, "intensity": 100 * i, "bits": 0b10_010_001 if fmt < 6 else 0x21, "classes": 2 | 1 << 6, "flags": 0b1_0_01_0010, "classification": 7, "gps_time": 1.5 * i, "red": 3 * i, "wave_offset": 2**63 + i} for i in range(5)]
    path = tmp_path / "a.las"
    path.write_bytes(las_bytes(fmt, rows, extra=3))
    las.register(spark)
    df = spark.read.format("las").option("points", 2).load(str(path))
    got = df.orderBy("ordinal").collect()
    assert [(r.ordinal, r.tx, r.ty, r.tz, r.intensity) for r in got] == [(i, -2 + i, 4 - i, 9 + i, 100 * i) for i in range(5)]
    assert {r.return_number for r in got} == {1} and {r.number_of_returns for r in got} == {2}
    assert {r.classification for r in got} == {2 if fmt < 6 else 7} and {r.key_point for r in got} == {1}
    assert bytes(got[0].extra_bytes) == bytes(range(3))
    if "wave_offset" in df.columns:
        assert got[1].wave_offset == 2**63 + 1


def test_las_refusals():
    for bad in (b"nope" * 100, las_bytes(0, [])[:104] + bytes([0x80]) + las_bytes(0, [])[105:]):
        with pytest.raises(las.UnsupportedFormat):
            las.read_header(bad)
    good = [1, 1, 0, 5, 1024, 0, 1, 1, 3072, 0, 1, 32647, 3076, 0, 1, 9001, 4096, 0, 1, 5703, 4099, 0, 1, 9001]
    assert las.spatial_reference(las.read_header(las_bytes(0, [], geo=good))) == SpatialReference(32647, 5703, provenance="sourceMetadata")
    for change in ({7: 2}, {15: 9999}, {8: 1024}):
        keys = [change.get(i, v) for i, v in enumerate(good)]
        assert las.spatial_reference(las.read_header(las_bytes(0, [], geo=keys))) is None


def test_landxml_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(i * 3 + j, i, j, i * j) for i in range(3) for j in range(3)], "ordinal long, tx long, ty long, tz long")
    v, f = terrain.derive(points)
    t, ref, path = Transform((1e6, 0.0, -3.0), (0.25, 0.5, 0.1)), SpatialReference(32647, 5703), str(tmp_path / "s.xml")
    first = landxml.write(v, f, t, ref, path, name='a "<b>" & c')
    assert landxml.write(v, f, t, ref, path, name='a "<b>" & c', ensure=True) == first
    with pytest.raises(PlumblineError):
        landxml.write(v, f, t, ref, path)
    with pytest.raises(PlumblineError):
        landxml.write(v, f, t, ref, path, name="other", ensure=True)
    p, g = landxml.read(spark, path)
    assert sorted((r.id, r.x, r.y, r.z) for r in p.collect()) == sorted((r.vertex_id, *t.world((r.tx, r.ty, r.tz))) for r in v.collect())
    assert sorted(map(tuple, g.collect())) == sorted((r.v1, r.v2, r.v3) for r in f.collect())
    assert landxml.read_reference(path) == ref
    assert landxml.plain(1e-7) == "0.0000001" and landxml.plain(1e22).startswith("1000000") and landxml.plain(-0.0) == "0"
    assert landxml.valid_date("2024-02-29") and not landxml.valid_date("2023-02-29") and landxml.valid_time("23:59:59Z") and not landxml.valid_time("24:00:00Z")


def test_priority(spark):
    m = (1 << 64) - 1

    def model(o):
        x = ((o ^ ORDINAL_DOMAIN) + STEP) & m
        x = (x ^ x >> 30) * MUL_1 & m
        x = (x ^ x >> 27) * MUL_2 & m
        return x ^ x >> 31

    got = with_priority(spark.range(200).withColumnRenamed("id", "ordinal")).withColumn("u", unsigned_value(workspace.F.col("priority"))).collect()
    assert all(int(r.u) == model(r.ordinal) for r in got)


def test_spans():
    assert spans.check_spans([(5, 5), (0, 3), (3, 1), (8, 4)], 12) == [(0, 4), (5, 7)]
    for bad in ([(10, 5)], [(-1, 2)], [(0, 0)]):
        with pytest.raises(PlumblineError):
            spans.check_spans(bad, 12)


def test_digest_is_independent_of_partitions(spark):
    df = spark.range(10_000).selectExpr("id as ordinal", "id % 97 as tx")
    digests = {spans.content_digest(df.repartition(n), ["ordinal", "tx"]).first()[0] for n in (1, 7)}
    other = spans.content_digest(df.withColumn("tx", df.tx + (df.ordinal == 5).cast("int")), ["ordinal", "tx"]).first()[0]
    assert len(digests) == 1 and other not in digests


def test_bottom_k_and_boxes(spark):
    t = Transform((100.25, -50.5, 1000.0), (0.25, 0.5, 2.0))
    p = spark.range(5003).selectExpr("id as ordinal", "id % 97 - 48 as tx", "(id div 97) % 89 - 44 as ty", "id % 17 - 8 as tz", "(7 * id + id div 11) % 8 as classification")
    rows = p.collect()
    b = Bounds((98.0, -60.0, 990.0), (105.0, -45.0, 1010.0))
    want = {r.ordinal for r in rows if all(lo <= w <= hi for lo, w, hi in zip(b.low, t.world((r.tx, r.ty, r.tz)), b.high, strict=True))}
    table = index.blocks(p, t, 256)
    assert {r.ordinal for r in index.pruned_query(p, table, b, t, 256).collect()} == want
    assert index.tree_violations(index.plan_tree(spark, table)).count() == 0
    assert index.plan_tree(spark, table.limit(0)).count() == 0


def test_workspace(spark, tmp_path):
    p = spark.range(10).selectExpr("id as ordinal", "id % 3 as classification")
    w = workspace.Workspace.create(spark, str(tmp_path / "w"), p)
    some = p.where("ordinal in (1, 4, 7)")
    assert w.set_classification("a", some, 42, 0) == workspace.Outcome("committed", 1)
    assert w.set_classification("a", some, 42, 0) == workspace.Outcome("committed", 1)
    assert w.set_classification("a", some, 43, 0).reason == "OperationConflict"
    assert w.set_classification("b", some, 43, 0).reason == "StaleHead"
    assert w.set_classification("c", some, 42, 1).reason == "NoChanges" and w.resolve("c").reason == "NoChanges"
    assert w.set_classification("d", some, 1, 1, source_id="other").reason == "ForeignPointSet"
    assert w.set_classification("e", some, 9, 1, max_points=2).reason == "LimitExceeded"
    assert w.revert_head("f", 1) == workspace.Outcome("committed", 2)
    assert w.set_classification("a", p.where("ordinal in (1, 4, 8)"), 42, 0).reason == "OperationConflict"
    with pytest.raises(PlumblineError, match="locked"):
        workspace.Workspace.open(spark, w.root, p)
    w.close()
    again = workspace.Workspace.open(spark, w.root, p)
    classes = lambda n: [r.classification for r in again.snapshot(n).orderBy("ordinal").collect()]
    assert classes(0) == classes(2) == [i % 3 for i in range(10)] and classes(1)[4] == 42
    up, down = ({(r.before, r.after): r.points for r in workspace.transitions(again.revision(n)).collect()} for n in (1, 2))
    assert up == {(b, a): n for (a, b), n in down.items()}
    assert again.resolve("zz").state == "not recorded"
    with pytest.raises(PlumblineError):
        again.snapshot(3)
    with pytest.raises(PlumblineError):
        workspace.select_ids(p, spark.createDataFrame([(99,)], "ordinal long"))


def test_retry_finishes_a_staged_commit(spark, tmp_path):
    p = spark.range(4).selectExpr("id as ordinal", "0L as classification")
    w = workspace.Workspace.create(spark, str(tmp_path / "w"), p)
    workspace.changes(p, 5).write.parquet(f"{w.root}/staging-x")
    w._record("x", "d", state="ready", seq=1, facts={"kind": "set", "value": 5, "changed_points": 4})
    assert w.resolve("x").state == "retryable" and w.head() == 0
    assert w.retry("x") == workspace.Outcome("committed", 1) == w.retry("x")
    assert {r.classification for r in w.snapshot().collect()} == {5}


@pytest.mark.parametrize("stop", PHASES)
def test_runs_resume_from_every_phase(tmp_path, stop):
    calls = []
    steps = {p: lambda facts, p=p: calls.append(p) or {"seen": len(facts)} for p in PHASES[1:]}
    Run(str(tmp_path), "r", {"value": 1}).advance(steps, stop_after=stop)
    path = tmp_path / "journal.jsonl"
    with open(path, "a") as f:
        f.write('{"torn')
    facts = Run(str(tmp_path), "r", {"value": 1}).advance(steps)
    assert calls == list(PHASES[1:]) and list(facts) == list(PHASES)
    assert len(Journal(str(path), "r").complete()) == 8
    with pytest.raises(PlumblineError):
        Run(str(tmp_path), "r", {"value": 2}).advance(steps)
    assert ensure_report(str(tmp_path / "audit.json"), {"a": 1}) == ensure_report(str(tmp_path / "audit.json"), {"a": 1})
    assert json.loads((tmp_path / "audit.json").read_text()) == {"a": 1}


def test_planner(spark):
    rows = [(0, None, True, 8.0, "resident", 100, 1000), (1, 0, True, 1.0, "missing", 60, 600), (2, 0, True, 9.0, "missing", 50, 500), (3, 2, True, 0.1, "missing", 10, 100), (4, 2, False, 0.1, "missing", 10, 100)]
    frame = spark.createDataFrame(rows, "node_id long, parent_id long, visible boolean, screen_error double, status string, point_count long, byte_count long")
    p = Planner().plan(frame, Budget(1000, 10_000, 10))
    assert p.cut == [1, 2] and p.requests == [1, 2] and p.retained == [0] and p.retired == [] and p.refined == {0}  # 2 can be shown itself soon
    tight = Planner().plan(frame, Budget(150, 10_000, 10))
    assert tight.cut == [0] and tight.requests == []
    with pytest.raises(PlumblineError):
        Planner().plan(frame.unionByName(frame), Budget(1, 1, 1))
    # the second frame: 0 alone would need 1, which doesn't fit; together with 1, refined before, it needs nothing
    rows = [(0, None, True, 8.0, "resident", 10, 1), (1, 0, True, 5.0, "missing", 1000, 1), (2, 0, True, 0.1, "resident", 10, 1), (3, 1, True, 0.1, "resident", 10, 1), (4, 1, True, 0.1, "resident", 10, 1)]
    second = spark.createDataFrame(rows, frame.schema)
    planner = Planner()
    assert planner.plan(second, Budget(100, 100, 10)).cut == [0]
    planner.refined = frozenset({0, 1})
    out = planner.plan(second, Budget(100, 100, 10))
    assert out.cut == [2, 3, 4] and out.retained == [2, 3, 4] and out.retired == [0] and out.requests == [] and out.refined == {0, 1}
    assert Planner().plan(second, Budget(1500, 100, 10)).cut == [2, 3, 4]


def test_request_queue():
    q = RequestQueue()
    assert q.next(str) is None and q.reconcile([3, 1, 2], [3, 1, 2]) == 0
    assert q.next(str) == (3, "3") and q.reconcile([3, 2], [3, 2]) == 1
    assert q.waiting == [2] and q.done(3) and not q.done(3) and q.reconcile([], []) == 1


def test_render_state(spark, tmp_path):
    rows = [
        (1, 1, "upsert", 1, "a", 1, 5, 50, 0), (1, 2, "reset", 1, "", 0, 0, 0, 0), (1, 3, "upsert", 1, "a", 1, 5, 50, 0), (1, 4, "upsert", 1, "a", 1, 6, 60, 0), (1, 5, "upsert", 1, "a", 2, 7, 70, 0),
        (1, 6, "remove", 1, "a", 1, 0, 0, 0), (1, 7, "weight", 1, "a", 2, 0, 0, 9), (1, 8, "remove", 1, "a", 2, 0, 0, 0), (1, 9, "upsert", 1, "a", 2, 1, 1, 0), (1, 10, "reset", 2, "", 0, 0, 0, 0),
        (1, 11, "upsert", 1, "b", 9, 1, 1, 0), (1, 12, "reset", 1, "", 0, 0, 0, 0), (1, 13, "upsert", 2, "b", 1, 999, 1, 0),
    ]
    schema = "view long, seq long, kind string, generation long, key string, version long, points long, bytes long, weight long"
    want = ["InactiveGeneration", None, None, "VersionNotIncreasing", None, "VersionMismatch", None, None, "VersionNotIncreasing", None, "InactiveGeneration", "StaleGeneration", "LimitExceeded"]
    limits = render_state.Limits(points=100)
    df = spark.createDataFrame(rows, schema)
    assert [r.reason for r in render_state.fold_batch(df, limits).orderBy("seq").collect()] == want
    for i, part in enumerate((df.where("seq <= 6"), df.where("seq > 6"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = render_state.fold_stream(stream, limits).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.reason for r in spark.table("states").orderBy("seq").collect()] == want
