"""The registered queries of the engine and their DuckDB counterparts over the same tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import views
from plumbline.functions import geometry as g
from plumbline.model import Bounds, PlumblineError, SpatialReference, Transform
from plumbline.operators import audit, index, point_set, qa, review, roundtrip, store, surfaces, terrain, workspace
from plumbline.plans import view as plans
from plumbline.runtime import local_folder
from plumbline.sources import spans as sp
from plumbline.streaming import render_state

TE, TL = views.TRANSFORM_E, views.TRANSFORM_L
BOX_L = Bounds((110.25, -50.0, 1000.0), (300.0, -10.0, 30000.0))
BOX_E = Bounds((10.0, 100000.0, 20.0), (120.0, 2000000.0, 400.0))
BLOCK = 4096
SPANS = [(10, 5), (12, 10), (22, 3), (100, 1), (101, 4), (200, 50), (210, 5)]
CAMERA_P = g.Camera((0.0, -200.0, 3000.0), (350.0, -20.0, 1200.0), near=1.0, far=5000.0, fov_radians=0.9)
CAMERA_O = g.Camera((300.0, -30.0, 5000.0), (300.0, -30.0, 0.0), up=(0.0, 1.0, 0.0), near=1.0, far=6000.0, world_height=60.0)
SCREEN = (1920, 1080)
RECT = (300.0, 200.0, 1500.0, 900.0)
RAMP = [(68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)]  # fixed values

PE = """points_e AS (SELECT event_id AS ordinal, user_id AS tx, date_diff('second', TIMESTAMP '2024-01-01', ts) AS ty, CAST(round(value * 100) AS BIGINT) AS tz,
  dense_rank() OVER (ORDER BY event_type) - 1 AS classification FROM events)"""
PU = """points_u AS (SELECT l_partkey AS tx, l_suppkey AS ty, CAST(round(l_extendedprice * 100) AS BIGINT) AS tz, CAST(l_linenumber AS BIGINT) AS classification, CAST(l_quantity AS BIGINT) AS intensity,
  CAST(l_partkey AS DOUBLE) * 0.25 + 100.25 AS x, CAST(l_suppkey AS DOUBLE) * 0.5 + -50.5 AS y, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) * 0.01 + 1000.0 AS z FROM lineitem)"""
PL = """points_l AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS ordinal,
  l_partkey AS tx, l_suppkey AS ty, CAST(round(l_extendedprice * 100) AS BIGINT) AS tz, CAST(l_linenumber AS BIGINT) AS classification,
  CAST(l_partkey AS DOUBLE) * 0.25 + 100.25 AS x, CAST(l_suppkey AS DOUBLE) * 0.5 + -50.5 AS y, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) * 0.01 + 1000.0 AS z FROM lineitem)"""
WE = "world_e AS (SELECT *, CAST(tx AS DOUBLE) AS x, CAST(ty AS DOUBLE) AS y, CAST(tz AS DOUBLE) * 0.01 + 0.0 AS z FROM points_e)"
RR = """c AS (SELECT ordinal, classification AS c0, CASE WHEN ordinal % 7 = 0 THEN 2 ELSE classification END AS c1 FROM points_e),
d AS (SELECT *, CASE WHEN ordinal % 11 = 0 THEN 1 ELSE c1 END AS c2 FROM c),
revision_rows AS (SELECT 1 AS seq, ordinal, c0 AS before, c1 AS after FROM d WHERE c0 <> c1 UNION ALL SELECT 2, ordinal, c1, c2 FROM d WHERE c1 <> c2 UNION ALL SELECT 3, ordinal, c2, c1 FROM d WHERE c1 <> c2)"""
GR = """side AS (SELECT max(c) // max(k) AS n FROM (SELECT count(*) AS c FROM part) t, range(1, 100000) r(k) WHERE c % k = 0 AND k * k <= c),
grid AS (SELECT p_partkey AS ordinal, p_partkey // n AS tx, p_partkey % n AS ty, CAST(round(p_retailprice * 10) AS BIGINT) AS tz, n FROM part, side),
verts AS (SELECT row_number() OVER (ORDER BY tx, ty, tz, ordinal) AS vertex_id, * FROM grid),
cells AS (SELECT a.vertex_id AS a, b.vertex_id AS b, c.vertex_id AS c, d.vertex_id AS d FROM verts a JOIN verts b ON b.tx = a.tx AND b.ty = a.ty + 1 JOIN verts c ON c.tx = a.tx + 1 AND c.ty = a.ty JOIN verts d ON d.tx = a.tx + 1 AND d.ty = a.ty + 1),
tri AS (SELECT a AS v1, c AS v2, d AS v3 FROM cells UNION ALL SELECT a, d, b FROM cells),
faces AS (SELECT row_number() OVER (ORDER BY v1, v2, v3) AS face_id, * FROM tri)"""
LOC = """corner AS (SELECT f.face_id, p.tx AS x1, p.ty AS y1, p.tz * 0.1 AS z1, q.tx AS x2, q.ty AS y2, q.tz * 0.1 AS z2, r.tx AS x3, r.ty AS y3, r.tz * 0.1 AS z3
  FROM faces f JOIN verts p ON p.vertex_id = f.v1 JOIN verts q ON q.vertex_id = f.v2 JOIN verts r ON r.vertex_id = f.v3),
pairs AS (SELECT q.id, face_id, z1, z2, z3, (x3 - x2) * (y - y2) - (y3 - y2) * (x - x2) AS a1, (x1 - x3) * (y - y3) - (y1 - y3) * (x - x3) AS a2, (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) AS a3,
  (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1) AS t FROM q JOIN corner ON x >= least(x1, x2, x3) AND x <= greatest(x1, x2, x3) AND y >= least(y1, y2, y3) AND y <= greatest(y1, y2, y3)),
hits AS (SELECT id, min(face_id) AS face_id, arg_min((a1 / t) * z1 + (a2 / t) * z2 + (1.0 - a1 / t - a2 / t) * z3, face_id) AS surface_z FROM pairs WHERE a1 >= 0 AND a2 >= 0 AND a3 >= 0 GROUP BY id)"""
CHECKS = "q AS (SELECT event_id + 1 AS id, user_id % (n + 2) + 0.25 AS x, event_id % (n + 2) + 0.5 AS y, value AS z FROM events, side)"
RES = "res AS (SELECT q.id, h.face_id, h.surface_z, q.z - h.surface_z AS residual FROM q LEFT JOIN hits h USING (id))"
TOL = "CASE WHEN residual < -50.0 THEN 'below' WHEN residual > 20.0 THEN 'above' WHEN residual IS NOT NULL THEN 'within' END"
VIEW_P = "(SELECT *, x - {e0} AS rx, y - {e1} AS ry, z - {e2} AS rz FROM {t})"

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _world(df: DataFrame, t: Transform) -> DataFrame:
    return df.select("*", *t.columns())


def _box(b: Bounds) -> str:
    return " AND ".join(f"{c} >= {lo} AND {c} <= {hi}" for c, lo, hi in zip("xyz", b.low, b.high, strict=True))


def _lits(spans) -> str:
    return ", ".join(f"({a}, {n})" for a, n in spans)


# Flagship: a closed box and a class.
@query("box_class_query", f"WITH {PU} SELECT count(*) AS points, sum(tx) AS tx_sum, min(z) AS min_z, max(z) AS max_z FROM points_u WHERE {_box(BOX_L)} AND classification = 3")
def box_class_query(s: SparkSession, d: str) -> DataFrame:
    rows = workspace.query(views.lines_unordered(s, d), TL, BOX_L, 3)
    z = TL.column(2)
    return rows.agg(F.count("*").alias("points"), F.sum("tx").alias("tx_sum"), F.min(z).alias("min_z"), F.max(z).alias("max_z"))


@query("world_projection", f"WITH {PE}, {WE} SELECT ordinal, x, y, z FROM world_e")
def _(s, d):
    return views.points_e(s, d).select("ordinal", *TE.columns())


@query("snapshot_box_rows", f"WITH {PE}, {WE} SELECT ordinal, tx, ty, tz, classification FROM world_e WHERE {_box(BOX_E)}")
def _(s, d):
    return workspace.query(views.points_e(s, d), TE, BOX_E).select("ordinal", "tx", "ty", "tz", "classification")


@query("select_all", f"WITH {PE} SELECT count(*) AS exact_count, sum(ordinal) AS ordinal_sum, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal FROM points_e")
def _(s, d):
    return workspace.summary(views.points_e(s, d)).drop("candidate_count").withColumn("ordinal_sum", F.col("ordinal_sum").cast("long"))


@query("source_bounds", f"WITH {PU} SELECT count(*) AS point_count, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points_u")
def _(s, d):
    return sp.source_bounds(views.lines_unordered(s, d), TL)


@query("bounds_check", f"WITH {PU} SELECT count(*) AS outside FROM points_u WHERE NOT ({_box(BOX_L)})")
def _(s, d):
    return sp.outside(views.lines_unordered(s, d), TL, BOX_L).agg(F.count("*").alias("outside"))


_ISLANDS = """SELECT min(a) AS first_ordinal, max(e) - min(a) AS point_count FROM (
  SELECT *, sum(fresh) OVER (ORDER BY a, e) AS island FROM (
    SELECT a, a + n AS e, CASE WHEN a <= max(a + n) OVER (ORDER BY a, a + n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {src})) GROUP BY island"""


@query("span_normalize", _ISLANDS.format(src=f"(VALUES {_lits(SPANS)}) v(a, n)"))
def _(s, d):
    return sp.normalize_spans(s.createDataFrame(SPANS, "first_ordinal long, point_count long"))


@query("span_read", f"WITH {PE} SELECT ordinal, tx, classification FROM points_e WHERE ordinal BETWEEN 10 AND 24 OR ordinal BETWEEN 100 AND 104 OR ordinal BETWEEN 200 AND 249")
def _(s, d):
    return sp.read_spans(views.points_e(s, d), sp.check_spans(SPANS, 10**9), ["tx", "classification"])


@query("attribute_projection", f"WITH {PE} SELECT ordinal, classification FROM points_e")
def _(s, d):
    return sp.read_spans(views.points_e(s, d), [(0, 1 << 60)], ["classification"])


@query("coverage_check", f"WITH {PE} SELECT 70 AS expected, count(*) AS found, count(DISTINCT ordinal) AS distinct_ordinals, count(*) = 70 AS complete FROM points_e WHERE ordinal BETWEEN 10 AND 24 OR ordinal BETWEEN 100 AND 104 OR ordinal BETWEEN 200 AND 249")
def _(s, d):
    return sp.coverage(views.points_e(s, d), sp.check_spans(SPANS, 10**9))


@query("content_digest")
def _(s, d):
    return sp.content_digest(views.points_e(s, d), ["ordinal", "tx", "ty", "tz", "classification"])


_BLOCKS = "blocks AS (SELECT ordinal // 4096 AS block_id, min(ordinal) AS first_ordinal, count(*) AS point_count, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM {t} GROUP BY 1)"


@query("block_stats", f"WITH {PL}, {_BLOCKS.format(t='points_l')} SELECT * FROM blocks")
def _(s, d):
    return index.blocks(views.points_l(s, d), TL, BLOCK)


@query("index_candidates", f"WITH {PE}, {WE}, {_BLOCKS.format(t='world_e').replace('4096', '256')} SELECT block_id, first_ordinal, point_count FROM blocks WHERE " + " AND ".join(f"max_{c} >= {lo} AND min_{c} <= {hi}" for c, lo, hi in zip("xyz", BOX_E.low, BOX_E.high, strict=True)))
def _(s, d):
    return index.candidates(index.blocks(views.points_e(s, d), TE, 256), BOX_E).select("block_id", "first_ordinal", "point_count")


@query("pruned_box_query", SQL["snapshot_box_rows"])
def _(s, d):
    p = views.points_e(s, d)
    return index.pruned_query(p, index.blocks(p, TE, 256), BOX_E, TE, 256).select("ordinal", "tx", "ty", "tz", "classification")


@query("candidate_span_merge", f"WITH {PE}, {WE}, {_BLOCKS.format(t='world_e').replace('4096', '256')} " + _ISLANDS.format(src="(SELECT first_ordinal AS a, point_count AS n FROM blocks WHERE max_z < 310.0) v"))
def _(s, d):
    return index.merge_adjacent(index.blocks(views.points_e(s, d), TE, 256).where("max_z < 310.0"))


def _mul(x: str, c: int) -> str:
    return f"(({x}) * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT"


_PRIO = f"""a AS (SELECT *, (CAST(xor(CAST(ordinal AS UBIGINT), {g.ORDINAL_DOMAIN}::UBIGINT) AS UHUGEINT) + {g.STEP}::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM points_e),
b AS (SELECT * EXCLUDE v, CAST(v AS UBIGINT) AS v FROM a), c1 AS (SELECT * EXCLUDE v, CAST({_mul('CAST(xor(v, v >> 30) AS UHUGEINT)', g.MUL_1)} AS UBIGINT) AS v FROM b),
c2 AS (SELECT * EXCLUDE v, CAST({_mul('CAST(xor(v, v >> 27) AS UHUGEINT)', g.MUL_2)} AS UBIGINT) AS v FROM c1), prio AS (SELECT * EXCLUDE v, xor(v, v >> 31) AS p FROM c2)"""


@query("ordinal_priority", f"WITH {PE}, {_PRIO} SELECT ordinal, CAST(p AS VARCHAR) AS priority FROM prio")
def _(s, d):
    return g.with_priority(views.points_e(s, d).select("ordinal")).select("ordinal", g.unsigned_value(F.col("priority")).cast("string").alias("priority"))


@query("bottom_k_sample", f"WITH {PE}, {_PRIO} SELECT ordinal // 1000 AS node_id, ordinal FROM prio QUALIFY row_number() OVER (PARTITION BY ordinal // 1000 ORDER BY p, ordinal) <= 50")
def _(s, d):
    return index.bottom_k(views.points_e(s, d), F.expr("ordinal div 1000"), 50).select("node_id", "ordinal")


@query("node_sample_merge", f"WITH {PE}, {_PRIO} SELECT ordinal FROM prio ORDER BY p, ordinal LIMIT 64")
def _(s, d):
    p = views.points_e(s, d)
    return index.node_samples(p, index.plan_tree(s, index.blocks(p, TE, 512), 64), 512, 64).where("node_id = 0").select("ordinal")


@query("bvh_nodes")
def _(s, d):
    return index.plan_tree(s, index.blocks(views.points_e(s, d), TE, 256))


@query("bvh_violations", "SELECT 0 AS violations")
def _(s, d):
    return index.tree_violations(index.plan_tree(s, index.blocks(views.points_e(s, d), TE, 256))).agg(F.count("*").alias("violations"))


# Revisions.
def _edited(s, d):
    p = views.points_e(s, d)
    return p, views.revision_rows(p)


@query("overlay_asof", f"WITH {PE}, {RR} SELECT ordinal, arg_max(after, seq) AS value FROM revision_rows WHERE seq <= 2 GROUP BY ordinal")
def _(s, d):
    return workspace.overlay(_edited(s, d)[1], 2)


_SNAP = "snap AS (SELECT p.* EXCLUDE classification, coalesce(o.value, p.classification) AS classification FROM points_e p LEFT JOIN (SELECT ordinal, arg_max(after, seq) AS value FROM revision_rows WHERE seq <= {n} GROUP BY ordinal) o USING (ordinal))"


@query("snapshot_rows", f"WITH {PE}, {RR}, {_SNAP.format(n=3)} SELECT ordinal, tx, ty, tz, classification FROM snap")
def _(s, d):
    return workspace.snapshot(*_edited(s, d), 3).select("ordinal", "tx", "ty", "tz", "classification")


@query("snapshot_class_summary", f"WITH {PE}, {RR}, {_SNAP.format(n=2)} SELECT count(*) AS exact_count, CAST(sum(ordinal) AS BIGINT) AS ordinal_sum, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal FROM snap WHERE classification = 1")
def _(s, d):
    return workspace.summary(workspace.query(workspace.snapshot(*_edited(s, d), 2), TE, None, 1)).drop("candidate_count")


@query("select_point_ids", f"WITH {PE} SELECT ordinal, classification FROM points_e WHERE ordinal IN (SELECT o_custkey FROM orders)")
def _(s, d):
    ids = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("ordinal"))
    return workspace.select_ids(views.points_e(s, d), ids).select("ordinal", "classification")


@query("point_id_spans", _ISLANDS.format(src="(SELECT DISTINCT event_id AS a, 1 AS n FROM events WHERE event_type <> (SELECT min(event_type) FROM events)) v"))
def _(s, d):
    return workspace.id_spans(views.points_e(s, d).where("classification <> 0"))


@query("confirm_pick", f"WITH {PE}, {WE} SELECT ordinal, tx, ty, tz, x, y, z, classification FROM world_e WHERE ordinal = 77")
def _(s, d):
    return workspace.confirm_pick(views.points_e(s, d), 77, TE)


@query("commit_rows_noop_drop", f"WITH {PE} SELECT ordinal, classification AS before, 3 AS after FROM points_e WHERE tx < 50 AND classification <> 3")
def _(s, d):
    return workspace.changes(views.points_e(s, d).where("tx < 50"), 3)


@query("revert_rows", f"WITH {PE}, {RR} SELECT ordinal, after AS before, before AS after FROM revision_rows WHERE seq = 2")
def _(s, d):
    return workspace.reverted(_edited(s, d)[1].where("seq = 2"))


@query("revision_audit_transitions", f"WITH {PE}, {RR} SELECT before, after, count(*) AS points FROM revision_rows WHERE seq = 1 GROUP BY ALL")
def _(s, d):
    return workspace.transitions(_edited(s, d)[1].where("seq = 1"))


@query("edit_footprint", f"WITH {PE}, {RR}, {WE} SELECT count(*) AS points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM revision_rows JOIN world_e USING (ordinal) WHERE seq = 2")
def _(s, d):
    p, r = _edited(s, d)
    return workspace.footprint(r.where("seq = 2"), p, TE)


@query("head_revision", f"WITH {PE}, {RR} SELECT max(seq) AS head, max(seq) + 1 AS next_seq FROM revision_rows")
def _(s, d):
    return _edited(s, d)[1].agg(F.max("seq").alias("head"), (F.max("seq") + 1).alias("next_seq"))


@query("containment_check", f"WITH {PE} SELECT count(*) AS foreign_ids FROM (SELECT DISTINCT l_partkey AS ordinal FROM lineitem) ANTI JOIN (SELECT * FROM points_e WHERE classification = 2) USING (ordinal)")
def _(s, d):
    ids = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("ordinal")).distinct()
    return ids.join(views.points_e(s, d).where("classification = 2"), "ordinal", "left_anti").agg(F.count("*").alias("foreign_ids"))


@query("snapshot_span_rows", f"WITH {PE}, {RR}, {_SNAP.format(n=3)} SELECT ordinal, classification FROM snap WHERE ordinal BETWEEN 10 AND 24 OR ordinal BETWEEN 100 AND 104 OR ordinal BETWEEN 200 AND 249")
def _(s, d):
    return workspace.snapshot_spans(*_edited(s, d), 3, sp.check_spans(SPANS, 10**9)).select("ordinal", "classification")


# Review.
def _screen_sql(c: g.Camera) -> str:
    f, r, u = c.basis()
    dot = lambda v: f"(rx * {v[0]!r}::DOUBLE + ry * {v[1]!r}::DOUBLE + rz * {v[2]!r}::DOUBLE)"
    w, h = SCREEN
    if c.fov_radians is not None:
        vs = f"(depth * {math.tan(c.fov_radians * 0.5)!r}::DOUBLE)"
        hs, extra = f"({vs} * {w / h!r}::DOUBLE)", "AND depth > 0"
    else:
        vs, hs, extra = f"{c.world_height * 0.5!r}::DOUBLE", f"{c.world_height * 0.5 * (w / h)!r}::DOUBLE", ""
    rel = VIEW_P.format(e0=repr(c.eye[0]), e1=repr(c.eye[1]), e2=repr(c.eye[2]), t="points_u")
    return f"""WITH {PU}, r AS (SELECT *, {dot(f)} AS depth, {dot(r)} AS h, {dot(u)} AS v FROM {rel}),
n AS (SELECT *, h / {hs} AS nx, v / {vs} AS ny FROM r WHERE depth >= {c.near!r} AND depth <= {c.far!r} {extra}),
p AS (SELECT *, (nx + 1.0) * {w} / 2.0 AS px, (1.0 - ny) * {h} / 2.0 AS py FROM n WHERE nx BETWEEN -1.0 AND 1.0 AND ny BETWEEN -1.0 AND 1.0)
SELECT classification, count(*) AS points, sum(tx) AS tx_sum, round(sum(px), 3) AS px_sum FROM p WHERE px BETWEEN {RECT[0]} AND {RECT[2]} AND py BETWEEN {RECT[1]} AND {RECT[3]} GROUP BY classification"""


def _screen(camera):
    def run(s, d):
        rect = review.rectangle((RECT[2], RECT[1]), (RECT[0], RECT[3]), *SCREEN)
        hit = review.screen_through(views.lines_unordered(s, d), camera, TL, rect, *SCREEN)
        return hit.groupBy("classification").agg(F.count("*").alias("points"), F.sum("tx").alias("tx_sum"), F.round(F.sum("px"), 3).alias("px_sum"))

    return run


query("screen_through_persp", _screen_sql(CAMERA_P))(_screen(CAMERA_P))
query("screen_through_ortho", _screen_sql(CAMERA_O))(_screen(CAMERA_O))


# Terrain.
def _grid(s, d):
    p, rows, n = views.grid_points(s, d)
    return terrain.grid_vertices(p, n), terrain.grid_faces(s, rows, n), n


@query("tin_vertices", f"WITH {GR} SELECT vertex_id, ordinal, tx, ty, tz FROM verts")
def _(s, d):
    return terrain.vertices(views.grid_points(s, d)[0])


@query("tin_duplicates", f"WITH {PE} SELECT tx, classification AS ty, count(*) AS points, min(tz) <> max(tz) AS conflicting FROM points_e GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return terrain.duplicate_positions(views.points_e(s, d).withColumn("ty", F.col("classification")))


@query("tin_faces_grid", f"WITH {GR} SELECT face_id, v1, v2, v3 FROM faces")
def _(s, d):
    return _grid(s, d)[1]


@query("tin_faces_kernel", f"WITH {GR} SELECT face_id, v1, v2, v3 FROM faces")
def _(s, d):
    return terrain.derive(views.grid_points(s, d)[0])[1]


@query("tin_hull_count", f"WITH {GR} SELECT (SELECT count(*) FROM verts) AS vertices, (SELECT count(*) FROM faces) AS faces, 2 * (SELECT count(*) FROM verts) - 2 - (SELECT count(*) FROM faces) AS hull")
def _(s, d):
    v, f, _ = _grid(s, d)
    n = v.agg(F.count("*").alias("vertices")).withColumn("k", F.lit(1)).join(f.agg(F.count("*").alias("faces")).withColumn("k", F.lit(1)), "k")
    return n.select("vertices", "faces", (2 * F.col("vertices") - 2 - F.col("faces")).alias("hull"))


@query("delaunay_violations", "SELECT * FROM (VALUES ('orientation', 0), ('canonical', 0), ('edge', 0), ('unused', 0), ('circle', 0)) v(rule, n)")
def _(s, d):
    return terrain.surface_violations(*_grid(s, d)[:2])


TG = Transform((0.0, 0.0, 0.0), (1.0, 1.0, 0.1))


def _checked(s, d):
    v, f, n = _grid(s, d)
    events = s.read.parquet(f"{d}/events.parquet")
    q = events.select((F.col("event_id") + 1).alias("id"), (F.col("user_id") % (n + 2) + 0.25).alias("x"), (F.col("event_id") % (n + 2) + 0.5).alias("y"), F.col("value").alias("z"))
    return qa.residuals(qa.locate(q, qa.world_faces(f, v, TG), 1.0, ["id"]), 50.0, 20.0)


@query("check_point_residuals", f"WITH {GR}, {CHECKS}, {LOC}, {RES} SELECT id, face_id, round(surface_z, 6) AS surface_z, round(residual, 6) AS residual, {TOL} AS tolerance FROM res")
def _(s, d):
    return _checked(s, d).select("id", "face_id", F.round("surface_z", 6).alias("surface_z"), F.round("residual", 6).alias("residual"), "tolerance")


@query("residual_statistics", f"WITH {GR}, {CHECKS}, {LOC}, {RES} SELECT count(residual) AS covered, count(*) - count(residual) AS gaps, round(min(residual), 6) AS min, round(max(residual), 6) AS max, round(avg(residual), 6) AS mean, round(sqrt(avg(residual * residual)), 6) AS rms FROM res")
def _(s, d):
    t = qa.statistics(_checked(s, d))
    return t.select("covered", "gaps", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "rms")])


@query("tolerance_summary", f"WITH {GR}, {CHECKS}, {LOC}, {RES}, c2 AS (SELECT {TOL} AS t FROM res) SELECT count(*) FILTER (t = 'below') AS below, count(*) FILTER (t = 'within') AS within, count(*) FILTER (t = 'above') AS above, count(*) FILTER (t IS NULL) AS gap FROM c2")
def _(s, d):
    return qa.tolerance_summary(_checked(s, d))


@query("profile_stations", f"WITH {GR}, q AS (SELECT i AS id, sqrt(7.5 * 7.5 + 3.0 * 3.0) * i / 16.0 AS station_m, CASE WHEN i = 0 THEN 0.5 WHEN i = 16 THEN 8.0 ELSE 0.5 + 7.5 * (i / 16.0) END AS x, CASE WHEN i = 0 THEN 1.0 WHEN i = 16 THEN 4.0 ELSE 1.0 + 3.0 * (i / 16.0) END AS y FROM range(17) r(i)), {LOC} SELECT id AS idx, round(station_m, 9) AS station_m, x, y, face_id, round(surface_z, 6) AS surface_z FROM q LEFT JOIN hits USING (id)")
def _(s, d):
    v, f, _ = _grid(s, d)
    st = qa.locate(qa.profile_stations(s, (0.5, 1.0), (8.0, 4.0), 16), qa.world_faces(f, v, TG), 1.0, ["idx"])
    return st.select("idx", F.round("station_m", 9).alias("station_m"), "x", "y", "face_id", F.round("surface_z", 6).alias("surface_z"))


def _flipped(v: DataFrame, f: DataFrame) -> DataFrame:
    """The surface with the other diagonal in every seventh cell."""
    n = F.col("v3") - 1 - F.col("v1")
    cell = F.expr("(face_id - 1) div 2")
    up = f.where((cell % 7 == 0) & (F.col("face_id") % 2 == 1)).withColumn("n", n)
    two = F.array(F.struct("v1", F.col("v2"), (F.col("v1") + 1).alias("v3")), F.struct(F.col("v2").alias("v1"), F.col("v3").alias("v2"), (F.col("v1") + 1).alias("v3")))
    other = up.select("face_id", F.posexplode(two).alias("i", "t")).select((F.col("face_id") + F.col("i")).alias("face_id"), "t.v1", "t.v2", "t.v3")
    return f.where(cell % 7 != 0).unionByName(other)


_FLIP = """cell AS (SELECT (row_number() OVER (ORDER BY a) - 1) AS k, * FROM cells),
after AS (SELECT a AS v1, c AS v2, d AS v3 FROM cell WHERE k % 7 <> 0 UNION ALL SELECT a, d, b FROM cell WHERE k % 7 <> 0 UNION ALL SELECT a, c, b FROM cell WHERE k % 7 = 0 UNION ALL SELECT c, d, b FROM cell WHERE k % 7 = 0),
k1 AS (SELECT list_sort([v1 - 1, v2 - 1, v3 - 1]) AS k FROM tri), k2 AS (SELECT list_sort([v1 - 1, v2 - 1, v3 - 1]) AS k FROM after),
diff AS (SELECT 'removed' AS change, k FROM (SELECT k FROM k1 EXCEPT SELECT k FROM k2) UNION ALL SELECT 'added', k FROM (SELECT k FROM k2 EXCEPT SELECT k FROM k1))"""


@query("surface_compare", f"WITH {GR}, {_FLIP} SELECT change, k[1] AS k1, k[2] AS k2, k[3] AS k3 FROM diff")
def _(s, d):
    v, f, _ = _grid(s, d)
    return terrain.compare_surfaces((v, f), (v, _flipped(v, f)))


@query("change_bounds", f"WITH {GR}, {_FLIP}, hit AS (SELECT DISTINCT unnest(k) AS ordinal FROM diff) SELECT count(*) AS vertices, min(tx) AS min_tx, max(tx) AS max_tx, min(ty) AS min_ty, max(ty) AS max_ty, min(tz) AS min_tz, max(tz) AS max_tz FROM hit JOIN grid USING (ordinal)")
def _(s, d):
    v, f, _ = _grid(s, d)
    return terrain.change_bounds(terrain.compare_surfaces((v, f), (v, _flipped(v, f))), v)


@query("freshness_states", "SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_id % 3 = 0 THEN 'stale_snapshot_and_surface' WHEN user_id % 2 = 0 THEN 'stale_snapshot' WHEN event_id % 3 = 0 THEN 'stale_surface' WHEN event_id % 5 < 3 THEN 'current' ELSE 'snapshot_only_current' END AS state FROM events")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", qa.freshness(F.col("user_id") % 2 == 0, F.col("event_id") % 3 == 0, F.col("event_id") % 5 < 3).alias("state"))


@query("landxml_points", f"WITH {GR} SELECT vertex_id, CAST(ty AS DOUBLE) AS northing, CAST(tx AS DOUBLE) AS easting, CAST(tz AS DOUBLE) * 0.1 + 0.0 AS elevation FROM verts")
def _(s, d):
    from plumbline.sources.landxml import point_rows

    return point_rows(_grid(s, d)[0], TG)


def _returned(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    ref = v.select(F.col("vertex_id").alias("id"), F.col("tx").cast("double").alias("x"), F.col("ty").cast("double").alias("y"), (F.col("tz") * 0.1).alias("z"))
    return ref, ref.where("id % 50 <> 0").select((F.col("id") + 1000).alias("id"), (F.col("x") + 0.125 * (F.col("id") % 4)).alias("x"), "y", (F.col("z") + 0.25 * (F.col("id") % 3)).alias("z"))


_RET = """ref AS (SELECT vertex_id AS id, CAST(tx AS DOUBLE) AS x, CAST(ty AS DOUBLE) AS y, tz * 0.1::DOUBLE AS z FROM verts),
ret AS (SELECT id + 1000 AS id, x + 0.125 * (id % 4) AS x, y, z + 0.25 * (id % 3) AS z FROM ref WHERE id % 50 <> 0),
m AS (SELECT a.id AS ref_id, b.id AS ret_id, abs(b.x - a.x) AS d_east, abs(b.y - a.y) AS d_north, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d_plan, abs(b.z - a.z) AS d_up FROM ref a JOIN ret b ON abs(b.x - a.x) <= 0.25 AND abs(b.y - a.y) <= 0.25 WHERE sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 0.25 AND abs(b.z - a.z) <= 0.3)"""


@query("roundtrip_match", f"WITH {GR}, {_RET} SELECT ref_id, ret_id, d_east, d_north, d_plan, round(d_up, 9) AS d_up FROM m")
def _(s, d):
    return roundtrip.match_within(*_returned(_grid(s, d)[0]), 0.25, 0.3).withColumn("d_up", F.round("d_up", 9))


@query("roundtrip_problems", f"WITH {GR}, {_RET} SELECT 'reference' AS side, ref.id, count(m.ref_id) AS matches FROM ref LEFT JOIN m ON m.ref_id = ref.id GROUP BY ref.id HAVING count(m.ref_id) <> 1 UNION ALL SELECT 'returned', ret.id, count(m.ret_id) FROM ret LEFT JOIN m ON m.ret_id = ret.id GROUP BY ret.id HAVING count(m.ret_id) <> 1")
def _(s, d):
    ref, ret = _returned(_grid(s, d)[0])
    return roundtrip.match_problems(roundtrip.match_within(ref, ret, 0.25, 0.3), ref, ret)


@query("roundtrip_exact_match", f"WITH {GR}, {_RET} SELECT a.id AS ref_id, b.id AS ret_id FROM ref a JOIN ret b USING (x, y, z)")
def _(s, d):
    return roundtrip.match_exact(*_returned(_grid(s, d)[0]))


@query("roundtrip_topology", f"WITH {GR}, {_FLIP}, f2 AS (SELECT CASE WHEN least(v1, v2, v3) = v1 THEN [v1, v2, v3] WHEN least(v1, v2, v3) = v2 THEN [v2, v3, v1] ELSE [v3, v1, v2] END AS k FROM after), f1 AS (SELECT [v1, v2, v3] AS k FROM tri), lost AS (SELECT 'reference' AS side, k FROM (SELECT k FROM f1 EXCEPT SELECT k FROM f2) UNION ALL SELECT 'returned', k FROM (SELECT k FROM f2 EXCEPT SELECT k FROM f1)) SELECT side, k[1] AS v1, k[2] AS v2, k[3] AS v3 FROM lost")
def _(s, d):
    v, f, _ = _grid(s, d)
    moved = _flipped(v, f).select(*[(F.col(f"v{i}") + 1000).alias(f"v{i}") for i in (1, 2, 3)])
    same = v.select(F.col("vertex_id").alias("ref_id"), (F.col("vertex_id") + 1000).alias("ret_id"))
    return roundtrip.topology_drift(f, moved, same)


# Views.
_VB = f"{PE}, {WE}, {_BLOCKS.format(t='world_e').replace('4096', '256')}"
CAMERA_V = g.Camera((75.0, -500000.0, 900.0), (75.0, 1000000.0, 250.0), near=1.0, far=2_000_000.0, fov_radians=0.001)


def _sees_sql(c: g.Camera) -> str:
    parts = []
    for normal, offset in c.planes(*SCREEN):
        sup = [f"{'max' if v >= 0 else 'min'}_{a}" for v, a in zip(normal, "xyz", strict=True)]
        value = f"{offset!r}::DOUBLE" + "".join(f" + {v!r}::DOUBLE * ({q} - {e!r}::DOUBLE)" for v, q, e in zip(normal, sup, c.eye, strict=True))
        size = f"{abs(offset)!r}::DOUBLE" + "".join(f" + {abs(v)!r}::DOUBLE * (abs({q}) + {abs(e)!r}::DOUBLE)" for v, q, e in zip(normal, sup, c.eye, strict=True))
        parts.append(f"NOT (({value}) < -(({size}) * 1e-15 * 8))")
    return " AND ".join(parts)


def _error_sql(c: g.Camera) -> str:
    f = c.basis()[0]
    depth = " + ".join(f"{v!r}::DOUBLE * ((min_{a} + max_{a}) / 2 - {e!r}::DOUBLE)" for v, a, e in zip(f, "xyz", c.eye, strict=True))
    radius = " + ".join(f"{abs(v)!r}::DOUBLE * ((max_{a} - min_{a}) / 2)" for v, a in zip(f, "xyz", strict=True))
    return f"(point_count / 10.0) * {SCREEN[1] / (2 * math.tan(c.fov_radians * 0.5))!r}::DOUBLE / greatest(({depth}) - ({radius}), {c.near!r})"


def _frame(s, d):
    b = index.blocks(views.points_e(s, d), TE, 256).withColumn("geometric_error", F.col("point_count") / 10.0)
    return plans.project(b, CAMERA_V, *SCREEN)


@query("frustum_cull", f"WITH {_VB} SELECT block_id FROM blocks WHERE {_sees_sql(CAMERA_V)}")
def _(s, d):
    return _frame(s, d).where("visible").select("block_id")


@query("screen_space_error", f"WITH {_VB} SELECT block_id, round({_error_sql(CAMERA_V)}, 6) AS screen_error FROM blocks")
def _(s, d):
    return _frame(s, d).select("block_id", F.round("screen_error", 6).alias("screen_error"))


@query("lod_threshold", f"WITH {_VB}, e AS (SELECT block_id, {_error_sql(CAMERA_V)} AS e FROM blocks) SELECT block_id, CASE WHEN block_id % 2 = 0 THEN e >= 23.75 ELSE e > 24.25 END AS refines FROM e")
def _(s, d):
    return _frame(s, d).select("block_id", g.refines(F.col("screen_error"), F.col("block_id") % 2 == 0, 24.0, 0.25).alias("refines"))


@query("view_cut")
def _(s, d):
    nodes = index.plan_tree(s, index.blocks(views.points_e(s, d), TE, 256))
    frame = plans.project(nodes, CAMERA_V, *SCREEN).withColumn("status", F.when(F.col("node_id") < 3, "resident").otherwise("missing"))
    frame = frame.withColumns({"point_count": F.col("display_count"), "byte_count": F.col("display_count") * 24})
    p = plans.Planner().plan(frame, plans.Budget(20_000, 1 << 30, 64))
    return s.createDataFrame([(k, n) for k, v in (("cut", p.cut), ("request", p.requests), ("retain", p.retained), ("retire", p.retired)) for n in v], "part string, node_id long")


@query("parent_lookup", "SELECT 0 AS problems")
def _(s, d):
    return plans.node_problems(index.plan_tree(s, index.blocks(views.points_e(s, d), TE, 256))).agg(F.count("*").alias("problems"))


def _updates(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    up = e.select((F.col("user_id") % 10).alias("view"), (F.col("event_id") * 2 + 1).alias("seq"), F.lit("upsert").alias("kind"), F.expr("event_id div 1000").alias("generation"), F.expr("event_id % 20").cast("string").alias("key"), F.col("event_id").alias("version"), F.col("user_id").alias("points"), (F.col("user_id") * 24).alias("bytes"), F.lit(255).cast("long").alias("weight"))
    first = up.groupBy("view", "generation").agg(F.min("seq").alias("seq")).select("view", (F.col("seq") - 1).alias("seq"), F.lit("reset").alias("kind"), "generation", F.lit("").alias("key"), *[F.lit(0).cast("long").alias(c) for c in ("version", "points", "bytes", "weight")])
    return up.unionByName(first)


@query("render_state_fold", "WITH u AS (SELECT user_id % 10 AS view, event_id // 1000 AS generation, event_id % 20 AS key, event_id AS version, user_id AS points FROM events), l AS (SELECT view, max(generation) AS generation FROM u GROUP BY view), f AS (SELECT view, key, arg_max(points, version) AS points FROM u JOIN l USING (view, generation) GROUP BY view, key) SELECT view, count(*) AS batches, CAST(sum(points) AS BIGINT) AS points FROM f GROUP BY view")
def _(s, d):
    out = render_state.fold_batch(_updates(s, d))
    return out.groupBy("view").agg(F.max_by("batches", "seq").alias("batches"), F.max_by("points", "seq").alias("points"))


@query("render_state_residency", "WITH u AS (SELECT user_id % 10 AS view, event_id // 1000 AS generation, CAST(event_id % 20 AS VARCHAR) AS key, event_id AS version, user_id AS points FROM events), l AS (SELECT view, max(generation) AS generation FROM u GROUP BY view) SELECT view, key, max(version) AS version, arg_max(points, version) AS points FROM u JOIN l USING (view, generation) GROUP BY view, key")
def _(s, d):
    return render_state.final_residency(_updates(s, d))


# Display.
@query("display_rgb", f"WITH {PU} SELECT intensity, count(*) AS n, (intensity * 1311 * 255 + 32767) // 65535 AS red, (classification * 9000 * 255 + 32767) // 65535 AS green FROM points_u GROUP BY intensity, classification")
def _(s, d):
    p = views.lines_unordered(s, d).groupBy("intensity", "classification").agg(F.count("*").alias("n"))
    return p.select("intensity", "n", g.scale_u16(F.col("intensity") * 1311).alias("red"), g.scale_u16(F.col("classification") * 9000).alias("green"))


def _palette(axis: int, c: str) -> str:
    times, plus = g.OTHER_CLASS[axis]
    return f"coalesce([{', '.join(str(v[axis]) for v in g.CLASS_COLOURS)}][CAST({c} AS BIGINT) + 1], ({c} * {times} + {plus}) % 256)"


@query("display_classification", f"WITH {PU} SELECT intensity AS class, count(*) AS n, {_palette(0, 'intensity')} AS red, {_palette(1, 'intensity')} AS green, {_palette(2, 'intensity')} AS blue FROM points_u GROUP BY intensity")
def _(s, d):
    p = views.lines_unordered(s, d).groupBy(F.col("intensity").alias("class")).agg(F.count("*").alias("n"))
    return p.select("class", "n", *[c.alias(a) for c, a in zip(g.class_colour(F.col("class")), ("red", "green", "blue"), strict=True)])


def _stop(axis: int) -> str:
    t = f"[{', '.join(str(float(v[axis])) for v in RAMP)}]"
    return f"CAST(round({t}[lo + 1] + ({t}[lo + 2] - {t}[lo + 1]) * (at4 - lo)) AS BIGINT)"


@query("display_elevation", f"WITH {PE}, {WE}, n AS (SELECT ordinal, CASE WHEN z <= 50.0 THEN 0.0 WHEN z >= 400.0 THEN 1.0 WHEN z <= 225.0 THEN 0.5 * ((z - 50.0) / 175.0) ELSE 0.5 + 0.5 * ((z - 225.0) / 175.0) END * 4.0 AS at4 FROM world_e), m AS (SELECT *, CAST(least(floor(at4), 3) AS BIGINT) AS lo FROM n) SELECT ordinal, {_stop(0)} AS red, {_stop(1)} AS green, {_stop(2)} AS blue FROM m")
def _(s, d):
    at = g.normalised_elevation(TE.column(2), 50.0, 400.0)
    return views.points_e(s, d).select("ordinal", *[c.alias(a) for c, a in zip(g.ramp_colour(at, RAMP), ("red", "green", "blue"), strict=True)])


@query("density_point_size", f"WITH {PU} SELECT classification, round(least(greatest(0.55 * sqrt(2073600.0 / count(*)), 1.0), 4.0), 9) AS size FROM points_u GROUP BY 1")
def _(s, d):
    p = views.lines_unordered(s, d).groupBy("classification").agg(F.count("*").alias("n"))
    return p.select("classification", F.round(g.density_point_size(1920 * 1080, F.col("n")), 9).alias("size"))


@query("fade_weights", "SELECT i AS step, CAST(round(255.0 * i / 8) AS BIGINT) AS weight FROM range(9) r(i)")
def _(s, d):
    return s.range(9).select(F.col("id").alias("step"), g.fade_weight(F.col("id")).alias("weight"))


@query("las_bitfields", "SELECT l_partkey, l_suppkey, count(*) AS n, (l_partkey % 256) & 7 AS return_number, ((l_partkey % 256) >> 3) & 7 AS number_of_returns, ((l_partkey % 256) >> 6) & 1 AS scan_direction, (l_partkey % 256) >> 7 AS edge_of_flight_line, l_suppkey & 31 AS classification, (l_suppkey >> 5) & 1 AS synthetic, (l_suppkey >> 6) & 1 AS key_point FROM lineitem GROUP BY l_partkey, l_suppkey")
def _(s, d):
    """Records of format 0 made of the keys' bytes, decoded by the source's own decoder."""
    from plumbline.runtime import ship

    ship(s)
    out = ["return_number", "number_of_returns", "scan_direction", "edge_of_flight_line", "classification", "synthetic", "key_point"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from plumbline.sources import las

        kind = np.dtype(las._fields(0))
        head = las.Header((1, 2), 0, las.RECORD_BYTES[0], 0, 0, Transform(), (0.0,) * 3, (0.0,) * 3, ())
        for batch in batches:
            records = np.zeros(batch.num_rows, kind)
            records["bits"], records["classes"] = (batch.column(i).to_numpy() % 256 for i in (0, 1))
            held = las.decode(head, 0, records.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(held[c].astype(np.int64)) for c in out]], names=["l_partkey", "l_suppkey", "n", *out])

    rows = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("l_partkey", "l_suppkey", "n", *out)))


# Whole reports and history.
@query("exact_qa_tolerance", f"WITH {GR}, {CHECKS}, {LOC}, {RES}, c2 AS (SELECT {TOL} AS t FROM res) SELECT count(*) FILTER (t = 'below') AS below, count(*) FILTER (t = 'within') + (SELECT count(*) FROM verts) AS within, count(*) FILTER (t = 'above') AS above, count(*) FILTER (t IS NULL) AS gap FROM c2")
def _(s, d):
    from plumbline.operators.surfaces import exact_qa

    v, f, n = _grid(s, d)
    events = s.read.parquet(f"{d}/events.parquet")
    checks = events.select((F.col("event_id") + 1).alias("id"), (F.col("user_id") % (n + 2) + 0.25).alias("x"), (F.col("event_id") % (n + 2) + 0.5).alias("y"), F.col("value").alias("z"))
    return exact_qa(v, f, TG, v, checks, 50.0, 20.0, 1.0).tolerance


@query("revert_restores", "SELECT 0 AS differences")
def _(s, d):
    p, r = _edited(s, d)
    one, three = (workspace.snapshot(p, r, n).select("ordinal", F.col("classification").alias(f"c{n}")) for n in (1, 3))
    return one.join(three, "ordinal").where("c1 <> c3").agg(F.count("*").alias("differences"))


_HIST = " UNION ALL ".join(f"SELECT {n} AS seq, classification, count(*) AS points FROM s{n} GROUP BY classification" for n in (1, 2, 3))


@query("class_history", f"WITH {PE}, {RR}, " + ", ".join(_SNAP.format(n=n).replace("snap AS", f"s{n} AS", 1) for n in (1, 2, 3)) + f" {_HIST}")
def _(s, d):
    p, r = _edited(s, d)
    out = None
    for n in (1, 2, 3):
        one = workspace.snapshot(p, r, n).groupBy("classification").agg(F.count("*").alias("points")).select(F.lit(n).cast("long").alias("seq"), "classification", "points")
        out = one if out is None else out.unionByName(one)
    return out


@query("source_record")
def _(s, d):
    from plumbline.sources.catalog import verify

    record = verify(views.points_e(s, d), TE, "events").as_dict()
    return s.createDataFrame([(record["source_id"], record["content_hash"], record["point_count"])], "source_id string, content_hash string, point_count long")


# Digests, point sets, audits and the stored index.
def _framed(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')"


def _digest_sql(name: str, src: str, columns: list[str]) -> str:
    """CTEs that end in name(h): rows in chunks of 4096 ordinals, then chunk digests, three times, then the whole."""
    out = f"{name}_0 AS (SELECT ordinal, {' || '.join(map(_framed, columns))} AS t FROM {src})"
    for i in range(3):
        out += f", {name}_{i + 1} AS (SELECT ordinal // 4096 AS ordinal, sha256(string_agg({_framed('t')}, '' ORDER BY ordinal)) AS t FROM {name}_{i} GROUP BY ordinal // 4096)"
    return out + f", {name} AS (SELECT sha256(coalesce(string_agg({_framed('t')}, '' ORDER BY ordinal), '')) AS h FROM {name}_3)"


_CONTENT = ["ordinal", "tx", "ty", "tz", "classification"]
SQL["content_digest"] = f"WITH {PE}, {_digest_sql('a', 'points_e', _CONTENT)} SELECT h AS content_hash FROM a"


@query("digest_framing", "SELECT true AS differ")
def _(s, d):
    """Cells that run into one another, and nulls that look like values, have digests of their own."""
    a, b, c = (s.createDataFrame([(0, x, y)], "ordinal long, x string, y string") for x, y in (("a|b", "c"), ("a", "b|c"), ("a|b", None)))
    return _all_differ(s, [sp.content_digest(x, ["x", "y"]) for x in (a, b, c, b.withColumn("y", F.lit("~")))])


def _all_differ(s, digests):
    out = digests[0]
    for x in digests[1:]:
        out = out.unionByName(x)
    return out.agg((F.countDistinct("content_hash") == len(digests)).alias("differ"))


_HITS = f"{PE}, {WE}, {RR}, {_SNAP.format(n=3)}, ws AS (SELECT s.*, w.x, w.y, w.z FROM snap s JOIN (SELECT ordinal, x, y, z FROM world_e) w USING (ordinal)), hit AS (SELECT * FROM ws WHERE {_box(BOX_E)} AND classification = 2)"
_MET = " AND ".join(f"max_{c} >= {lo} AND min_{c} <= {hi}" for c, lo, hi in zip("xyz", BOX_E.low, BOX_E.high, strict=True))


@query("point_set_hashes", f"WITH {_HITS}, {_BLOCKS.format(t='world_e').replace('4096', '256')}, {_digest_sql('dg_i', 'hit', ['ordinal'])}, {_digest_sql('dg_c', 'hit', _CONTENT)} SELECT (SELECT CAST(sum(point_count) AS BIGINT) FROM blocks WHERE {_MET}) AS candidate_count, (SELECT count(*) FROM hit) AS exact_count, (SELECT h FROM dg_i) AS point_id_hash, (SELECT h FROM dg_c) AS content_hash")
def _(s, d):
    snap = workspace.snapshot(*_edited(s, d), 3)
    return point_set.terminal_summary(snap, workspace.query(snap, TE, BOX_E, 2), BOX_E, TE, 256)


@query("span_facts", f"WITH {PE}, f AS (SELECT * FROM points_e WHERE ordinal BETWEEN 10 AND 24 OR ordinal BETWEEN 100 AND 104 OR ordinal BETWEEN 200 AND 249), {_digest_sql('i', 'f', ['ordinal'])} SELECT 3 AS spans, 70 AS points, (SELECT count(*) FROM f) AS found, (SELECT h FROM i) AS point_id_hash")
def _(s, d):
    return point_set.span_facts(views.points_e(s, d), sp.check_spans(SPANS, 10**9))


@query("point_set_stored", f"WITH {_HITS} SELECT ordinal, classification FROM hit")
def _(s, d):
    """Through the stored form: built, opened again and held against its facts."""
    snap = workspace.snapshot(*_edited(s, d), 3)
    folder = local_folder(s, "point-set")
    point_set.PointSet.build(s, folder, snap, "events", 3, TE, BOX_E, 2, 256)
    return point_set.PointSet.open(s, folder).rows().select("ordinal", "classification")


@query("revision_audit", f"""WITH {PE}, {WE}, {RR}, r AS (SELECT * FROM revision_rows JOIN world_e USING (ordinal) WHERE seq = 2), {_digest_sql('p', 'r', ['ordinal', 'tx', 'ty', 'tz'])}, t AS (SELECT before, after, count(*) AS n FROM r GROUP BY ALL)
SELECT (SELECT count(*) FROM r) AS changed_points, (SELECT string_agg(before || '>' || after || ':' || n, ',' ORDER BY before, after) FROM t) AS transitions, (SELECT h FROM p) AS position_hash, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM r""")
def _(s, d):
    p, r = _edited(s, d)
    out = audit.revision_audit(r.where("seq = 2"), p, TE)
    listed = F.array_join(F.transform("transitions", lambda t: F.concat(t.before.cast("string"), F.lit(">"), t.after.cast("string"), F.lit(":"), t.points.cast("string"))), ",")
    return out.withColumn("transitions", listed)


def _store(s, d):
    points = views.points_e(s, d)
    return points, store.build(s, local_folder(s, "index"), points, "events", TE, store.Recipe((), 256, 64))


@query("index_query", SQL["snapshot_box_rows"])
def _(s, d):
    points, found = _store(s, d)
    return points.join(found.query(BOX_E).select("ordinal"), "ordinal", "left_semi").select("ordinal", "tx", "ty", "tz", "classification")


@query("index_blocks", f"WITH {PE}, {WE}, {_BLOCKS.format(t='world_e').replace('4096', '256')} SELECT * FROM blocks")
def _(s, d):
    return _store(s, d)[1].table("blocks")


@query("index_node_read", f"WITH {PE}, {WE}, {_PRIO} SELECT ordinal, tx, ty, tz, x, y, z FROM prio JOIN (SELECT ordinal AS o, x, y, z FROM world_e) ON o = ordinal ORDER BY p, ordinal LIMIT 64")
def _(s, d):
    return _store(s, d)[1].read_node(0)


@query("index_leaf_read", f"WITH {PE}, {WE} SELECT ordinal, tx, ty, tz, x, y, z FROM world_e WHERE ordinal < 256")
def _(s, d):
    found = _store(s, d)[1]
    leaf = found.table("nodes").where("block_id = 0").first().node_id
    return found.read_node(leaf)


@query("index_sample_problems", "SELECT 0 AS problems")
def _(s, d):
    points, found = _store(s, d)
    return store.sample_problems(points, found.table("samples"), found.table("nodes"), found.recipe).agg(F.count("*").alias("problems"))


@query("index_resume", "SELECT 'frames' AS stopped, true AS same UNION ALL SELECT 'tree', true")
def _(s, d):
    """Builds that were cut off go on and end in the same manifest as one that wasn't."""
    points, whole = _store(s, d)
    rows = []
    for at in ("frames", "tree"):
        folder = local_folder(s, "index")
        try:
            store.build(s, folder, points, "events", TE, whole.recipe, stop_after=at)
        except PlumblineError:
            rows.append((at, store.build(s, folder, points, "events", TE, whole.recipe).manifest == whole.manifest))
    return s.createDataFrame(rows, "stopped string, same boolean")


@query("relative_positions", f"WITH {PE}, {WE} SELECT ordinal, CAST(CAST(x - 75.0 AS FLOAT) AS DOUBLE) AS rx, CAST(CAST(y - 1000000.0 AS FLOAT) AS DOUBLE) AS ry, CAST(CAST(z - 250.0 AS FLOAT) AS DOUBLE) AS rz FROM world_e")
def _(s, d):
    out = store.relative_positions(views.points_e(s, d).select("ordinal", *TE.columns()), (75.0, 1000000.0, 250.0))
    return out.select("ordinal", *[F.col(c).cast("double").alias(c) for c in ("rx", "ry", "rz")])


@query("orientation_far_ticks", "WITH e AS (SELECT event_id, user_id, event_id % 7 - 3 AS k FROM events), p AS (SELECT event_id, k, CAST(user_id AS HUGEINT) * 10000000000000000 AS u FROM e) SELECT event_id, CASE WHEN k * u > 0 THEN 1 WHEN k * u < 0 THEN -1 ELSE 0 END AS side FROM p")
def _(s, d):
    """c lies k ticks left of the line from (-u, -u) to (u, u), u up to 9.3 * 10^34."""
    u = F.col("user_id").cast("decimal(20,0)") * F.lit(10**16).cast("decimal(17,0)")
    k = F.col("event_id") % 7 - 3
    return s.read.parquet(f"{d}/events.parquet").select("event_id", g.orientation_sign(-u, -u, u, u, F.expr("event_id") * 0 + u, u + k, wide=True).cast("long").alias("side"))


@query("display_grey", f"WITH {PU} SELECT intensity, count(*) AS n, (intensity * 1311 * 255 + 32767) // 65535 AS grey, 255 AS alpha FROM points_u GROUP BY intensity")
def _(s, d):
    p = views.lines_unordered(s, d).groupBy("intensity").agg(F.count("*").alias("n"))
    return p.withColumn("c", g.grey(F.col("intensity") * 1311)).select("intensity", "n", F.col("c")[0].alias("grey"), F.col("c")[3].alias("alpha"))


@query("operation_outcomes", "SELECT * FROM (VALUES ('again', 'committed', NULL), ('other_points', 'rejected', 'OperationConflict'), ('other_value', 'rejected', 'OperationConflict'), ('revert', 'committed', NULL), ('stale', 'rejected', 'StaleHead')) v(step, state, reason)")
def _(s, d):
    p = views.points_e(s, d)
    w = workspace.Workspace.create(s, local_folder(s, "workspace"), p, "events", TE)
    first = workspace.query(p, TE, BOX_E)
    w.set_classification("a", first, 9, 0)
    steps = {
        "again": w.set_classification("a", first, 9, 0),
        "other_points": w.set_classification("a", workspace.query(p, TE, None, 1), 9, 0),
        "other_value": w.set_classification("a", first, 8, 0),
        "stale": w.set_classification("b", first, 8, 0),
        "revert": w.revert_head("c", 1),
    }
    w.close()
    return s.createDataFrame([(k, v.state, v.reason) for k, v in steps.items()], "step string, state string, reason string")


@query("surface_warm_open", "SELECT * FROM (VALUES ('built', true), ('opened', true)) v(disposition, sound)")
def _(s, d):
    """Points in general position under a scale that differs by axis: built, opened again, and sound both times."""
    points = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("ordinal"), F.expr("s_suppkey * 7919 % 1009").alias("tx"), F.expr("s_suppkey * 104729 % 997").alias("ty"), F.round("s_acctbal").cast("long").alias("tz"), F.lit(2).cast("long").alias("classification"))
    t, folder = Transform((0.0, 0.0, 0.0), (0.25, 1.0, 0.1)), local_folder(s, "surfaces")
    made = [surfaces.prepare(s, folder, points, "suppliers", surfaces.Recipe(), t, SpatialReference(32647, 5703)) for _ in range(2)]
    sound = [not any(r.n for r in terrain.surface_violations(m.vertices, m.faces, t.scale[:2]).collect()) for m in made]
    return s.createDataFrame([(m.disposition, ok) for m, ok in zip(made, sound, strict=True)], "disposition string, sound boolean")


QUERIES = Q
ORACLE_SQL = SQL
