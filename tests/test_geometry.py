"""Exact predicates beyond 64 bits."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from plumbline.functions import geometry as g


def side(ax, ay, bx, by, cx, cy):
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def test_orientation_of_wide_ticks(spark):
    rnd, rows = random.Random(5), []
    for digits in (1, 13, 14, 19, 26, 27, 35, 37):
        top = 10**digits // 2
        for _ in range(8):
            rows.append([rnd.randint(-top, top) for _ in range(6)])
            u = rnd.randint(1, top // 4 + 1)
            rows += [[-u, -u, u, u, u, u + k] for k in (-1, 0, 1)]
            x, y, m = (rnd.randint(-top, top) // 50 for _ in range(3))
            rows.append([x, y, x + 3 * m, y - 5 * m, x + 9 * m, y - 15 * m + rnd.choice((-1, 0, 1))])
    names = [f"{a}{b}" for a in "abc" for b in "xy"]
    df = spark.createDataFrame([(i, *map(Decimal, r)) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{n} decimal(38,0)" for n in names))
    got = {r.i: r.s for r in df.select("i", g.orientation_sign(*map(F.col, names), wide=True).alias("s")).collect()}
    assert got == {i: side(*r) for i, r in enumerate(rows)}


def test_far_ticks_query_beyond_64_bits(spark, tmp_path):
    from plumbline.queries import QUERIES

    rows = [(i, u) for i, u in enumerate([0, 1, 922, 923, 1499, 90_000, 2**63 - 1, -5, -(2**63), None] * 7)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    sign = lambda v: (v > 0) - (v < 0)
    got = {r.event_id: r.side for r in QUERIES["orientation_far_ticks"](spark, str(tmp_path)).collect()}
    assert got == {i: 0 if u is None else sign(u * (i % 7 - 3)) for i, u in rows}
