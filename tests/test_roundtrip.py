"""Round trips hold tables of any size: none of their joins may send one through the driver."""

from plumbline.operators import roundtrip


def sides(spark):
    ref = spark.range(1, 41).selectExpr("id", "CAST(id AS DOUBLE) AS x", "0.0D AS y", "0.0D AS z")
    return ref, ref.where("id <> 7").selectExpr("id + 1000 AS id", "x + 0.125D * (id % 4) AS x", "y", "z")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_match_shuffles_both_sides(spark):
    m = roundtrip.match_within(*sides(spark), 0.25, 0.3)
    got = {(r.ref_id, r.ret_id, r.d_plan) for r in m.collect()}
    assert got == {(i, i + 1000, 0.125 * (i % 4)) for i in range(1, 41) if i % 4 < 3 and i != 7}
    assert "Broadcast" not in plan(m)


def test_problems_shuffle_both_sides(spark):
    ref, ret = sides(spark)
    p = roundtrip.match_problems(roundtrip.match_within(ref, ret, 0.25, 0.3), ref, ret)
    lone = {i for i in range(1, 41) if i % 4 == 3}
    assert {tuple(r) for r in p.collect()} == {("reference", i, 0) for i in lone} | {("returned", i + 1000, 0) for i in lone - {7}}
    assert "Broadcast" not in plan(p)
