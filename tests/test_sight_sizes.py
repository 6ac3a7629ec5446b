"""Plans of several sizes at once, graphs by matrices and by joins, and work that doesn't grow with rays."""

import random

from glyphmill.operators import refuge as R
from glyphmill.operators import sight as S


def rows_of(rng, k, w, h, share):
    return [(k, x, y, rng.random() < share) for y in range(h) for x in range(w) if rng.random() < 0.95 or (x, y) == (w - 1, h - 1)]


def lattice(spark, seed=5):
    rng = random.Random(seed)
    rows = [r for k in range(24) for r in rows_of(rng, k, *rng.choice([(8, 8), (5, 9), (1, 6), (3, 3)]), rng.choice([0.2, 0.5]))]
    return rows, spark.createDataFrame(rows, "plan_id long, x int, y int, wall boolean")


def test_grids_fill_what_is_missing(spark):
    rows, plan = lattice(spark)
    size = {k: (max(r[1] for r in rows if r[0] == k) + 1, max(r[2] for r in rows if r[0] == k) + 1) for k in {r[0] for r in rows}}
    free = {r[:3] for r in rows if not r[3]}
    twice = plan.unionByName(plan.withColumn("wall", plan.wall | (plan.x == 0)))
    for p in (plan, twice):
        got = {r.plan_id: (r.w, r.h, r.free) for r in S.grids(p).collect()}
        assert got == {k: (w, h, [(k, i % w, i // w) in free for i in range(w * h)]) for k, (w, h) in size.items()}


def test_graph_by_matrices_and_by_joins(spark):
    _, plan = lattice(spark)
    some = plan.where("plan_id < 6")
    key = lambda df: sorted((r.plan_id, r.x, r.y, r.connectivity, *(None if v is None else round(v, 9) for v in r[4:])) for r in df.collect())
    assert key(S.visibility_graph(some)) == key(S.visibility_graph(some, small=12)) != []


def test_origins_outside_and_on_walls(spark):
    plan = spark.createDataFrame([(1, x, y, (x, y) == (1, 1)) for x in range(3) for y in range(2)], "plan_id long, x int, y int, wall boolean")
    origins = spark.createDataFrame([(1, 9, 0), (1, 1, 1), (1, 0, 0), (1, 0, 0), (2, 0, 0)], "plan_id long, ox int, oy int")
    assert {tuple(r) for r in S.seen_cells(origins, plan).collect() if (r.ox, r.oy) != (0, 0)} == {(1, 1, 1, 1, 1)}
    marked = R.masks(origins, plan).collect()
    assert len(marked) == 4 * 5 and not any(r.visible for r in marked if (r.ox, r.oy) != (0, 0))
    assert S.isovists(origins, plan).count() == 3


def test_isovists_in_time(spark):
    """Every free cell of 400 plans: sample by sample in the JVM this takes minutes."""
    import time

    plan = spark.createDataFrame([(k, x, y, (x * 7 + y * 3 + k) % 11 == 0) for k in range(400) for x in range(8) for y in range(8)], "plan_id long, x int, y int, wall boolean")
    t = time.monotonic()
    found = S.isovists(plan.where("not wall").selectExpr("plan_id", "x ox", "y oy"), plan)
    assert found.where("area > 0").count() == plan.where("not wall").count() and time.monotonic() - t < 60
