"""Mirrors: the order of things in a hand-made room, and random rooms against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

SURFACE = "plan_id long, surface string, x1 double, y1 double, x2 double, y2 double, reflectance double"
WALL = "plan_id long, surface string, x1 double, y1 double, x2 double, y2 double"


def exposed(spark, eye, reflectance, partition=None):
    from glyphmill.operators import reflection as M

    s = spark.createDataFrame([(1, "left", 0.0, 0.0, 0.0, 6.0, reflectance)], SURFACE)
    o = s.drop("reflectance").union(spark.createDataFrame([(1, "partition", *map(float, partition))] if partition else [], WALL))
    e, inside = spark.createDataFrame([(1, *eye)], "plan_id long, px double, py double"), spark.createDataFrame([(1, 5.0, 3.0)], "plan_id long, ix double, iy double")
    return M.self_exposure(e, M.self_images(e, s, inside, o)).first()


def test_orderings(spark):
    near, far, matte, hidden, behind = exposed(spark, (1.0, 3.0), 0.8), exposed(spark, (4.0, 3.0), 0.8), exposed(spark, (2.0, 3.0), 0.03), exposed(spark, (2.0, 3.0), 0.8, (1, 0, 1, 6)), exposed(spark, (-2.0, 3.0), 0.8)
    assert near["self_exposure"] > far["self_exposure"] > matte["self_exposure"] == 0 and near["nearest_image_distance"] == 2.0 < far["nearest_image_distance"]
    assert near["self_exposure_index"] == pytest.approx(1 - math.exp(-0.8 * 1.7 / 2 / 0.6)) and hidden["n_self_images"] == behind["n_self_images"] == matte["n_self_images"] == 0
    assert exposed(spark, (2.0, 7.0), 0.8)["n_self_images"] == 0 and exposed(spark, (2.0, 3.0), 0.8, (1, 3.5, 1, 6))["n_self_images"] == 1


def test_around_a_partition(spark):
    from glyphmill.operators import reflection as M

    s = spark.createDataFrame([(1, "back", 10.0, 6.0, 0.0, 6.0, 0.8)], SURFACE)
    o = s.drop("reflectance").union(spark.createDataFrame([(1, None, 5.0, 0.0, 5.0, 4.0)], WALL))
    target, observer, inside = spark.createDataFrame([(1, 3.0, 5.0)], "plan_id long, px double, py double"), spark.createDataFrame([(1, 7.0, 5.0)], "plan_id long, ox double, oy double"), spark.createDataFrame([(1, 5.0, 3.0)], "plan_id long, ix double, iy double")
    assert M.reflected_fraction(M.seen_by_reflection(target, observer, s, inside, o)).first()["n_reflected"] == 1
    higher = s.drop("reflectance").union(spark.createDataFrame([(1, None, 4.9, 0.0, 4.9, 6.0)], WALL))
    assert M.reflected_fraction(M.seen_by_reflection(target, observer, s, inside, higher)).first()["n_reflected"] == 0
    dull = s.withColumn("reflectance", F.lit(0.04))
    assert M.reflected_fraction(M.seen_by_reflection(target, observer, dull, inside, o)).first()["reflected_fraction"] == 0


def test_reflectance(spark):
    from glyphmill.operators.reflection import reflectance

    df = spark.createDataFrame([("dark_glass",), ("mirror_glass",), ("plaster_matte",), ("0.42",), ("7",), ("-1",), ("unheard of",), (None,), ("polished_stone",)], "m string")
    assert [r[0] for r in df.select(reflectance(F.col("m"))).collect()] == [0.8, 0.8, 0.03, 0.42, 1.0, 0.0, 0.05, None, 0.35]


def turn(p, a, b):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def meets(p, q, a, b):
    return (turn(p, a, b) > 0) != (turn(q, a, b) > 0) and (turn(a, p, q) > 0) != (turn(b, p, q) > 0)


def free(p, q, walls, skip):
    mid = [(p[i] + q[i]) / 2 for i in (0, 1)]
    u, v = ([e[i] + (mid[i] - e[i]) * 1e-6 for i in (0, 1)] for e in (p, q))
    return not any(meets(u, v, w[1:3], w[3:5]) for w in walls if w[0] is None or w[0] != skip)


def test_blocked_lines_of_any_slope(spark):
    """The grid loses no crossing: steep, flat, long, short and negative segments, on and off cell borders."""
    from glyphmill.operators.reflection import unblocked

    rng = random.Random(5)
    some = lambda: rng.choice([rng.uniform(-9, 9), float(rng.randint(-9, 9)), rng.randint(-18, 18) / 2])
    lines = [(k, *(some() for _ in range(4)), rng.choice(["s1", None])) for k in range(300)] + [(900 + k, 1.0, some(), 1.0, some(), None) for k in range(20)]
    walls = [(rng.choice(["s1", "s2", None]), *(some() for _ in range(2))) for _ in range(12)]
    walls = [(n, x, y, x + rng.uniform(-2, 2), y + rng.uniform(-2, 2)) for n, x, y in walls] + [(None, 1.0, -3.0, 1.0, 4.0), ("s2", -8.0, 2.0, 8.0, 2.0)]
    a = spark.createDataFrame([(1, k, *c, s) for k, *c, s in lines], "plan_id long, k long, ax double, ay double, bx double, by double, skip string")
    b = spark.createDataFrame([(1, *w) for w in walls] + [(2, None, -9.0, -9.0, 9.0, 9.0)], WALL)
    want = sorted(k for k, ax, ay, bx, by, s in lines if free((ax, ay), (bx, by), walls if s else [(None, *w[1:]) for w in walls], s))
    assert 20 < len(want) < 300
    for side in (0.5, 1.0, 3.7):
        assert sorted(r["k"] for r in unblocked(a, b, ["k"], side).collect()) == want


def test_random_rooms(spark):
    from glyphmill.operators import reflection as M

    rng = random.Random(7)
    corners, walls, eyes, observers = [], [], [], []
    for plan in range(4):
        for k, (x, y) in enumerate([(0, 0), (9, 0), (9, 5), (4, 5), (4, 8), (0, 8)]):
            corners.append((plan, k, float(x), float(y), rng.choice(["mirror", "dark_glass", "0.3", "brick", "glossy_paint"])))
        walls += [(plan, None, x, y, x + rng.uniform(-2, 2), y + rng.uniform(-2, 2)) for x, y in ((rng.uniform(1, 8), rng.uniform(1, 4)) for _ in range(3))]
        eyes += [(plan, rng.uniform(0.5, 3.5), rng.uniform(0.5, 7.5)) for _ in range(8)]
        observers += [(plan, rng.uniform(0.5, 8.5), rng.uniform(0.5, 4.5)) for _ in range(5)]
    c = spark.createDataFrame(corners, "plan_id long, k int, x double, y double, material string")
    surfaces, inside = M.room_surfaces(c), M.interior_points(c)
    o = surfaces.drop("reflectance").unionByName(spark.createDataFrame(walls, WALL))
    e, v = spark.createDataFrame(eyes, "plan_id long, px double, py double"), spark.createDataFrame(observers, "plan_id long, ox double, oy double")
    held = {}
    for r in surfaces.collect():
        held.setdefault(r["plan_id"], []).append((r["surface"], r["x1"], r["y1"], r["x2"], r["y2"], r["reflectance"]))
    middle = {r["plan_id"]: (r["ix"], r["iy"]) for r in inside.collect()}
    own, seen = {}, {}
    for plan, x, y in eyes:
        block = [s[:5] for s in held[plan]] + [w[1:] for w in walls if w[0] == plan]
        for n, x1, y1, x2, y2, shine in held[plan]:
            a, b, p = (x1, y1), (x2, y2), (x, y)
            long2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / long2
            foot = (x1 + t * (x2 - x1), y1 + t * (y2 - y1))
            facing = lambda q, a=a, b=b, plan=plan: turn(middle[plan], a, b) * turn(q, a, b) >= 0
            if shine >= 0.06 and 0 <= t <= 1 and facing(p) and free(p, foot, block, n):
                own[plan, x, y, n] = shine * 1.7 / (2 * math.dist(p, foot))
            image = (2 * foot[0] - x, 2 * foot[1] - y)
            for q, ox, oy in observers:
                if q != plan:
                    continue
                at = (ox, oy)
                seen.setdefault((plan, x, y, ox, oy), False)
                if shine >= 0.05 and facing(p) and facing(at) and meets(at, image, a, b):
                    s = turn(at, a, b) / (turn(at, a, b) - turn(image, a, b))
                    hit = (ox + s * (image[0] - ox), oy + s * (image[1] - oy))
                    seen[plan, x, y, ox, oy] |= free(at, hit, block, n) and free(hit, p, block, n)
    got = {(r["plan_id"], r["px"], r["py"], r["surface"]): r["intensity"] for r in M.self_images(e, surfaces, inside, o).collect()}
    assert got == pytest.approx(own) and own
    assert {tuple(r)[:5]: r[5] for r in M.seen_by_reflection(e, v, surfaces, inside, o).collect()} == seen and any(seen.values())


@pytest.mark.parametrize("name", ["geo16_self_images", "geo16_self_exposure", "geo16_reflected"])
def test_rows_are_dealt_by_plan_once(spark, name):
    """No line is laid over cells or shuffled again by its own key; the rows of a plan meet where they are."""
    from glyphmill.plans import load
    from glyphmill.plans.catalog import QUERIES

    load()
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1] for line in plan.split("\n") if "hashpartitioning(" in line]
    assert "sequence(" not in plan and dealt and not [line for line in dealt if "px#" in line.split("plan_id=")[0]]


def test_without_a_grid_as_with_one(spark):
    from glyphmill.operators.reflection import unblocked

    rng = random.Random(9)
    lines = [(plan, k, *(rng.uniform(-9, 9) for _ in range(4)), rng.choice(["s1", None])) for plan in (1, 2, 3) for k in range(100)]
    walls = [(rng.choice(["s1", "s2", None]), *(rng.uniform(-9, 9) for _ in range(4))) for _ in range(3)]
    a = spark.createDataFrame(lines, "plan_id long, k long, ax double, ay double, bx double, by double, skip string")
    b = spark.createDataFrame([(plan, *w) for plan in (1, 2) for w in walls], WALL)
    want = sorted((plan, k) for plan, k, *c, s in lines if free(c[:2], c[2:], [] if plan == 3 else walls if s else [(None, *w[1:]) for w in walls], s))
    assert 100 < len(want) < 300
    for side in (None, 1.0):
        assert sorted((r["plan_id"], r["k"]) for r in unblocked(a, b, ["plan_id", "k"], side).collect()) == want
