"""Paths and detection in plans against a plain search, numbering and replacement chains."""

import heapq
import math
import random

import numpy as np
import pytest

from glyphmill.operators import geometry as G
from glyphmill.operators import refuge as R
from glyphmill.operators import registry as T
from glyphmill.runtime import numbered


def plan_of(seed, w=7, h=6):
    rng = random.Random(seed)
    return {(x, y): rng.random() < 0.3 for x in range(w) for y in range(h)}


def visible(plan, a, b):
    walls = np.array([[plan[(x, y)] for x in range(7)] for y in range(6)])
    return G.line_of_sight(walls, a, b)


def search(plan, origin, penalty=6.0):
    """Cost of each free cell from the edge, and the distance of the first unseen cell on the way out."""
    step = {c: 1 + (penalty if visible(plan, origin, c) else 0) for c, wall in plan.items() if not wall}
    cost = {c: s for c, s in step.items() if c[0] in (0, 6) or c[1] in (0, 5)}
    todo = [(v, c) for c, v in cost.items()]
    heapq.heapify(todo)
    while todo:
        d, (x, y) = heapq.heappop(todo)
        for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if c in step and d + step[c] < cost.get(c, math.inf):
                cost[c] = d + step[c]
                heapq.heappush(todo, (cost[c], c))
    if origin not in cost:
        return cost, None
    at = origin
    while visible(plan, origin, at):
        near = [(cost[c], c) for c in ((at[0] + 1, at[1]), (at[0] - 1, at[1]), (at[0], at[1] + 1), (at[0], at[1] - 1)) if cost.get(c, math.inf) < cost[at]]
        if not near:
            break
        at = min(near)[1]
    return cost, math.hypot(at[0] - origin[0], at[1] - origin[1])


def test_paths_and_detection(spark):
    plans = {k: plan_of(k) for k in range(6)}
    origins = {k: min(c for c, wall in p.items() if not wall and 1 < c[0] < 5) for k, p in plans.items()}
    rows = [(k, *c, wall) for k, p in plans.items() for c, wall in p.items()]
    plan = spark.createDataFrame(rows, "plan_id int, x int, y int, wall boolean")
    lines = R.sight_lines(spark.createDataFrame([(k, *c) for k, c in origins.items()], "plan_id int, ox int, oy int"), plan)
    assert {(r.plan_id, r.x, r.y): r.visible for r in lines.collect()} == {(k, *c): visible(p, origins[k], c) for k, p in plans.items() for c, wall in p.items() if not wall}
    costs = R.least_exposed_paths(lines, R.entrances(plan))
    want = {k: search(p, origins[k]) for k, p in plans.items()}
    assert {(r.plan_id, r.x, r.y): r.cost for r in costs.collect()} == {(k, *c): v for k, (cost, _) in want.items() for c, v in cost.items()}
    got = {r.plan_id: r.first_detection for r in R.first_detection(lines, costs).collect()}
    assert got == {k: pytest.approx(d) for k, (_, d) in want.items() if d is not None}


def test_numbers_over_partitions(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "a int").repartition(7)
    assert sorted((r.a, r.n) for r in numbered(df, ["a"], "n").collect()) == [(i, i + 1) for i in range(101)]


def test_cycles_of_any_length(spark):
    chain = [(f"t{i}", f"t{i + 1}") for i in range(60)] + [("t60", "t20"), ("s", "s"), ("x", "y"), ("y", None)]
    got = {r.tag_id for r in T.replacement_cycles(spark.createDataFrame(chain, "tag_id string, replaced_by string")).collect()}
    assert got == {f"t{i}" for i in range(20, 61)} | {"s"}


def test_records_of_several_files(spark, tmp_path):
    from glyphmill.sources.files import read_record_yaml

    (tmp_path / "a.yml").write_text("head: 1\n- id: a\n  k: 1\n  k: 2\n- id: b\n")
    (tmp_path / "b.yml").write_text("- id: c\n  k: 3\n")
    got = sorted((r.file.rsplit("/", 1)[1], r.record, sorted(r.fields.items())) for r in read_record_yaml(spark, f"file://{tmp_path}").collect())
    assert got == [("a.yml", 1, [("id", "a"), ("k", "2")]), ("a.yml", 2, [("id", "b")]), ("b.yml", 1, [("id", "c"), ("k", "3")])]
