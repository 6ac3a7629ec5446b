"""Sight in hand-made plans against plain loops over rays, samples and queues."""

import math
from collections import deque

import pytest

from glyphmill.operators import geometry as G
from glyphmill.operators import refuge as R
from glyphmill.operators import sight as S

PLANS = {
    1: ["......", "......", "......", "......"],
    2: ["########", "#..#...#", "#..#...#", "#......#", "#..#...#", "########"],
    3: [".....", "##.##", ".....", "#####", "....."],
    4: ["#.#", "###", "#.#"],
    5: [".#......", "...#..#.", ".#....#.", "....##..", ".#......", "...#...#"],
}


@pytest.fixture(scope="module")
def plans(spark):
    return spark.createDataFrame([(k, x, y, c == "#") for k, p in PLANS.items() for y, row in enumerate(p) for x, c in enumerate(row)], "plan_id long, x int, y int, wall boolean").cache()


def free(p):
    return [(x, y) for y, row in enumerate(p) for x, c in enumerate(row) if c == "."]


def inside(p, x, y):
    return 0 <= x < len(p[0]) and 0 <= y < len(p)


def clear(p, a, b):
    n = 2 * max(abs(b[0] - a[0]), abs(b[1] - a[1])) + 1
    return all(p[int(a[1] + (b[1] - a[1]) * (i / n))][int(a[0] + (b[0] - a[0]) * (i / n))] == "." for i in range(n + 1))


def ray(p, o, angle, start):
    """Samples of a ray and how it ended: wall, out or none."""
    d, far, way = start, math.hypot(len(p), len(p[0])), []
    while d <= far:
        x, y = o[0] + math.cos(angle) * d, o[1] + math.sin(angle) * d
        if not inside(p, x, y):
            return way, d, "out"
        if p[int(y)][int(x)] == "#":
            return way, d, "wall"
        way.append((int(x), int(y)))
        d += 0.5
    return way, d, "none"


@pytest.fixture(scope="module")
def origins(plans):
    return plans.where("not wall").selectExpr("plan_id", "x as ox", "y as oy")


def test_lines(plans, origins):
    got = {tuple(r)[:5]: r.visible for r in R.sight_lines(origins, plans).collect()}
    assert got == {(k, *a, *b): clear(p, a, b) for k, p in PLANS.items() for a in free(p) for b in free(p)}
    assert {got[2, 1, 1, 5, 1], got[2, 1, 3, 6, 3]} == {False, True}


def test_masks(plans, origins):
    got = {tuple(r) for r in S.seen_cells(origins, plans).collect()}
    want = {(k, *o, *c) for k, p in PLANS.items() for o in free(p) for i in range(1440) for c in [o, *ray(p, o, i * (2 * math.pi / 1440), 0.0)[0]]}
    assert got == want
    marked = {tuple(r)[:5] for r in R.masks(origins, plans).where("visible").collect()}
    assert marked == got


def test_isovists(plans, origins):
    n = 720
    for r in S.isovists(origins, plans).collect():
        p, o = PLANS[r.plan_id], (r.ox, r.oy)
        found = [ray(p, o, i * (2 * math.pi / n), 0.5) for i in range(n)]
        d, solid = [f[1] for f in found], [f[2] == "wall" for f in found]
        hit = [(o[0] + math.cos(i * 2 * math.pi / n) * d[i], o[1] + math.sin(i * 2 * math.pi / n) * d[i]) for i in range(n)]
        area = sum(a * b for a, b in zip(d, d[1:] + d[:1], strict=True)) * math.sin(2 * math.pi / n) / 2
        length = [math.dist(a, b) for a, b in zip(hit, hit[1:] + hit[:1], strict=True)]
        occluding = sum(v for i, v in enumerate(length) if abs(d[i] - d[(i + 1) % n]) > 3 or not (solid[i] and solid[(i + 1) % n]))
        mean = sum(d) / n
        var = sum((v - mean) ** 2 for v in d) / n
        want = {
            "area": area, "perimeter": sum(length), "occlusivity": occluding, "real_surface_perimeter": sum(length) - occluding, "min_radial": min(d), "max_radial": max(d), "mean_radial": mean, "radial_variance": var,
            "radial_skewness": sum((v - mean) ** 3 for v in d) / n / var**1.5 if var > 0 else 0.0, "compactness": 4 * math.pi * area / sum(length) ** 2, "circularity": 4 * math.pi * area / sum(length) ** 2, "elongation": max(d) / min(d),
            "jaggedness": sum(length) ** 2 / area, "drift_magnitude": math.dist((sum(h[0] for h in hit) / n, sum(h[1] for h in hit) / n), o), "dispersion": math.sqrt(var) / mean, "closed": all(solid),
        }
        for c, v in want.items():
            assert r[c] == pytest.approx(v, abs=1e-6), (c, r.plan_id, o)


def test_graph(plans):
    got = {(r.plan_id, r.x, r.y): r for r in S.visibility_graph(plans).collect()}
    assert set(got) == {(k, *c) for k, p in PLANS.items() for c in free(p)}
    for k, p in PLANS.items():
        cells = free(p)
        near = {a: {b for b in cells if b != a and clear(p, min(a, b, key=lambda c: c[::-1]), max(a, b, key=lambda c: c[::-1]))} for a in cells}
        for a in cells:
            depth, queue = {a: 0}, deque([a])
            while queue:
                u = queue.popleft()
                for v in near[u] - depth.keys():
                    depth[v] = depth[u] + 1
                    queue.append(v)
            n, m = len(cells), sum(depth.values()) / (len(depth) - 1) if len(depth) > 1 else None
            r, deg = got[k, *a], len(near[a])
            assert r.connectivity == deg and r.mean_depth == (pytest.approx(m) if m is not None else None)
            norm = 2 * (n * (math.log2((n + 2) / 3) - 1) + 1) / ((n - 1) * (n - 2)) if n > 2 else 0
            assert r.integration == pytest.approx(norm / (2 * (m - 1) / (n - 2)) if n > 2 and m and m > 1 else 0.0)
            links = sum(b in near[c] for b in near[a] for c in near[a])
            assert r.clustering == pytest.approx(links / (deg * (deg - 1)) if deg > 1 else 0.0)
    told = {r.plan_id: r.intelligibility for r in G.intelligibility(S.visibility_graph(plans)).collect()}
    assert told[1] == told[4] == 0.0 and 0 < told[2] <= 1 + 1e-9
    half = S.visibility_graph(plans, stride=2)
    assert half.where("x % 2 + y % 2 > 0").isEmpty() and not half.isEmpty()


def test_no_plans(plans):
    none = plans.limit(0)
    assert S.visibility_graph(none).isEmpty() and S.isovists(none.selectExpr("plan_id", "x ox", "y oy"), none).isEmpty()
