"""Regions, edges, lines and walls against plain loops."""

from __future__ import annotations

import math
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F


def flood(cells, diagonal=False):
    """Regions of a set of (x, y), numbered by their first pixel, row by row."""
    left, out, n = set(cells), {}, 0
    for x, y in sorted(cells, key=lambda c: (c[1], c[0])):
        if (x, y) not in left:
            continue
        n += 1
        left.discard((x, y))
        todo = deque([(x, y)])
        while todo:
            a, b = todo.popleft()
            out[a, b] = n
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    if (diagonal or not dx or not dy) and (a + dx, b + dy) in left:
                        left.discard((a + dx, b + dy))
                        todo.append((a + dx, b + dy))
    return out


def spiral(n):
    """A one-pixel corridor that winds inwards: its length is about half the area."""
    cells, x, y, dx, dy = {(0, 0)}, 0, 0, 1, 0
    for _ in range(n * n):
        ahead, beyond = (x + dx, y + dy), (x + 2 * dx, y + 2 * dy)
        if not (0 <= ahead[0] < n and 0 <= ahead[1] < n) or beyond in cells:
            dx, dy = -dy, dx
            if (x + 2 * dx, y + 2 * dy) in cells:
                break
            continue
        x, y = ahead
        cells.add(ahead)
    return cells


@pytest.mark.parametrize("diagonal", [False, True])
def test_regions(spark, diagonal):
    from glyphmill.operators.regions import region_sizes, regions, unfolded

    rng = random.Random(1)
    masks = {k: {(x, y) for x in range(14) for y in range(11) if rng.random() < share} for k, share in enumerate((0.2, 0.4, 0.55, 0.7, 1.0))}
    masks |= {10: {(3, 3)}, 11: spiral(30), 12: {(x, x) for x in range(9)}, None: {(0, 0), (2, 0)}}
    rows = [(k, x, y) for k, m in masks.items() for x, y in m]
    df = spark.createDataFrame(rows + rows[:20], "image_id int, x int, y int")
    found = regions(df.where("image_id IS NOT NULL"), "image_id", diagonal)
    got = {(r[0], r[1], r[2]): r[3] for r in unfolded(found, "image_id").collect()}
    assert got == {(k, x, y): n for k, m in masks.items() if k is not None for (x, y), n in flood(m, diagonal).items()}
    sizes = Counter((k, n) for (k, _, _), n in got.items())
    assert {(r["image_id"], r["region"]): r["size"] for r in region_sizes(found, "image_id").collect()} == sizes
    assert regions(df.limit(0), "image_id", diagonal).count() == 0


def test_reached(spark):
    from glyphmill.operators.regions import reached

    rng = random.Random(2)
    cells = {(x, y): rng.random() < 0.1 for x in range(20) for y in range(20) if rng.random() < 0.35}
    of = flood(cells, True)
    seeded = {of[c] for c, s in cells.items() if s}
    df = spark.createDataFrame([(7, x, y, s) for (x, y), s in cells.items()], "k int, x int, y int, s boolean")
    assert {(r[1], r[2]) for r in reached(df, "k", "s").collect()} == {c for c in cells if of[c] in seeded}


def brute_edges(g, w, h, low=50, high=150):
    at = lambda x, y: g[min(max(y, 0), h - 1) * w + min(max(x, 0), w - 1)]
    grad = {}
    for y in range(h):
        for x in range(w):
            grad[x, y] = (sum(k * (at(x + 1, y + d) - at(x - 1, y + d)) for d, k in ((-1, 1), (0, 2), (1, 1))), sum(k * (at(x + d, y + 1) - at(x + d, y - 1)) for d, k in ((-1, 1), (0, 2), (1, 1))))
    power = lambda x, y: sum(v * v for v in grad.get((x, y), (0, 0)))
    kept = {}
    for (x, y), (dx, dy) in grad.items():
        m, t = power(x, y), math.degrees(math.atan2(abs(dy), abs(dx)))
        if t < 22.5:
            best = m > power(x - 1, y) and m >= power(x + 1, y)
        elif t > 67.5:
            best = m > power(x, y - 1) and m >= power(x, y + 1)
        else:
            s = -1 if (dx < 0) != (dy < 0) else 1
            best = m > power(x - s, y - 1) and m > power(x + s, y + 1)
        if best and m > low * low:
            kept[x, y] = m > high * high
    of = flood(kept, True)
    strong = {of[c] for c, s in kept.items() if s}
    return {c for c in kept if of[c] in strong}


def test_edges(spark):
    from glyphmill.operators.edges import edge_density, edge_pixels

    rng = random.Random(3)
    images = []
    for k in range(6):
        w, h = 16, rng.choice([1, 9, 12])
        wave = [[rng.randint(0, 255) if k < 2 else int(127 + 90 * math.sin(x / (2 + k)) * math.cos(y / 3) + rng.randint(-9, 9)) for x in range(w)] for y in range(h)]
        images.append((k, [v for row in wave for v in row]))
    images += [(20, [5] * 160), (21, [0] * 8 + [255] * 8 + [0] * 8 + [255] * 8), (22, [])]
    df = spark.createDataFrame(images, "id int, g array<int>")
    want = {k: brute_edges(g, 16, len(g) // 16) if g else set() for k, g in images}
    got = {k: set() for k, _ in images}
    for r in edge_pixels(df, "id", "g", 16).collect():
        got[r[0]].add((r[1], r[2]))
    assert got == want and sum(map(len, want.values())) > 100
    assert {r[0]: (r[1], r[2]) for r in edge_density(df, "id", "g", 16).collect()} == {k: (len(want[k]), len(want[k]) / len(g) if g else None) for k, g in images}


def test_lines(spark):
    from glyphmill.operators.edges import lines, votes

    cells = [(1, 12, y) for y in range(30)] + [(1, x, 25) for x in range(18)] + [(1, 3, 3), (2, 5, 5)]
    df = spark.createDataFrame(cells, "id int, x int, y int")
    angles = [math.radians(a) for a in range(0, 180, 15)]
    count = Counter((i, k, round(x * math.cos(a) + y * math.sin(a))) for i, x, y in cells for k, a in enumerate(angles))
    assert {(r[0], r[1], r[2]): r[3] for r in votes(df, "id", angles).collect()} == count
    got = [tuple(r) for r in lines(df, "id", angles, share=0.4).where("id = 1").orderBy("rank").collect()]
    assert got[0] == (1, 1, 0, 12, 31) and (1, 2, 6, 25, 19) in got


def slopes(g, w, h):
    at = lambda x, y: g[min(max(y, 0), h - 1) * w + min(max(x, 0), w - 1)]
    out = []
    for y in range(h):
        for x in range(w):
            dx = sum(k * (at(x + 1, y + d) - at(x - 1, y + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            dy = sum(k * (at(x + d, y + 1) - at(x + d, y - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            out.append(math.hypot(dx, dy))
    return out


def brute_walls(row, w, columns, area, jump=0.12, colour=20.0):
    wall, n = row["wall"], len(row["wall"])
    h = n // w
    xy = [(i % w, i // w) for i in range(n)]
    if not any(wall):
        return []
    if row["depth"] is None:
        own = [i for i in range(n) if wall[i]]
        return [(1, len(own), len(own) / n, 0.5, sum(xy[i][0] for i in own) / len(own), sum(xy[i][1] for i in own) / len(own), any(row["window"][i] for i in own), any(row["door"][i] for i in own), "wall.back", "wall.focal")]
    steep = slopes(row["depth"], w, h)
    cut = {xy[i] for i in range(n) if wall[i] and steep[i] > jump}
    kept = {c for i, c in enumerate(xy) if wall[i] and not any((c[0] + dx, c[1] + dy) in cut for dx in range(-2, 3) for dy in range(-2, 3) if abs(dx) + abs(dy) <= 2)}
    of = flood(kept)
    for column in columns:
        for k in sorted(set(of.values())):
            own = [c for c in of if of[c] == k]
            right = [c for c in own if c[0] >= column]
            if len(own) - len(right) > 0.2 * len(own) and len(right) > 0.2 * len(own):
                new = max(of.values()) + 1
                of |= dict.fromkeys(right, new)
    mean = lambda cells, k: sum(row[k][y * w + x] for x, y in cells) / len(cells)
    cells = {}
    for c, k in of.items():
        cells.setdefault(k, []).append(c)
    shade = {k: [mean(v, b) for b in "rgb"] for k, v in cells.items()}
    taken = set()
    for a in sorted(shade):
        for b in sorted(shade):
            if a in taken or b <= a or b in taken or math.dist(shade[a], shade[b]) >= colour:
                continue
            if any(abs(x - u) + abs(y - v) <= 3 for x, y in cells[a] for u, v in cells[b]):
                cells[a] += cells.pop(b)
                taken.add(b)
    parts = [cells[k] for k in sorted(cells)]
    large = [p for p in parts if len(p) >= area]
    depth = {id(p): mean(p, "depth") for p in parts}
    gets = {id(p): list(p) for p in parts}
    for p in parts:
        if len(p) < area and large:
            gets[id(min(large, key=lambda q: abs(depth[id(q)] - depth[id(p)])))] += p
            gets[id(p)] = []
    done = [gets[id(p)] for p in parts if gets[id(p)]]
    total = sum(map(len, done))
    out = [[k, len(p), len(p) / total, mean(p, "depth"), sum(c[0] for c in p) / len(p), sum(c[1] for c in p) / len(p), any(row["window"][y * w + x] for x, y in p), any(row["door"][y * w + x] for x, y in p)] for k, p in enumerate(done, 1)]
    back = max((o for o in out if o[2] > 0.15), key=lambda o: (o[3], o[1], -o[0]), default=None)
    focal = next((o for o in out if o[6]), out[0] if out else None)
    return [(*o, "wall.back" if o is back else "wall.left" if o[4] < w / 2 * 0.7 else "wall.right" if o[4] > w / 2 * 1.3 else "wall.center", "wall.focal" if o is focal else "wall.flanking") for o in out]


def test_walls(spark):
    """Random rooms of 40 x 40 with walls at different depths, patches of colour, and columns to part them at."""
    from glyphmill.operators.walls import wall_counts, walls

    rng = random.Random(9)
    w, h, rows, columns = 40, 40, [], []
    for k in range(12):
        cuts = sorted(rng.sample(range(5, 35), 3))
        level = [rng.choice([0.1, 0.3, 0.5, 0.9]) for _ in range(4)]
        tone = [rng.choice([60, 66, 70, 140]) for _ in range(4)]
        side = lambda x, cuts=cuts: sum(x >= c for c in cuts)
        gap = rng.random() * 0.12
        row = {
            "image_id": k, "wall": [rng.random() > gap for _ in range(w * h)], "depth": [level[side(i % w)] + rng.random() * 0.004 for i in range(w * h)], "r": [float(tone[side(i % w)] + rng.randint(0, 4)) for i in range(w * h)],
            "g": [float(tone[side(i % w)]) for i in range(w * h)], "b": [float(tone[side(i % w)] + (i // w > 25) * 30) for i in range(w * h)], "window": [i % w > 30 and i // w < 5 for i in range(w * h)], "door": [i == 1590 for i in range(w * h)],
        }
        if k == 4:
            row["depth"] = None
        if k == 5:
            row["wall"] = [False] * (w * h)
        if k == 6:
            row["depth"] = [0.5] * (w * h)
        rows.append(row)
        columns += [(k, j, c) for j, c in enumerate(rng.sample(range(1, 38), k % 4), 1)]
    schema = "image_id int, wall array<boolean>, depth array<double>, r array<double>, g array<double>, b array<double>, window array<boolean>, door array<boolean>"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    cols = spark.createDataFrame(columns, "image_id int, rank int, column int")
    for area in (150,):
        found = walls(df, "image_id", w, cols, area=area)
        got = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found.collect())
        want = sorted((r["image_id"], *(round(v, 6) if isinstance(v, float) else v for v in o)) for r in rows for o in brute_walls(r, w, [c for k, _, c in sorted(columns) if k == r["image_id"]], area))
        assert got == want
        assert {r[0]: r[1] for r in wall_counts(df, "image_id", found).collect()} == {r["image_id"]: sum(o[0] == r["image_id"] for o in want) for r in rows}
    assert walls(df.limit(0), "image_id", w).count() == 0


def test_corner_columns(spark):
    from glyphmill.operators.walls import corner_columns

    edges = spark.createDataFrame([(1, 12, y) for y in range(30)] + [(2, x, 9) for x in range(40)], "id int, x int, y int")
    assert [(r["id"], r["column"]) for r in corner_columns(edges, "id", 40, 30, around=0.0).where("rank = 1").collect()] == [(1, 12)]
    # about the horizontal, as by default, no line is upright enough
    assert corner_columns(edges, "id", 40, 30).count() == 0


def test_queries_agree(spark):
    """The registered walls of the smallest tables against the loops."""
    from glyphmill.plans import load
    from glyphmill.plans.catalog import QUERIES
    from glyphmill.plans.imaging import AREA, WIDTH, rooms

    load()
    d = "/root/testdata/sf0.001"
    rows = rooms(spark, d).limit(120).collect()
    want = sorted(((r["image_id"], *(pytest.approx(v, abs=1e-5) if isinstance(v, float) else v for v in o)) for r in rows for o in brute_walls(r, WIDTH, [], AREA)), key=lambda r: r[:2])
    ids = {r["image_id"] for r in rows}
    got = sorted(tuple(r) for r in QUERIES["mod09_walls"](spark, d).where(F.col("image_id").isin(*ids)).collect())
    assert got == want


def brute_merge(masks, thresh=0.3):
    """root of each mask, in order"""
    root = {}
    for i in sorted(masks):
        if i in root:
            continue
        root[i], cur = i, set(masks[i])
        for j in sorted(masks):
            if j > i and j not in root and len(cur & masks[j]) / len(cur | masks[j]) > thresh:
                cur |= masks[j]
                root[j] = i
    return root


def test_merged_masks(spark):
    """200 masks in 20 images, with chains that only merge because of what was merged before; repeated masks and pixels."""
    from glyphmill.operators.masks import merged, overlaps, widened

    rng = random.Random(6)
    masks = {}
    for image in range(20):
        for k in range(10):
            x, y, w, h = rng.randint(0, 14), rng.randint(0, 10), rng.randint(2, 9), rng.randint(2, 6)
            masks.setdefault(image, {})[k * 3 + rng.randint(0, 2)] = {(a, b) for a in range(x, x + w) for b in range(y, y + h)}
        masks[image][40] = set(masks[image][min(masks[image])])
    masks[99] = {5: {(0, 0)}}
    masks[100] = {k: {(a, 0) for a in range(2 * k, 2 * k + 4)} for k in range(6)}
    rows = [(i, m, *c) for i, own in masks.items() for m, cells in own.items() for c in cells]
    df = spark.createDataFrame(rows + rows[:30], "image_id int, mask int, x int, y int")
    want = {(i, m): r for i, own in masks.items() for m, r in brute_merge(own).items()}
    assert {(r["image_id"], r["mask"]): r["root"] for r in merged(df).collect()} == want and len(set(want.values())) > 10
    pairs = {(i, a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for i, own in masks.items() for a in own for b in own if a < b and own[a] & own[b]}
    assert {(r["image_id"], r["a"], r["b"]): r["overlap"] for r in overlaps(df.distinct()).collect()} == pytest.approx(pairs)
    wide = {(r["x"], r["y"]) for r in widened(spark.createDataFrame([(1, 1, 0, 0), (1, 1, 3, 2)], df.schema), 5, 4).collect()}
    assert wide == {(x, y) for x in range(5) for y in range(4) if max(x, y) <= 2 or (abs(x - 3) <= 2 and abs(y - 2) <= 2)}
    assert merged(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="below 0"):
        merged(df, -0.1)


def test_presence(spark):
    """Scores go to groups, and areas to scores, by place, whatever was merged."""
    from glyphmill.operators.masks import presence

    images = spark.createDataFrame([(1, 100), (2, 100), (3, 4)], "image_id int, size int")
    masks = spark.createDataFrame([(1, 0, 0.4, 10.0), (1, 1, 0.9, 20.0), (1, 2, 0.8, 30.0), (2, 0, 0.3, 5.0), (3, 7, 1.0, 50.0)], "image_id int, mask int, score double, area double")
    roots = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 2), (2, 0, 0), (3, 7, 7)], "image_id int, mask int, root int")
    got = {r[0]: tuple(r)[1:] for r in presence(images, masks, roots).collect()}
    # of two groups the scores are 0.4 and 0.9; 0.9 stays, and weighs the first area
    assert got[1] == (pytest.approx(0.09), pytest.approx(0.1), 2) and got[2] == (0.0, 1.0, 1) and got[3] == (1.0, 0.0, 1)


def brute_dimensions(edge, w, h, win, stride):
    out, sizes = {}, [2**k for k in range(win.bit_length() - 1, 1, -1)]
    for oy in range(0, h - win + 1, stride):
        for ox in range(0, w - win + 1, stride):
            own = [(x, y) for x in range(win) for y in range(win) if edge[ox + x, oy + y]]
            if len(own) < 0.01 * win * win:
                continue
            a, b = [math.log(s) for s in sizes], [math.log(len({(x // s, y // s) for x, y in own}) + 1e-10) for s in sizes]
            ma, mb = sum(a) / len(a), sum(b) / len(b)
            slope = sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / sum((p - ma) ** 2 for p in a)
            left = sum((q - mb - slope * (p - ma)) ** 2 for p, q in zip(a, b, strict=True))
            if 1 - left / (sum((q - mb) ** 2 for q in b) + 1e-10) > 0.9 and 0.5 < -slope < 2.5:
                out[ox, oy] = -slope
    return out


def test_dimension_map(spark):
    from glyphmill.operators.fractal import dimension_map, pooled, summed

    rng = random.Random(12)
    images = {}
    for k, (w, h, share) in enumerate([(40, 28, 0.02), (33, 17, 0.3), (16, 16, 0.05), (15, 40, 0.5), (37, 41, 0.0)]):
        images[k] = (w, h, {(x, y): int(rng.random() < share * (1 + x / w)) for x in range(w) for y in range(h)})
    df = spark.createDataFrame([(k, x, y, e) for k, (_, _, edge) in images.items() for (x, y), e in edge.items()], "id int, x int, y int, edge int")
    for win, stride in ((16, 4), (16, 3), (8, 8)):
        got = {(r["id"], r["x"], r["y"]): r["dimension"] for r in dimension_map(df, "id", win, stride).collect()}
        want = {(k, *at): d for k, (w, h, edge) in images.items() for at, d in brute_dimensions(edge, w, h, win, stride).items()}
        assert got == pytest.approx(want) and len(want) > 10
    table = {(r["x"], r["y"]): r["s"] for r in summed(df.where("id = 1"), ["id"], "edge").collect()}
    assert table[32, 16] == sum(images[1][2].values()) and table[3, 2] == sum(e for (x, y), e in images[1][2].items() if x <= 3 and y <= 2)
    assert pooled(dimension_map(df, "id", 16, 4), "id").where("id = 1").first()["windows"] > 3
    assert dimension_map(df.limit(0), "id", 16, 4).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        dimension_map(df, "id", 24, 4)


def test_matched_histograms(spark):
    from glyphmill.operators.matching import average_histogram, matched

    rng = random.Random(2)
    images = {k: [rng.choice([3, 3, 3, 7, 9, 200]) if k % 2 else rng.randint(0, 255) for _ in range(m)] for k, m in enumerate([1, 2, 64, 64, 37])}
    df = spark.createDataFrame([(k, i, v) for k, own in images.items() for i, v in enumerate(own)] + [(0, 99, None)], "id int, pos int, value int")
    pool = sorted(v for own in images.values() for v in own)
    want = {}
    for k, own in images.items():
        order = sorted(range(len(own)), key=lambda i, own=own: (own[i], i))
        for r, i in enumerate(order):
            # the first value that at least (2 r + 1) / 2 m of all pixels are no larger than
            want[k, i] = next(v for at, v in enumerate(pool, 1) if 2 * len(own) * sum(u <= v for u in pool) >= (2 * r + 1) * len(pool))
    got = {(r["id"], r["pos"]): r["matched"] for r in matched(df, "id", average_histogram(df.where("value IS NOT NULL"), "id"), F.col("pos")).collect()}
    assert got == want
    assert sorted(got[2, i] for i in range(64)) == sorted(got[3, i] for i in range(64))


def test_sign_test(spark):
    import hashlib

    from glyphmill.operators.matching import sign_test

    rng = random.Random(8)
    rows = [(g, i, round(rng.gauss(mu, 1), 3), round(rng.gauss(0, 1), 3)) for g, mu in (("far", 1.0), ("same", 0.0), ("one", 0.3)) for i in range(1 if g == "one" else 40)] + [("same", 500, None, 1.0), ("none", 501, 1.0, None)]
    got = {r["g"]: r for r in sign_test(spark.createDataFrame(rows, "g string, i int, a double, b double").repartition(3), ["g"], F.col("a"), F.col("b"), F.col("i"), rounds=100, seed="x").collect()}
    assert set(got) == {"far", "same", "one"}
    for g, r in got.items():
        own = [(i, round((a - b) * 1000)) for h, i, a, b in rows if h == g and a is not None and b is not None]
        digits = {i: "".join(hashlib.md5(f"x:{i}:{k}".encode()).hexdigest() for k in range(4)) for i, _ in own}
        seen = sum(d for _, d in own)
        sums = [sum(d if digits[i][k] < "8" else -d for i, d in own) for k in range(100)]
        assert (r["n"], r["mean"]) == (len(own), pytest.approx(seen / len(own) / 1000)) and (r["p_one"], r["p_two"]) == (sum(s > seen for s in sums) / 100, sum(abs(s) > abs(seen) for s in sums) / 100)
    assert got["far"]["p_two"] == 0 and got["same"]["p_two"] > 0.05


def test_components_of_small_and_large_keys(spark, monkeypatch):
    """Small keys take no rounds: a count of jobs that doesn't grow with the chains; large and small ones agree with a flood."""
    from glyphmill.operators import regions as R

    rng, rows, want = random.Random(3), [], {}
    for k in range(12):
        names = rng.sample(range(-(2**40), 2**40), 60)
        edges = [(names[i], names[i + 1]) for i in range(59) if rng.random() < 0.8] + [(rng.choice(names), rng.choice(names)) for _ in range(k)]
        rows += [(None if k == 11 else f"k{k}", a, b) for a, b in edges + edges[:3]]
        near = {}
        for a, b in edges:
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        for n in near:
            found, todo = {n}, [n]
            while todo:
                for m in near[todo.pop()] - found:
                    found.add(m)
                    todo.append(m)
            want[None if k == 11 else f"k{k}", n] = min(found)
    df = spark.createDataFrame(rows, "id string, u long, v long")
    of = lambda found: {tuple(r)[:2]: r[2] for r in found.collect()}
    spark.sparkContext.setJobGroup("small", "")
    found = R.components(df, "id")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("small")) < 12
    assert of(found) == want
    monkeypatch.setattr(R, "SMALL", 50)
    keyed = {k: n for k, n in want.items() if k[0] is not None}
    assert of(R.components(df.where("id IS NOT NULL"), "id")) == keyed
