"""Array images, colours and kernels against numpy and colorsys."""

import colorsys
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import grids as D
from glyphmill.operators import pixels as P


def test_neighbours_and_correlation(spark):
    rng = random.Random(1)
    g = [[rng.randrange(256) for _ in range(20)] for _ in range(3)] + [[7] * 20]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(g)], "id int, g array<int>")
    got = {r.id: r for r in df.select("id", D.neighbours(F.col("g"), 5, 1, -1).alias("n"), D.mirrored(F.col("g"), 5).alias("m")).select("id", "n", D.correlation(F.col("m")).alias("c"), D.contrast(F.col("n")).alias("d")).collect()}
    for i, x in enumerate(g):
        a = np.array(x).reshape(4, 5)
        pairs = [(int(a[y, k]), int(a[y - 1, k + 1])) for y in range(1, 4) for k in range(4)]
        assert [(p.a, p.b) for p in got[i].n] == pairs
        assert got[i].d == pytest.approx(np.mean([(p - q) ** 2 for p, q in pairs]))
        left, right = a[:, :2].ravel(), a[:, ::-1][:, :2].ravel()
        assert got[i].c == (None if i == 3 else pytest.approx(np.corrcoef(left, right)[0, 1]))


def test_hsv(spark):
    rng = random.Random(2)
    rows = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(50)] + [(0, 0, 0), (9, 9, 9), (255, 0, 1)]
    df = spark.createDataFrame(rows, "r int, g int, b int")
    for r in df.select("r", "g", "b", *(c.alias(n) for n, c in zip("hsv", D.hsv(F.col("r"), F.col("g"), F.col("b")), strict=True))).collect():
        h, s, v = colorsys.rgb_to_hsv(r.r / 255, r[1] / 255, r.b / 255)
        assert (r.h, r.s, r.v) == (pytest.approx(h), pytest.approx(s), pytest.approx(v * 255))


def test_kernels():
    flat = np.full((130, 130, 3), 90.0)
    assert P.k_texture(flat) == {"lbp_entropy": 0.0} and P.k_openness(flat)["openness"] == pytest.approx(1.0, abs=0.05)
    assert P.k_patches(flat)["high_mean"] == pytest.approx(0, abs=1e-9) and P.k_patches(flat)["low_mean"] > 0 and P.k_patches(flat[:50]) == {}
    assert P.k_window_energy(flat)["window_energy"] == pytest.approx(0, abs=1e-9)
    assert all(v == 0 for k, v in P.k_channels(flat).items() if k.endswith(("edges", "entropy")))
    noise = np.random.default_rng(1).integers(0, 256, (64, 64, 3)).astype(float)
    assert P.k_texture(noise)["lbp_entropy"] > 0.8 and P.k_openness(noise)["openness"] < 0.2 and P.k_patches(noise)["high_mean"] > 0
