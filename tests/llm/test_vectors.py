"""Vector codes and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

VECS = "vec_id long, embedding array<double>, label int"


def ok(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def vectors(n=150, dim=16, spread=1.0):
    rng = random.Random(4)
    base = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(n // 3)]
    rows = [(i, [round(x + rng.gauss(0, 0.1), 2) for x in rng.choice(base)] if i % 4 else list(rng.choice(base)), rng.choice([0, 1, 1, 1, 2, None])) for i in range(n)]
    rows += [rows[-1]] * 2 + [(None, rows[0][1], 1), (1000, None, 1), (1001, [None] * dim, 1), (1002, [float("nan")] * dim, 2), (1003, [float("inf")] * dim, 0), (1004, [0.0] * dim, 1), (1005, [-0.0] * dim, None)]
    return rows


# --- op12


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    held = [(i, v, label) for i, v, label in rows if ok(v)]
    out = []
    for size in {len(v) for _, v, _ in held}:
        own = [r for r in held if len(r[1]) == size]
        width = -(-size // parts)
        cut = [[[*(math.floor(Fraction(x) * scale) for x in v), *[0] * (parts * width - size)][p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in own]
        first = sorted(range(len(own)), key=lambda k: (own[k][0] is None, own[k][0] or 0, own[k][1]))[:entries]
        books = [[cut[k][p] for k in first] for p in range(parts)]

        def nearest(p, x, books=books):
            return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

        for _ in range(rounds):
            near = [[nearest(p, c[p])[1] for c in cut] for p in range(parts)]
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [c[p] for c, k in zip(cut, near[p], strict=True) if k == e]
                    if mine:
                        books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for (i, _, label), c in zip(own, cut, strict=True):
            best = [nearest(p, c[p]) for p in range(parts)]
            out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), sha))
    total = {}
    for _, label, _, error, _ in out:
        total[label] = total.get(label, 0) + error
    fits = lambda x: x if x < 1 << 63 else None
    return sorted((str(i), code, fits(error), fits(total[label]) if all(fits(e) is not None for _, k, _, e, _ in out if k == label) else None, sha) for i, label, code, error, sha in out)


def coded(df):
    from glyphmill.llm.vectorcodes import vector_codes

    return sorted((str(r[0]), *r[1:]) for r in vector_codes(df).collect())


@pytest.mark.parametrize("rows", [vectors(), vectors(9)[:9], [*vectors(60, 12), *((2000 + i, [float(i % 5)] * 3, 1) for i in range(30)), (3000, [], 2)], [(1, [0.5] * 8, 1)], [(i, [1.0, 2.0] * 4, None) for i in range(40)]])
def test_codes(spark, rows):
    assert coded(spark.createDataFrame(rows, VECS).repartition(3)) == brute_codes(rows)


def test_codes_of_huge_components(spark):
    rows = [(i, [x * 10.0**e for x in v], label) for e, (i, v, label) in zip(np.tile([0, 3, 9, 25, 200, 300], 50).tolist(), [r for r in vectors(60, 8) if ok(r[1])], strict=False)]
    want = brute_codes(rows)
    assert None in {r[2] for r in want} and any(r[2] is not None for r in want)
    assert coded(spark.createDataFrame(rows, VECS)) == want


def test_codes_of_nothing_and_of_clashing_columns(spark):
    from glyphmill.llm.vectorcodes import encode, learn_codebooks, vector_codes

    df = spark.createDataFrame(vectors(40), VECS).withColumn("code", F.lit("x")).withColumn("size", F.lit(1)).withColumn("i", F.lit(1))
    assert vector_codes(df.limit(0)).count() == 0 and vector_codes(df.where("vec_id IN (1000, 1001)")).count() == 0
    assert coded(df) == brute_codes(vectors(40))
    with pytest.raises(ValueError, match="code"):
        encode(df, learn_codebooks(df), keep=["code"])
    with pytest.raises(ValueError, match="256"):
        learn_codebooks(df, entries=257)


def test_tree_takes_the_lowest_of_equal_entries():
    from glyphmill.llm.vectorcodes import KdTree

    rng = np.random.default_rng(3)
    for n, kind in [(1, np.int64), (16, np.int64), (16, object), (200, np.int64)]:
        entries, x = rng.integers(-2, 3, (n, 3)).astype(kind), rng.integers(-3, 4, (300, 3)).astype(kind)
        far = ((x[:, None] - entries[None]) ** 2).sum(axis=2).astype(np.int64)
        index, best = KdTree(entries).nearest(x)
        assert (index == far.argmin(axis=1)).all() and (best.astype(np.int64) == far.min(axis=1)).all()


def test_tree_visits_few_leaves():
    """Far entries are never measured: of 256 entries in a row, a search meets the near ones only."""
    from glyphmill.llm import vectorcodes as v

    class Counting(np.ndarray):
        asked = 0

        def __getitem__(self, k):
            if isinstance(k, int):
                Counting.asked += 1
            return np.asarray(super().__getitem__(k))

    tree = v.KdTree(np.arange(256)[:, None] * 1000)
    tree._safe = lambda x: (tree.entries.view(Counting), x)
    tree.nearest(np.array([[70_001]]))
    assert 0 < Counting.asked <= 8


def test_limbs_add_up():
    from glyphmill.llm.vectorcodes import limbs

    for x in (np.array([[0, -1, 5, 1 << 40, -(1 << 61)]]), np.array([[3, -(1 << 900), (1 << 70) + 1]], object)):
        assert [sum(int(d[0, k]) << (20 * at) for at, d in limbs(x)) for k in range(x.shape[1])] == [int(v) for v in x[0]]


# --- op13


def brute_negatives(rows, every=10, positives=5, negatives=3, low=50, high=95, scale=256):
    """(anchor, positive, rank, negative, positive score, negative score); rows are told apart by their place."""
    held = []
    for k, (i, v, label) in enumerate(rows):
        if label is not None and ok(v) and all(math.isfinite(x * scale) for x in v):
            held.append((k, i, [math.floor(Fraction(x) * scale) for x in v], label))
    end = (1 << 63) - 1
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, i, v, label in held:
        if i is None or i % every:
            continue
        scored = [(max(min(sum(a * b for a, b in zip(v, w, strict=True)), end), -end), j, other) for m, j, w, other in held if m != k and len(w) == len(v)]
        for ps, p, _ in sorted((s for s in scored if s[2] == label), key=key)[:positives]:
            bad = sorted((s for s in scored if s[2] != label and low * ps <= 100 * s[0] <= high * ps), key=key)[:negatives]
            out += [(i, p, at, j, ps, ns) for at, (ns, j, _) in enumerate(bad, 1)]
    return sorted(map(str, out))


def mined(df, every=10, **more):
    from glyphmill.llm.hardnegatives import hard_negatives

    return sorted(str(tuple(r)) for r in hard_negatives(df, F.col("vec_id") % every == 0, **more).collect())


def of_many_norms(n=400, dim=6):
    rng = random.Random(8)
    rows = [(i, [round(rng.gauss(0, 1), 1) * 10 ** rng.choice([-1, 0, 0, 1]) for _ in range(dim)], 1 if i % 3 else rng.choice([0, 2, None])) for i in range(n)]
    return [*rows, rows[20], rows[20], rows[21], (None, rows[22][1], 1), (None, rows[23][1], 0), *((n + i, rows[40][1], i % 3) for i in range(30))]


@pytest.mark.parametrize(("rows", "most", "bucket"), [(vectors(), 1024, 1024), (of_many_norms(), 1024, 1024), (of_many_norms(), 60, 7), (of_many_norms(), 13, 1), ([*vectors(40), *((3000 + 10 * i, [float(i)] * 3, i % 2) for i in range(9)), (4000, [], 1), (4001, [], 1), (4002, [], 2)], 10, 4)])
def test_negatives(spark, monkeypatch, rows, most, bucket):
    from glyphmill.llm import hardnegatives as h

    monkeypatch.setattr(h, "LEAST_SLICE", min(most, 1024))
    monkeypatch.setattr(h, "SLICE", most)
    monkeypatch.setattr(h, "BUCKET", bucket)
    want = brute_negatives(rows)
    assert want
    assert mined(spark.createDataFrame(rows, VECS).repartition(3)) == want


def test_negatives_of_huge_components(spark):
    rows = [(i, [x * 10.0 ** ((i % 7) * 3) for x in v], label) for i, v, label in of_many_norms(120) if i is not None]
    rows += [(500, [1e307] * 6, 1), (510, [1e150] * 6, 1), (520, [1e160, -1e160, 0.0, 0.0, 0.0, 0.0], 0), (530, [1e160] * 6, 2)]
    want = brute_negatives(rows)
    assert any(str((1 << 63) - 1) in r for r in want)
    assert mined(spark.createDataFrame(rows, VECS)) == want


def test_negatives_of_nothing_and_of_clashing_columns(spark):
    df = spark.createDataFrame(of_many_norms(100), VECS)
    assert mined(df.limit(0)) == [] and mined(df.where("label = 1")) == [] and mined(df, every=100_000_000_000) == brute_negatives(of_many_norms(100), 100_000_000_000)
    more = df.withColumn("uid", F.lit(1)).withColumn("slice", F.lit("x")).withColumn("norm", F.lit(0)).withColumn("id", F.lit(None))
    assert mined(more) == brute_negatives(of_many_norms(100))
    assert mined(df, positives=2, negatives=7, low=-300, high=300) == brute_negatives(of_many_norms(100), positives=2, negatives=7, low=-300, high=300)
    with pytest.raises(ValueError, match="at least 1"):
        mined(df, positives=0)


def test_short_vectors_are_not_compared(monkeypatch):
    """A bucket whose norms can't reach the limits or the running best is skipped."""
    from glyphmill.llm import hardnegatives as h

    met = []
    plain = h.products
    monkeypatch.setattr(h, "products", lambda a, b, exact: (met.append(len(b)), plain(a, b, exact))[1])
    norm = np.sort(np.repeat(np.arange(1.0, 101.0), 10))[::-1]
    vec = np.stack([norm, np.zeros(1000)], axis=1)
    starts = np.arange(0, 1001, 10)
    held = h.Held(np.arange(1000), np.arange(1000), np.zeros(1000, bool), np.zeros(1000, object), np.full(1000, 2), norm, [vec[i : i + 10] for i in starts[:-1]], starts)
    one = lambda low, high, k: h.search(held, np.array([5000]), np.array([1], object), 2, np.array([2.0]), np.array([[2.0, 0.0]]), np.array([[low]]), np.array([[high]]), k, False)[2].tolist()
    assert one(-1, 1 << 40, 3) == [200, 200, 200] and len(met) <= 2
    met.clear()
    assert one(190, 196, 3) == [196, 196, 196] and len(met) <= 5
    met.clear()
    assert one(300, 400, 3) == [] and not met
