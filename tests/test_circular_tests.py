"""Tests of several samples of angles: tails against tables, statistics against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import circular_tests as T


def one(spark, column):
    return spark.range(1).select(column.alias("p")).first()["p"]


def test_tails_against_tables(spark):
    d = lambda v: F.lit(float(v))
    for f, a, b, p in [(4.9646, 1, 10, 0.05), (4.1028, 2, 10, 0.05), (2.7109, 5, 20, 0.05), (2.1646, 10, 30, 0.05), (4.1027, 5, 20, 0.01), (4.1259, 3, 60, 0.01), (161.4476, 1, 1, 0.05), (1.0, 7, 7, 0.5)]:
        assert one(spark, T.f_tail(d(f), d(a), d(b))) == pytest.approx(p, rel=2e-4)
    for x, k, p in [(3.8415, 1, 0.05), (7.8147, 3, 0.05), (18.3070, 10, 0.05), (43.7730, 30, 0.05), (9.2103, 2, 0.01), (124.3421, 100, 0.05), (0.3518, 3, 0.95), (0, 4, 1.0)]:
        assert one(spark, T.chi2_tail(d(x), d(k))) == pytest.approx(p, rel=2e-4)
    for x, p in [(1.620, 0.10), (1.747, 0.05), (1.862, 0.025), (2.001, 0.01)]:
        assert one(spark, T.kuiper_tail(d(x))) == pytest.approx(p, rel=0.01)
    for v in (0.5, 1, 2.5, 10, 171.3):
        assert one(spark, T.log_gamma(d(v))) == pytest.approx(math.lgamma(v), abs=1e-11)


def angles():
    rng = random.Random(11)
    rows = [(g, s, rng.vonmisesvariate(mu + 0.4 * s, k)) for g, mu, k in (("tight", 1.0, 8.0), ("wide", 6.1, 0.9), ("same", 3.0, 3.0)) for s in (0, 1, 2) for _ in range(rng.randint(12, 30))]
    return [*rows, ("tight", None, 1.0), ("tight", 1, None), ("alone", 0, 1.0), ("alone", 0, 2.0)]


def held(rows, group):
    out = {}
    for g, s, a in rows:
        if g == group and s is not None and a is not None:
            out.setdefault(s, []).append(a)
    return out


def length(v):
    return math.hypot(sum(map(math.cos, v)), sum(map(math.sin, v)))


def test_watson_williams_and_concentration(spark):
    rows = angles()
    df = spark.createDataFrame(rows, "g string, s int, a double").repartition(3)
    for r in T.watson_williams(df, ["g"], "s", "a").collect():
        own = held(rows, r["g"])
        n, each, whole = sum(map(len, own.values())), sum(map(length, own.values())), length([a for v in own.values() for a in v])
        assert (r["n"], r["samples"], r["between"], r["within"]) == (n, len(own), pytest.approx(each - whole, abs=1e-9), pytest.approx(n - each))
        if len(own) < 2:
            assert r["f"] is None and r["p"] is None
            continue
        m = each / n
        k = 2 * m + m**3 + 5 * m**5 / 6 if m < 0.53 else -0.4 + 1.39 * m + 0.43 / (1 - m) if m < 0.85 else 1 / (m**3 - 4 * m**2 + 3 * m)
        assert r["f"] == pytest.approx((1 + 3 / (8 * k)) * (n - len(own)) * (each - whole) / (len(own) - 1) / (n - each)) and 0 <= r["p"] <= 1
    two = df.where("s < 2").withColumn("second", F.col("s") == 1)
    for r in T.concentration(two, ["g"], "second", "a").collect():
        own = held(rows, r["g"])
        if r["g"] == "alone":
            assert (r["n1"], r["n2"], r["p"]) == (2, 0, None) or r["f"] is not None
            continue
        n1, n2, r1, r2 = len(own[0]), len(own[1]), length(own[0]), length(own[1])
        assert r["f"] == pytest.approx((n2 - 1) * (n1 - r1) / ((n1 - 1) * (n2 - r2))) and 0 < r["p"] <= 2
    assert T.watson_williams(df.limit(0), [], "s", "a").count() == 0


def test_common_median_and_kuiper(spark):
    rows = angles()
    df = spark.createDataFrame(rows, "g string, s int, a double").where("g <> 'alone'")
    apart = lambda a, b: math.atan2(math.sin(a - b), math.cos(a - b))
    for r in T.common_median(df, ["g"], "s", "a").collect():
        own = held(rows, r["g"])
        count = {s: sum(round(apart(a, r["median"]), 9) < 0 for a in v) for s, v in own.items()}
        n, m = sum(map(len, own.values())), sum(count.values())
        want = n * n / (m * (n - m)) * sum(count[s] ** 2 / len(own[s]) for s in own) - n * m / (n - m)
        assert (r["samples"], r["n"], r["statistic"]) == (3, n, pytest.approx(want, abs=1e-9)) and 0 <= r["p"] <= 1 and abs(2 * m - n) <= 2
    two = df.where("s < 2").withColumn("second", F.col("s") == 1)
    ps = {}
    for r in T.kuiper(two, ["g"], "second", "a").collect():
        own = held(rows, r["g"])
        share = lambda v, k: sum(a % (2 * math.pi) < 2 * math.pi * k / 100 for a in v) / len(v)
        diff = [share(own[0], k) - share(own[1], k) for k in range(1, 101)]
        n, m = len(own[0]), len(own[1])
        assert r["k"] == pytest.approx(n * m * (max(0, *diff) + max(0, *(-d for d in diff)))) and r["scaled"] == pytest.approx(r["k"] / math.sqrt(n * m * (n + m)))
        ps[r["g"]] = r["p"]
    same = two.where("s = 0").select("g", "a", F.lit(False).alias("second"))
    assert all(r["k"] == 0 and r["p"] == 1 for r in T.kuiper(same.unionByName(same.withColumn("second", F.lit(True))), ["g"], "second", "a").collect())
    assert set(ps) == {"tight", "wide", "same"} and all(0 <= p <= 1 for p in ps.values())
