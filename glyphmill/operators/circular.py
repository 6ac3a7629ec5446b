"""Circular statistics of angles in radians, optionally weighted.

Everything descriptive is one partial aggregation of sums of cosines and sines per group; what needs the mean direction
joins it back. Tail probabilities use closed forms or series as Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _w(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1.0)


def distance(a: Column, b: Column) -> Column:
    """a - b around the circle, in (-pi, pi]."""
    d = a - b
    return F.atan2(F.sin(d), F.cos(d))


def axial(a: Column, m: float) -> Column:
    return F.pmod(a * m, 2 * F.pi())


def moments(df: DataFrame, keys: list[str], angle: str, p: int = 1, weight: str | None = None) -> DataFrame:
    """n (sum of weights), length rho and direction mu of the p-th trigonometric moment."""
    w, a = _w(weight), F.col(angle)
    s = df.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * F.cos(a * p)).alias("c"), F.sum(w * F.sin(a * p)).alias("s"))
    return s.select(*keys, "n", (F.hypot("c", "s") / F.col("n")).alias("rho"), F.atan2("s", "c").alias("mu"))


def descriptive(df: DataFrame, keys: list[str], angle: str, weight: str | None = None, spacing: float = 0.0) -> DataFrame:
    """Mean direction, length r (corrected for bin spacing), variance, two deviations, skewness and kurtosis (two each)."""
    w, a = _w(weight), F.col(angle)
    s = df.groupBy(*keys).agg(*(F.sum(w * f(a * p)).alias(f"{n}{p}") for p in (1, 2) for n, f in (("c", F.cos), ("s", F.sin))), F.sum(w).alias("n"))
    fix = F.lit(1.0) if not spacing else spacing / 2 / F.sin(F.lit(spacing / 2))
    s = s.withColumn("r0", F.hypot("c1", "s1") / F.col("n")).withColumn("r", F.col("r0") * fix).withColumn("mean", F.atan2("s1", "c1"))
    s = s.withColumn("rho2", F.hypot("c2", "s2") / F.col("n")).withColumn("mu2", F.atan2("s2", "c2"))
    # sum of w sin(2 (a - mean)) from the second moment: no second pass over the rows
    turn = 2 * F.col("mean")
    skew = (F.col("s2") * F.cos(turn) - F.col("c2") * F.sin(turn)) / F.col("n")
    kurt = (F.col("c2") * F.cos(turn) + F.col("s2") * F.sin(turn)) / F.col("n")
    return s.select(
        *keys, "n", "mean", "r", (1 - F.col("r")).alias("var"), F.sqrt(2 * (1 - F.col("r"))).alias("std"), F.sqrt(-2 * F.log("r")).alias("std0"), skew.alias("skewness"),
        (F.col("rho2") * F.sin(distance(F.col("mu2"), turn)) / F.pow(1 - F.col("r0"), 1.5)).alias("skewness0"), kurt.alias("kurtosis"),
        ((F.col("rho2") * F.cos(distance(F.col("mu2"), turn)) - F.pow("r0", F.lit(4))) / F.pow(1 - F.col("r0"), 2)).alias("kurtosis0"),
    )


def kappa(r: Column, n: Column | None = None) -> Column:
    """Concentration of a von Mises distribution from the mean length; n: small-sample correction."""
    k = F.when(r < 0.53, 2 * r + F.pow(r, 3) + 5 * F.pow(r, 5) / 6).when(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r)).otherwise(1 / (F.pow(r, 3) - 4 * F.pow(r, 2) + 3 * r))
    if n is None:
        return k
    small = F.when(k < 2, F.greatest(k - 2 / (n * k), F.lit(0.0))).otherwise(F.pow(n - 1, 3) * k / (F.pow(n, 3) + n))
    return F.when((n < 15) & (n > 1), small).otherwise(k)


def confidence_mean(r: Column, n: Column, chi2: float = 3.841458820694124) -> Column:
    """Half width of the confidence interval of the mean direction (95 % by default); NaN where it has none."""
    big = n * r
    low = F.sqrt(2 * n * (2 * big * big - n * chi2) / (4 * n - chi2)) / big
    high = F.sqrt(n * n - (n * n - big * big) * F.exp(chi2 / n)) / big
    t = F.when((r < 0.9) & (r > F.sqrt(chi2 / 2 / n)), low).when(r >= 0.9, high)
    return F.coalesce(F.acos(F.least(t, F.lit(1.0))), F.lit(float("nan")))


def rayleigh(df: DataFrame, keys: list[str], angle: str, weight: str | None = None) -> DataFrame:
    """Test of uniformity against one direction: z and p."""
    m = moments(df, keys, angle, 1, weight).withColumn("big", F.col("n") * F.col("rho"))
    return m.select(*keys, "n", (F.col("big") * F.col("big") / F.col("n")).alias("z"), F.exp(F.sqrt(1 + 4 * F.col("n") + 4 * (F.col("n") * F.col("n") - F.col("big") * F.col("big"))) - (1 + 2 * F.col("n"))).alias("p"))


def v_test(df: DataFrame, keys: list[str], angle: str, direction: float, weight: str | None = None) -> DataFrame:
    m = moments(df, keys, angle, 1, weight)
    v = F.col("n") * F.col("rho") * F.cos(F.col("mu") - direction)
    return m.select(*keys, v.alias("v"), (v * F.sqrt(2 / F.col("n"))).alias("u"))


def rao_spacing(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """U: half the sum of the gaps' deviations from 360 / n, in degrees."""
    deg = df.select(*keys, F.degrees(F.pmod(angle, 2 * F.pi())).alias("d"))
    w = W.partitionBy(*keys).orderBy("d")
    gaps = deg.select(*keys, "d", F.lag("d").over(w).alias("before"))
    g = gaps.groupBy(*keys).agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    gaps = gaps.join(g, keys)
    gap = F.when(F.col("before").isNull(), 360 - F.col("hi") + F.col("lo")).otherwise(F.col("d") - F.col("before"))
    return gaps.groupBy(*keys).agg((F.sum(F.abs(gap - 360 / F.col("n"))) / 2).alias("u"))


def corr_linear(df: DataFrame, keys: list[str], angle: str, value: str) -> DataFrame:
    """Circular-linear correlation and its p."""
    c, s = F.cos(angle), F.sin(angle)
    k = df.groupBy(*keys).agg(F.corr(F.col(value), c).alias("xc"), F.corr(F.col(value), s).alias("xs"), F.corr(s, c).alias("cs"), F.count("*").alias("n"))
    rho = F.sqrt((F.col("xc") ** 2 + F.col("xs") ** 2 - 2 * F.col("xc") * F.col("xs") * F.col("cs")) / (1 - F.col("cs") ** 2))
    return k.select(*keys, rho.alias("rho"), F.exp(-F.col("n") * rho * rho / 2).alias("p"))


def corr_circular(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Circular-circular correlation and its test statistic."""
    means = df.groupBy(*keys).agg(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a))).alias("ma"), F.atan2(F.sum(F.sin(b)), F.sum(F.cos(b))).alias("mb"))
    joined = df.join(means, keys) if keys else df.join(F.broadcast(means))  # one row
    x, y = F.sin(F.col(a) - F.col("ma")), F.sin(F.col(b) - F.col("mb"))
    s = joined.groupBy(*keys).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * x * y * y).alias("xxyy"), F.count("*").alias("n"))
    rho = F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))
    return s.select(*keys, rho.alias("rho"), (F.sqrt(F.col("xx") * F.col("yy") / F.col("xxyy")) * rho).alias("ts"))


def median(df: DataFrame, keys: list[str], angle: str, digits: int = 9) -> DataFrame:
    """The data point with half of the rows on either side of its diameter, of equals the smallest.

    Angles are counted first, so the comparison is between distinct angles, not between rows. It's of each with each: round to
    fewer digits where a group has many distinct ones.
    """
    d = df.select(*keys, F.round(F.pmod(angle, 2 * F.pi()), digits).alias("a")).groupBy(*keys, "a").agg(F.count("*").alias("c"))
    other = d.select(*keys, F.col("a").alias("b"), F.col("c").alias("k"))
    gap = F.round(distance(F.col("b"), F.col("a")), digits)
    pairs = d.join(other, keys) if keys else d.join(F.broadcast(other))
    sides = pairs.groupBy(*keys, "a").agg(F.abs(F.sum(F.when(gap >= 0, F.col("k")).otherwise(0)) - F.sum(F.when(gap <= 0, F.col("k")).otherwise(0))).alias("off"))
    return sides.groupBy(*keys).agg(F.min(F.struct("off", "a")).alias("m")).select(*keys, F.col("m.a").alias("median"))


def sample_cdf(df: DataFrame, keys: list[str], angle: str, bins: int = 20, weight: str | None = None) -> DataFrame:
    """Cumulative share of the weight per bin of the circle."""
    b = F.floor(F.pmod(angle, 2 * F.pi()) / (2 * F.pi()) * bins).cast("int")
    h = df.groupBy(*keys, b.alias("bin")).agg(F.sum(_w(weight)).alias("w"))
    own = W.partitionBy(*keys)
    return h.select(*keys, "bin", (F.sum("w").over(own.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / F.sum("w").over(own)).alias("cdf"))


def von_mises_density(a: Column, mean: Column, k: Column, terms: int = 30) -> Column:
    """exp(k cos(a - mean)) / (2 pi I0(k)), with the series of I0."""
    i0, term = F.lit(1.0), F.lit(1.0)
    for i in range(1, terms):
        term = term * (k / (2 * i)) * (k / (2 * i))
        i0 = i0 + term
    return F.exp(k * F.cos(a - mean)) / (2 * F.pi() * i0)
