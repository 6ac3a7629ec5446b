"""Tests of several samples of angles: equal directions, concentrations, medians and distributions.

Every test is sums per sample, combined before they're shuffled; two distributions are merged by running counts over ranges of
the circle. Tail probabilities are column expressions: continued fractions and series as folds, logarithms of gamma by
Stirling's series. Rows whose angle or sample is null are left out. A statistic that isn't defined (a single sample, a sample
without spread) is null or NaN, as is its p.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .circular import distance, kappa, median

BINS = 100


def log_gamma(x: Column) -> Column:
    """Of x > 0, by Stirling's series at x + 8."""
    z = x + 8
    low = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.5 * F.log(2 * F.pi()) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7))) - low


def _fraction(first: Column, terms, rounds: int) -> Column:
    """The continued fraction b0 + a1 / (b1 + a2 / (b2 + ...)) by Lentz's recurrence; terms(k) gives (a, b)."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def step(s: Column, k: Column) -> Column:
        a, b = terms(k.cast("double"))
        c, d = tiny(b + a / s["c"]), 1 / tiny(b + a * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["f"] * c * d).alias("f"))

    start = F.struct(tiny(first).alias("c"), F.lit(0.0).alias("d"), tiny(first).alias("f"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["f"])


def beta_share(x: Column, a: Column, b: Column, rounds: int = 150) -> Column:
    """The regularised incomplete beta function."""

    def part(x: Column, a: Column, b: Column) -> Column:
        def terms(n: Column):
            m = F.floor(n / 2)
            even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(n % 2 == 0, even).otherwise(odd), F.lit(1.0)

        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
        return front / a / _fraction(F.lit(1.0), terms, rounds)

    inner = F.when(x < (a + 1) / (a + b + 2), part(x, a, b)).otherwise(1 - part(1 - x, b, a))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """Chance of a larger F."""
    a, b = d1.cast("double"), d2.cast("double")
    return beta_share(b / (b + a * f), b / 2, a / 2)


def chi2_tail(x: Column, d: Column, rounds: int = 400) -> Column:
    """Chance of a larger chi squared."""
    a, y = d.cast("double") / 2, x / 2
    front = F.exp(-y + a * F.log(y) - log_gamma(a))
    low = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct((1 / a).alias("t"), (1 / a).alias("s")), lambda s, k: F.struct((s["t"] * y / (a + k)).alias("t"), (s["s"] + s["t"] * y / (a + k)).alias("s")), lambda s: s["s"])
    high = _fraction(y + 1 - a, lambda k: (-k * (k - a), y + 2 * k + 1 - a), rounds)
    return F.when(x <= 0, 1.0).when(y < a + 1, 1 - front * low).otherwise(front / high)


def _sums(df: DataFrame, keys: list[str], sample: str, angle: str) -> DataFrame:
    own = df.where(F.col(angle).isNotNull() & F.col(sample).isNotNull())
    return own.groupBy(*keys, F.col(sample).alias("sample")).agg(F.count("*").alias("n"), F.sum(F.cos(angle)).alias("c"), F.sum(F.sin(angle)).alias("s"))


def watson_williams(df: DataFrame, keys: list[str], sample: str, angle: str) -> DataFrame:
    """Have the samples one mean direction? samples, n, mean_length, between, within (sums of squares), f, p."""
    t = _sums(df, keys, sample, angle).groupBy(*keys).agg(F.count("*").alias("samples"), F.sum("n").alias("n"), F.sum(F.hypot("c", "s")).alias("each"), F.hypot(F.sum("c"), F.sum("s")).alias("whole"))
    t = t.where("n > 0").select(*keys, "samples", "n", (F.col("each") / F.col("n")).alias("mean_length"), (F.col("each") - F.col("whole")).alias("between"), (F.col("n") - F.col("each")).alias("within"))
    fix = 1 + 3 / (8 * kappa(F.col("mean_length")))
    f = fix * F.try_divide((F.col("n") - F.col("samples")) * F.col("between"), (F.col("samples") - 1) * F.col("within"))
    return t.withColumn("f", f).withColumn("p", F.when(F.col("f").isNotNull(), f_tail(F.col("f"), F.col("samples") - 1, F.col("n") - F.col("samples"))))


def concentration(df: DataFrame, keys: list[str], second: str, angle: str) -> DataFrame:
    """Have two samples (second: false, true) one concentration? n1, n2, mean_length, f, p; p is of the larger ratio, both ways."""
    b = F.col("sample")
    t = _sums(df, keys, second, angle).groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(side, v)), F.lit(0)).alias(name) for side, i in ((~b, "1"), (b, "2")) for v, name in ((F.col("n"), f"n{i}"), (F.hypot("c", "s"), f"r{i}"))))
    t = t.where("n1 + n2 > 0").withColumn("f", F.try_divide((F.col("n2") - 1) * (F.col("n1") - F.col("r1")), (F.col("n1") - 1) * (F.col("n2") - F.col("r2"))))
    p = F.when(F.col("f") > 1, 2 * f_tail(F.col("f"), F.col("n1"), F.col("n2"))).when(F.col("f") > 0, 2 * f_tail(1 / F.col("f"), F.col("n2"), F.col("n1")))
    return t.select(*keys, "n1", "n2", ((F.col("r1") + F.col("r2")) / (F.col("n1") + F.col("n2"))).alias("mean_length"), "f", p.alias("p"))


def common_median(df: DataFrame, keys: list[str], sample: str, angle: str, digits: int = 9) -> DataFrame:
    """Have the samples one median? samples, n, median (of all), statistic, p. Counts the angles of each on one side of the median of all."""
    own = df.where(F.col(angle).isNotNull() & F.col(sample).isNotNull()).select(*keys, F.col(sample).alias("sample"), F.col(angle).alias("angle"))
    mid = median(own, keys, "angle", digits)
    sided = (own.join(mid, keys) if keys else own.join(mid, F.lit(True))).groupBy(*keys, "sample", "median").agg(F.count("*").alias("n"), F.count_if(F.round(distance(F.col("angle"), F.col("median")), digits) < 0).alias("m"))
    t = sided.groupBy(*keys, "median").agg(F.count("*").alias("samples"), F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m") / F.col("n")).alias("q"))
    stat = F.try_divide(F.col("n") * F.col("n") * F.col("q"), F.col("m") * (F.col("n") - F.col("m"))) - F.try_divide(F.col("n") * F.col("m"), F.col("n") - F.col("m"))
    return t.select(*keys, "samples", "n", "median", stat.alias("statistic")).withColumn("p", F.when(F.col("samples") > 1, chi2_tail(F.col("statistic"), F.col("samples") - 1)))


def kuiper_tail(x: Column) -> Column:
    """Asymptotic chance of a larger scaled statistic; below 0.4 it's 1 to many places."""
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.lit(0.0), lambda s, j: s + 2 * (4 * j * j * x * x - 1) * F.exp(-2 * j * j * x * x))
    return F.when(x > 0.4, F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0))).when(x.isNotNull(), 1.0)


def kuiper(df: DataFrame, keys: list[str], second: str, angle: str, bins: int = BINS) -> DataFrame:
    """Have two samples (second: false, true) one distribution? n1, n2, statistic k, scaled, p.

    Shares are compared at the ends of `bins` ranges of the circle; ranges without rows change no running difference. p is the
    asymptotic one of the scaled statistic.
    """
    own = df.where(F.col(angle).isNotNull() & F.col(second).isNotNull())
    at = F.floor(F.pmod(angle, 2 * F.pi()) / (2 * F.pi()) * bins)
    counts = own.groupBy(*keys, at.alias("bin")).agg(F.count_if(~F.col(second)).alias("a"), F.count_if(second).alias("b"))
    sizes = counts.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    upto = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    run = counts.select(*keys, F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b"))
    # whole numbers: n2 a - n1 b is n1 n2 times the difference of shares
    diff = F.col("n2") * F.col("a") - F.col("n1") * F.col("b")
    t = (run.join(sizes, keys) if keys else run.join(sizes, F.lit(True))).groupBy(*keys, "n1", "n2").agg((F.greatest(F.max(diff), F.lit(0)) + F.greatest(F.max(-diff), F.lit(0))).alias("k"))
    n, m = F.col("n1").cast("double"), F.col("n2").cast("double")
    # the statistic over sqrt(n m (n + m)) is the difference times sqrt(n m / (n + m))
    t = t.withColumn("scaled", F.try_divide(F.col("k"), F.sqrt(n * m * (n + m))))
    return t.select(*keys, "n1", "n2", "k", "scaled", kuiper_tail(F.col("scaled")).alias("p"))
