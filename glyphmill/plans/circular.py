"""Queries of circular statistics over event hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import circular as C
from ..operators import circular_tests as C13
from . import views as V
from .catalog import query

_S = "s AS (SELECT event_type, count(*) AS n, sum(cos(a)) AS c1, sum(sin(a)) AS s1, sum(cos(2 * a)) AS c2, sum(sin(2 * a)) AS s2 FROM angles GROUP BY 1), m AS (SELECT *, sqrt(c1 * c1 + s1 * s1) / n AS r, atan2(s1, c1) AS mean, sqrt(c2 * c2 + s2 * s2) / n AS rho2, atan2(s2, c2) AS mu2 FROM s)"


def _r(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("cir01_descriptive", f"+{_S} SELECT event_type, CAST(n AS DOUBLE) AS n, round(mean, 6) AS mean, round(r, 6) AS r, round(1 - r, 6) AS var, round(sqrt(2 * (1 - r)), 6) AS std, round(sqrt(-2 * ln(r)), 6) AS std0, round((s2 * cos(2 * mean) - c2 * sin(2 * mean)) / n, 6) AS skewness, round(rho2 * sin(mu2 - 2 * mean) / pow(1 - r, 1.5), 6) AS skewness0, round((c2 * cos(2 * mean) + s2 * sin(2 * mean)) / n, 6) AS kurtosis, round((rho2 * cos(mu2 - 2 * mean) - pow(r, 4)) / pow(1 - r, 2), 6) AS kurtosis0 FROM m")
def _(spark, d):
    return _r(C.descriptive(V.angles(spark, d), ["event_type"], "a"))


@query("cir04_moment", f"+{_S} SELECT event_type, CAST(n AS DOUBLE) AS n, round(rho2, 6) AS rho, round(mu2, 6) AS mu FROM m")
def _(spark, d):
    return _r(C.moments(V.angles(spark, d), ["event_type"], "a", 2))


@query("cir06_median", """+d AS (SELECT event_type, round(a, 9) AS a, count(*) AS c FROM angles GROUP BY 1, 2),
g AS (SELECT x.event_type, x.a, round(atan2(sin(y.a - x.a), cos(y.a - x.a)), 9) AS gap, y.c FROM d x JOIN d y USING (event_type)),
o AS (SELECT event_type, a, abs(sum(CASE WHEN gap >= 0 THEN c ELSE 0 END) - sum(CASE WHEN gap <= 0 THEN c ELSE 0 END)) AS off FROM g GROUP BY 1, 2)
SELECT event_type, round(min(struct_pack(off := off, a := a)).a, 6) AS median FROM o GROUP BY 1""")
def _(spark, d):
    return _r(C.median(V.angles(spark, d), ["event_type"], "a"))


@query("cir09_corr_linear", "+k AS (SELECT event_type, corr(value, cos(a)) AS xc, corr(value, sin(a)) AS xs, corr(sin(a), cos(a)) AS cs, count(*) AS n FROM angles GROUP BY 1), r AS (SELECT event_type, n, sqrt((xc * xc + xs * xs - 2 * xc * xs * cs) / (1 - cs * cs)) AS rho FROM k) SELECT event_type, round(rho, 6) AS rho, round(exp(-n * rho * rho / 2), 6) AS p FROM r")
def _(spark, d):
    return _r(C.corr_linear(V.angles(spark, d), ["event_type"], "a", "value"))


@query("cir09_corr_circular", "+b AS (SELECT a, 2 * pi() * value / 500 AS b FROM angles), m AS (SELECT atan2(sum(sin(a)), sum(cos(a))) AS ma, atan2(sum(sin(b)), sum(cos(b))) AS mb FROM b), x AS (SELECT sin(a - ma) AS x, sin(b - mb) AS y FROM b, m), s AS (SELECT sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * x * y * y) AS q FROM x) SELECT round(xy / sqrt(xx * yy), 6) AS rho, round(sqrt(xx * yy / q) * xy / sqrt(xx * yy), 6) AS ts FROM s")
def _(spark, d):
    return _r(C.corr_circular(V.angles(spark, d).withColumn("b", 2 * F.pi() * F.col("value") / 500), [], "a", "b"))


@query("cir10_kappa", f"+{_S} SELECT event_type, round(CASE WHEN r < 0.53 THEN 2 * r + pow(r, 3) + 5 * pow(r, 5) / 6 WHEN r < 0.85 THEN -0.4 + 1.39 * r + 0.43 / (1 - r) ELSE 1 / (pow(r, 3) - 4 * r * r + 3 * r) END, 6) AS kappa FROM m")
def _(spark, d):
    return C.descriptive(V.angles(spark, d), ["event_type"], "a").select("event_type", F.round(C.kappa(F.col("r")), 6).alias("kappa"))


@query("cir12_rayleigh", f"+{_S} SELECT event_type, CAST(n AS DOUBLE) AS n, round(n * r * r, 6) AS z, round(exp(sqrt(1 + 4 * n + 4 * (n * n - n * r * n * r)) - (1 + 2 * n)), 6) AS p FROM m")
def _(spark, d):
    return _r(C.rayleigh(V.angles(spark, d), ["event_type"], "a"))


@query("cir12_v_test", f"+{_S} SELECT event_type, round(n * r * cos(mean - 1.5), 6) AS v, round(n * r * cos(mean - 1.5) * sqrt(2 / n), 6) AS u FROM m")
def _(spark, d):
    return _r(C.v_test(V.angles(spark, d), ["event_type"], "a", 1.5))


@query("cir12_rao_spacing", """+d AS (SELECT event_type, degrees(a) AS d, lag(degrees(a)) OVER (PARTITION BY event_type ORDER BY a) AS b, count(*) OVER w AS n, min(degrees(a)) OVER w AS lo, max(degrees(a)) OVER w AS hi FROM angles WINDOW w AS (PARTITION BY event_type))
SELECT event_type, round(sum(abs(CASE WHEN b IS NULL THEN 360 - hi + lo ELSE d - b END - 360 / n)) / 2, 6) AS u FROM d GROUP BY 1""")
def _(spark, d):
    return _r(C.rao_spacing(V.angles(spark, d), ["event_type"], "a"))


@query("cir14_sample_cdf", "+h AS (SELECT event_type, CAST(floor(a / (2 * pi()) * 20) AS INTEGER) AS bin, count(*) AS w FROM angles GROUP BY 1, 2) SELECT event_type, bin, round(sum(w) OVER (PARTITION BY event_type ORDER BY bin) / sum(w) OVER (PARTITION BY event_type), 6) AS cdf FROM h")
def _(spark, d):
    return _r(C.sample_cdf(V.angles(spark, d), ["event_type"], "a"))


def samples(spark, d):
    """Angles with three samples and two, by the value's whole part."""
    part = F.floor(F.abs("value"))
    return V.angles(spark, d).select("event_type", "a", (part % 3).cast("int").alias("three"), (part % 2 == 1).alias("odd"))


_SAMPLES = "x AS (SELECT event_type, a, CAST(floor(abs(value)) AS BIGINT) % 3 AS three, CAST(floor(abs(value)) AS BIGINT) % 2 = 1 AS odd FROM angles)"


@query("cir13_watson_williams", f"""+{_SAMPLES}, g AS (SELECT event_type, three, count(*) AS n, sum(cos(a)) AS c, sum(sin(a)) AS s FROM x GROUP BY 1, 2),
t AS (SELECT event_type, count(*) AS samples, CAST(sum(n) AS BIGINT) AS n, sum(sqrt(c * c + s * s)) AS e, sqrt(pow(sum(c), 2) + pow(sum(s), 2)) AS w FROM g GROUP BY 1), r AS (SELECT *, e / n AS r FROM t),
k AS (SELECT *, CASE WHEN r < 0.53 THEN 2 * r + pow(r, 3) + 5 * pow(r, 5) / 6 WHEN r < 0.85 THEN -0.4 + 1.39 * r + 0.43 / (1 - r) ELSE 1 / (pow(r, 3) - 4 * pow(r, 2) + 3 * r) END AS kappa FROM r)
SELECT event_type, samples, n, round(r, 6) AS mean_length, round(e - w, 5) AS between, round(n - e, 5) AS within, round((1 + 3 / (8 * kappa)) * (n - samples) * (e - w) / (samples - 1) / (n - e), 5) AS f FROM k""")
def _(spark, d):
    found = C13.watson_williams(samples(spark, d), ["event_type"], "three", "a")
    return found.select("event_type", "samples", "n", F.round("mean_length", 6).alias("mean_length"), *(F.round(c, 5).alias(c) for c in ("between", "within", "f")))


@query("cir13_concentration", f"""+{_SAMPLES}, g AS (SELECT event_type, odd, count(*) AS n, sqrt(pow(sum(cos(a)), 2) + pow(sum(sin(a)), 2)) AS r FROM x GROUP BY 1, 2)
SELECT p.event_type, p.n AS n1, q.n AS n2, round((p.r + q.r) / (p.n + q.n), 6) AS mean_length, round((q.n - 1) * (p.n - p.r) / ((p.n - 1) * (q.n - q.r)), 6) AS f FROM g p JOIN g q ON p.event_type = q.event_type AND NOT p.odd AND q.odd""")
def _(spark, d):
    found = C13.concentration(samples(spark, d), ["event_type"], "odd", "a")
    return found.select("event_type", "n1", "n2", F.round("mean_length", 6).alias("mean_length"), F.round("f", 6).alias("f"))


@query("cir13_common_median", f"""+{_SAMPLES}, d AS (SELECT event_type, round(a, 9) AS a, count(*) AS c FROM x GROUP BY 1, 2), g AS (SELECT p.event_type, p.a, round(atan2(sin(q.a - p.a), cos(q.a - p.a)), 9) AS gap, q.c FROM d p JOIN d q USING (event_type)),
o AS (SELECT event_type, a, abs(sum(CASE WHEN gap >= 0 THEN c ELSE 0 END) - sum(CASE WHEN gap <= 0 THEN c ELSE 0 END)) AS off FROM g GROUP BY 1, 2), m AS (SELECT event_type, min(struct_pack(off := off, a := a)).a AS median FROM o GROUP BY 1),
s AS (SELECT event_type, median, three, count(*) AS n, count(*) FILTER (round(atan2(sin(a - median), cos(a - median)), 9) < 0) AS m FROM x JOIN m USING (event_type) GROUP BY 1, 2, 3),
t AS (SELECT event_type, median, count(*) AS samples, CAST(sum(n) AS BIGINT) AS n, CAST(sum(m) AS DOUBLE) AS m, sum(m * m / n) AS q FROM s GROUP BY 1, 2) SELECT event_type, samples, n, round(median, 6) AS median, round(n * n * q / (m * (n - m)) - n * m / (n - m), 6) AS statistic FROM t""")
def _(spark, d):
    found = C13.common_median(samples(spark, d), ["event_type"], "three", "a")
    return found.select("event_type", "samples", "n", F.round("median", 6).alias("median"), F.round("statistic", 6).alias("statistic"))


@query("cir13_kuiper", f"""+{_SAMPLES}, b AS (SELECT event_type, CAST(floor(a / (2 * pi()) * 100) AS INTEGER) AS bin, odd FROM x), e AS (SELECT e.event_type, k.bin, count(*) FILTER (NOT b.odd AND b.bin <= k.bin) AS a, count(*) FILTER (b.odd AND b.bin <= k.bin) AS b, count(*) FILTER (NOT b.odd) AS n1, count(*) FILTER (b.odd) AS n2 FROM (SELECT DISTINCT event_type FROM b) e JOIN b USING (event_type), (SELECT unnest(range(100)) AS bin) k GROUP BY 1, 2)
SELECT event_type, n1, n2, CAST(greatest(max(n2 * a - n1 * b), 0) + greatest(max(n1 * b - n2 * a), 0) AS BIGINT) AS k FROM e GROUP BY 1, 2, 3""")
def _(spark, d):
    return C13.kuiper(samples(spark, d), ["event_type"], "odd", "a").select("event_type", "n1", "n2", "k")
