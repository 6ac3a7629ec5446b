"""Queries of caches and of agreement in windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import caching as C
from ..streaming import expiring as X
from . import views as V
from .catalog import query

TTL = 3 * 86_400

_REQUESTS = "req AS (SELECT event_type || ':' || user_id AS key, event_id AS id, epoch(ts) AS at_ FROM events)"
_MISSES = f"m AS (SELECT key, min(at_) AS at_ FROM req GROUP BY 1 UNION ALL SELECT key, at_ FROM (SELECT m.key, min(r.at_) AS at_ FROM m JOIN req r ON r.key = m.key AND r.at_ >= m.at_ + {TTL} GROUP BY 1)), f AS (SELECT *, row_number() OVER (PARTITION BY key, at_ ORDER BY id) AS k FROM req)"


def requests(spark, d):
    return V.table(spark, d, "events").select(F.concat_ws(":", "event_type", "user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).select("key", "id", (F.col("us") / 1e6).alias("at"))


@query("stm06_cache_hits", f"+{_REQUESTS}, {_MISSES} SELECT f.key, f.id, NOT (f.k = 1 AND m.key IS NOT NULL) AS hit FROM f LEFT JOIN m ON m.key = f.key AND m.at_ = f.at_")
def _(spark, d):
    return C.cache_hits(requests(spark, d), TTL)


@query("stm06_cache_stats", f"+{_REQUESTS}, {_MISSES}, h AS (SELECT f.key, NOT (f.k = 1 AND m.key IS NOT NULL) AS hit FROM f LEFT JOIN m ON m.key = f.key AND m.at_ = f.at_) SELECT split_part(key, ':', 1) AS prefix, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 3) AS hit_rate FROM h GROUP BY 1")
def _(spark, d):
    return C.cache_stats(C.cache_hits(requests(spark, d), TTL).withColumn("prefix", F.substring_index("key", ":", 1)), ["prefix"])


@query("stm08_sliding_agreement", """+w AS (SELECT image_id, attribute_key, value, CAST(created_at AS DATE) - CAST(k AS INTEGER) AS start FROM validations, range(7) t(k)),
c AS (SELECT start, image_id, attribute_key, value, count(*) AS c FROM w GROUP BY ALL), p AS (SELECT start, sum(c) AS n, sum(c * (c - 1) / 2) AS equal FROM c GROUP BY start, image_id, attribute_key HAVING sum(c) >= 2)
SELECT strftime(start, '%Y-%m-%d') AS start, count(*) AS rated, CAST(sum(n) AS BIGINT) AS judgments, round(avg(equal / (n * (n - 1) / 2)), 6) AS agreement FROM p GROUP BY 1""")
def _(spark, d):
    rows = V.validations(spark, d).select("image_id", "attribute_key", "value", F.col("created_at").cast("timestamp").alias("created_at"))
    return X.sliding_agreement(rows).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "rated", "judgments", F.round("agreement", 6).alias("agreement"))
