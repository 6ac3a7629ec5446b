"""Hits and misses of a cache with a time to live, over a whole log of requests.

A miss makes an entry, hits don't prolong it: so the misses of a key are a chain, each the first request at or after the last
one's end. Where a chain goes from any request is one window; which requests are on it follows by doubling: in each round the
requests known to be misses jump ahead, and jumps get twice as long. Rounds grow with the logarithm of a key's misses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir


def _micros() -> Column:
    return F.round(F.col("at").cast("double") * 1e6).cast("long").alias("at")


def cache_misses(moments: DataFrame, seconds: float) -> DataFrame:
    """(key, at): the moments (key, at in whole microseconds, distinct) that miss."""
    checkpoint_dir(moments.sparkSession)
    ahead = W.partitionBy("key").orderBy("at").rangeBetween(round(seconds * 1e6), W.unboundedFollowing)
    jump = moments.select("key", "at", F.min("at").over(ahead).alias("to")).where("to IS NOT NULL").checkpoint()
    on = moments.groupBy("key").agg(F.min("at").alias("at")).checkpoint()
    known = -1
    while (n := on.count()) != known:
        known = n
        on = on.unionByName(on.join(jump, ["key", "at"]).select("key", F.col("to").alias("at"))).distinct().checkpoint()
        jump = jump.join(jump.select("key", F.col("at").alias("to"), F.col("to").alias("on")), ["key", "to"]).select("key", "at", F.col("on").alias("to")).checkpoint()
    return on


def cache_hits(requests: DataFrame, seconds: float, cleared: DataFrame | None = None) -> DataFrame:
    """requests: key, id, at (seconds, read to the microsecond). (key, id, hit); of requests at the same time the one of the smallest id comes first.

    cleared: (key, at) at which a key's entry was dropped; requests at that time or later find it gone. An entry whose time is just
    over is gone. Requests without a key or time are left out.
    """
    own = requests.where("key IS NOT NULL AND at IS NOT NULL").select("key", "id", _micros())
    if cleared is not None:
        # what was dropped parts a key's log into pieces that don't see one another
        marks = cleared.select("key", F.lit(None).cast(own.schema["id"].dataType).alias("id"), _micros(), F.lit(1).alias("mark"))
        both = own.withColumn("mark", F.lit(0)).unionByName(marks)
        piece = F.sum("mark").over(W.partitionBy("key").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow))
        own = both.withColumn("piece", piece).where("mark = 0").select(F.struct("key", "piece").alias("key"), "id", "at")
    misses = cache_misses(own.select("key", "at").distinct(), seconds).withColumn("miss", F.lit(True))
    first = F.row_number().over(W.partitionBy("key", "at").orderBy("id")) == 1
    out = own.withColumn("first", first).join(misses, ["key", "at"], "left").select("key", "id", (~(F.coalesce("miss", F.lit(False)) & F.col("first"))).alias("hit"))
    return out if cleared is None else out.select("key.key", "id", "hit")


def cache_stats(hits: DataFrame, by: list[str]) -> DataFrame:
    """hits, misses and hit_rate (3 places) of each group."""
    hit, all_ = F.count_if("hit"), F.count("*")
    return hits.groupBy(*by).agg(hit.alias("hits"), (all_ - hit).alias("misses"), F.round(hit / all_, 3).alias("hit_rate"))
