"""Streams whose state expires: a cache with a time to live, run lifecycles, rate limits; and agreement in sliding windows.

State lives in RocksDB and every key's row has a time to live, counted from its last change by the clock of the machine. It
must be no shorter than what the answer depends on (the cache's time to live, the limiter's window), and rows must not come
later than that; then an expired row can't change an answer. A key's rows of one micro-batch are sorted in one task, so the
trigger's batch size (maxFilesPerTrigger and the like) bounds what a task holds.

`settle` sets what such streams need in the session: the state store, and that no batch runs without rows. Without the second
a stream with a clock never runs out of batches, and availableNow never ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ledger import TRANSITIONS, allow

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settle(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


class Cache(StatefulProcessor):
    """Of each request of a key whether its entry is there; a miss makes one that holds for `seconds` and isn't prolonged by hits."""

    def __init__(self, seconds: float, keep_ms: int):
        self.seconds, self.keep_ms = seconds, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "expires double", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = _sorted(rows, "at", "id")
        at, hit = held["at"].to_numpy(), np.ones(len(held), bool)
        expires = self.entry.get()[0] if self.entry.exists() else -np.inf
        k = int(np.searchsorted(at, expires))
        if k < len(at):
            while k < len(at):
                hit[k], expires = False, at[k] + self.seconds
                k = max(k + 1, int(np.searchsorted(at, expires)))
            self.entry.update((float(expires),))
        yield pd.DataFrame({"key": key[0], "id": held["id"].to_numpy(), "hit": hit})

    def close(self) -> None: ...


class Lifecycle(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "status string, refused long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, refused = self.run.get() if self.run.exists() else ("PENDING", 0)
        for event in _sorted(rows, "at")["event"]:
            new = TRANSITIONS.get((status, event))
            refused += new is None
            status = new or status
        self.run.update((status, refused))
        yield pd.DataFrame({"run_id": [key[0]], "status": [status], "refused": [refused]})

    def close(self) -> None: ...


class Limiter(StatefulProcessor):
    def __init__(self, limit: int, seconds: float, keep_ms: int):
        self.limit, self.seconds, self.keep_ms = limit, seconds, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "seen array<double>", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = _sorted(rows, "at", "id")
        ok, wait, seen = allow(held["at"].tolist(), list(self.times.get()[0]) if self.times.exists() else [], self.limit, self.seconds)
        self.times.update((seen,))
        yield pd.DataFrame({"key": key[0], "id": held["id"].to_numpy(), "allowed": ok, "retry_after": wait})

    def close(self) -> None: ...


def cached(requests: DataFrame, seconds: float, keep_ms: int | None = None) -> DataFrame:
    """requests: a stream of key, id, at (seconds). (key, id, hit) as requests come."""
    settle(requests.sparkSession)
    return requests.groupBy("key").transformWithStateInPandas(Cache(seconds, keep_ms or int(seconds * 1000)), "key string, id long, hit boolean", "append", "processingTime")


def run_lifecycle(events: DataFrame, keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """events: a stream of run_id, event, at. The status of each run after each batch of its events; a run unheard of for keep_ms is forgotten, and starts as PENDING again."""
    settle(events.sparkSession)
    return events.groupBy("run_id").transformWithStateInPandas(Lifecycle(keep_ms), "run_id long, status string, refused long", "update", "processingTime")


def rate_limit(requests: DataFrame, limit: int, seconds: float, keep_ms: int | None = None) -> DataFrame:
    """requests: a stream of key, id, at (seconds). Whether each is allowed, and how long to wait; a key's times are kept for the window after its last request."""
    settle(requests.sparkSession)
    return requests.groupBy("key").transformWithStateInPandas(Limiter(limit, seconds, keep_ms or int(seconds * 1000)), "key string, id long, allowed boolean, retry_after double", "append", "processingTime")


def sliding_agreement(validations: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """validations: image_id, attribute_key, value, created_at (a timestamp with session zone). Per window: start, rated, judgments, agreement.

    Three aggregations one upon the other, of streams in append mode: judgments of each value; equal pairs of all pairs of each
    image and attribute with two judgments or more; their mean over all of these. Each is final when the watermark passes the window,
    and the state is that of the open windows. Values are compared exactly; pairs are counted, not made. Batch frames work too.
    """
    if validations.isStreaming:
        each, place, many = validations.withWatermark("created_at", late), F.window("created_at", window, slide), F.count("*")
    else:
        # equal judgments are counted and an image's attribute dealt to one task first, so that no row is shuffled once a window
        keys = ["image_id", "attribute_key"]
        length, step = (F.expr(f"unix_micros(timestamp_micros(0) + cast('{d}' AS interval))") for d in (window, slide))
        at = F.unix_micros("created_at")
        starts = F.filter(F.transform(F.sequence(F.lit(0), F.ceil(length / step) - 1), lambda i: at - F.pmod(at, step) - i * step), lambda v: v + length > at)
        each = validations.where("created_at IS NOT NULL").groupBy(*keys, "value", "created_at").agg(F.count("*").alias("many")).repartition(*keys)
        each = each.select(*keys, "value", "many", F.explode(starts).alias("v")).withColumn("window", F.struct(F.timestamp_micros("v").alias("start")))
        place, many = F.col("window"), F.sum("many")
    same = each.groupBy(place, "image_id", "attribute_key", "value").agg(many.alias("c"))
    pairs = same.groupBy("window", "image_id", "attribute_key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("equal"))
    shares = pairs.where("n >= 2").withColumn("share", F.col("equal") / (F.col("n") * (F.col("n") - 1) / 2))
    return shares.groupBy("window").agg(F.count("*").alias("rated"), F.sum("n").alias("judgments"), F.avg("share").alias("agreement")).select(F.col("window.start").alias("start"), "rated", "judgments", "agreement")
