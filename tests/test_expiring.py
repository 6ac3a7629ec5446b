"""Caches and windows: logs against loops, streams against logs, and state that expires."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import caching as C
from glyphmill.streaming import expiring as X

REQUEST = "key string, id long, at double"


@pytest.fixture
def settled(spark):
    keys = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")
    before = {k: spark.conf.get(k, None) for k in keys}
    X.settle(spark)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def log(n=600, seed=3):
    rng = random.Random(seed)
    rows = [(f"k{min(int(rng.expovariate(0.3)), 9)}", i, float(rng.choice([rng.randint(0, 900), rng.randint(0, 90) * 10]))) for i in range(n)]
    return sorted(rows, key=lambda r: (r[2], r[1]))


def brute_hits(rows, seconds, cleared=()):
    ends, out = {}, {}
    moves = [(at, 1, i, key) for key, i, at in rows] + [(at, 0, -1, key) for key, at in cleared]
    for at, kind, i, key in sorted(moves):
        if not kind:
            ends.pop(key, None)
            continue
        out[key, i] = key in ends and at < ends[key]
        if not out[key, i]:
            ends[key] = at + seconds
    return out


@pytest.mark.parametrize("seconds", [0.5, 7, 60, 5000])
def test_cache_hits(spark, seconds):
    rows = log()
    df = spark.createDataFrame([*rows, (None, -1, 5.0), ("k1", -2, None)], REQUEST).repartition(5)
    want = brute_hits(rows, seconds)
    assert {(r["key"], r["id"]): r["hit"] for r in C.cache_hits(df, seconds).collect()} == want
    assert 0 < sum(want.values()) < len(want)
    cleared = [("k1", 100.0), ("k1", 101.0), ("k0", 400.0), ("k0", 400.0), ("zz", 1.0), ("k2", rows[300][2])]
    got = C.cache_hits(df, seconds, spark.createDataFrame(cleared, "key string, at double"))
    assert {(r["key"], r["id"]): r["hit"] for r in got.collect()} == brute_hits(rows, seconds, cleared)
    stats = C.cache_stats(C.cache_hits(df, seconds), []).first()
    assert (stats["hits"], stats["misses"]) == (sum(want.values()), len(want) - sum(want.values()))
    assert C.cache_hits(df.limit(0), seconds).count() == 0


def run(stream, mode, checkpoint, out):
    """All that is there, as one or more batches; rows are appended to out, the last progress with state is returned."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    assert q.awaitTermination(120) and q.exception() is None
    return [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]


def feed(spark, schema, parts, path, build, mode, checkpoint, pause=0.0):
    out, seen = [], []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
        seen += run(build(spark.readStream.schema(schema).parquet(str(path))), mode, checkpoint, out)
        time.sleep(pause)
    return out, seen


def test_streamed_cache_is_the_log(settled, tmp_path):
    rows = log()
    out, _ = feed(settled, REQUEST, [rows[:150], rows[150:151], rows[151:400], rows[400:]], tmp_path / "in", lambda s: X.cached(s, 60, 600_000), "append", tmp_path / "cp")
    assert {(r["key"], r["id"]): r["hit"] for r in out} == brute_hits(rows, 60) and len(out) == len(rows)


def held(spark, checkpoint, name):
    return {r["key"][0] for r in spark.read.format("statestore").option("path", str(checkpoint)).option("stateVarName", name).load().collect()}


def test_entries_expire(settled, tmp_path):
    """An entry that is over is gone from the state after the next batch, so the state doesn't grow with all keys ever seen."""
    parts = [[(f"old{i}", i, 0.0) for i in range(40)], [("new", 100, 9.0)], [("old3", 101, 9.5), ("new", 102, 9.5)]]
    out, _ = feed(settled, REQUEST, parts[:2], tmp_path / "in", lambda s: X.cached(s, 2.0), "append", tmp_path / "cp", pause=3.0)
    assert held(settled, tmp_path / "cp", "entry") <= {"new"}
    more, _ = feed(settled, REQUEST, parts[2:], tmp_path / "in", lambda s: X.cached(s, 2.0), "append", tmp_path / "cp")
    assert {r["key"]: r["hit"] for r in more}["old3"] is False and len(out) == 41
    assert not {f"old{i}" for i in range(40) if i != 3} & held(settled, tmp_path / "cp", "entry")


def test_lifecycle_goes_on_over_batches_and_is_forgotten(settled, tmp_path):
    schema = "run_id long, event string, at long"
    parts = [[(1, "start", 1), (2, "start", 1), (2, "fail", 2), (3, "complete", 1)], [(1, "complete", 5), (2, "retry", 6), (9, "nonsense", 6)]]
    out, _ = feed(settled, schema, parts, tmp_path / "in", X.run_lifecycle, "update", tmp_path / "cp")
    last = {r["run_id"]: (r["status"], r["refused"]) for r in out}
    assert last == {1: ("COMPLETED", 0), 2: ("PENDING", 0), 3: ("PENDING", 1), 9: ("PENDING", 1)}
    brief = lambda s: X.run_lifecycle(s, keep_ms=1500)
    feed(settled, schema, [[(1, "start", 1), (2, "start", 1)], [(3, "start", 9)]], tmp_path / "in2", brief, "update", tmp_path / "cp2", pause=2.5)
    assert held(settled, tmp_path / "cp2", "run") <= {3}


def test_limiter_goes_on_over_batches_and_forgets(settled, tmp_path):
    times = [0, 1, 2, 9.9, 10.5, 11.5]
    rows = [("a", i, float(t)) for i, t in enumerate(times)]
    out, _ = feed(settled, REQUEST, [rows[:2], rows[2:4], rows[4:]], tmp_path / "in", lambda s: X.rate_limit(s, 2, 10, 600_000), "append", tmp_path / "cp")
    assert [r["allowed"] for r in sorted(out, key=lambda r: r["id"])] == [True, True, False, False, True, True]
    feed(settled, REQUEST, [[(f"x{i}", i, 0.0) for i in range(30)], [("y", 99, 5.0)]], tmp_path / "in2", lambda s: X.rate_limit(s, 2, 1.5), "append", tmp_path / "cp2", pause=2.5)
    assert held(settled, tmp_path / "cp2", "times") <= {"y"}


def test_streamed_agreement_is_the_batch(spark, tmp_path):
    """Three chained aggregations in append mode give the closed windows of the batch, and only these."""
    rng = random.Random(4)
    rows = sorted(((rng.randint(1, 6), rng.choice("ab"), rng.choice([0.1, 0.2, 0.3]), 86_400 * rng.randint(0, 40) + rng.randint(0, 86_399)) for _ in range(900)), key=lambda r: r[3])
    schema = "image_id long, attribute_key string, value double, t long"
    at = lambda df: df.select("image_id", "attribute_key", "value", F.timestamp_seconds("t").alias("created_at"))
    out, _ = feed(spark, schema, [rows[:300], rows[300:600], rows[600:], [(1, "a", 0.1, 86_400 * 60)], [(1, "a", 0.1, 86_400 * 61)]], tmp_path / "in", lambda s: X.sliding_agreement(at(s), "7 days", "1 day", "1 hour"), "append", tmp_path / "cp")
    batch = {r["start"]: (r["rated"], r["judgments"], pytest.approx(r["agreement"])) for r in X.sliding_agreement(at(spark.createDataFrame(rows, schema)), "7 days", "1 day").collect()}
    assert {r["start"]: (r["rated"], r["judgments"], r["agreement"]) for r in out} == batch and len(out) == len(batch) > 40
