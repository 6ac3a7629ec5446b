"""Cutting lineage, shared folders, global offsets and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the setting is absent (tests, local mode)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder now: later steps reread it, also after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of texts be small, unless the session asks for smaller ones yet."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node reachable.

    Alternates the two star operations of Kiveris et al. (2014) until nothing changes. Both are min-aggregations with
    map-side combining plus an equi-join, so a hub's neighbours are never gathered in one row. Each round is checkpointed.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u hangs on u's smallest neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e2 = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e2.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen, e = tuple(now), e2
    roots = e2.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e2.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def by_bytes(df: DataFrame, columns: list[str], kernel: Callable, schema: str) -> DataFrame:
    """mapInArrow over only the named columns."""
    return df.select(*columns).mapInArrow(kernel, schema)


def running_start(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over all rows before this one in the given order.

    Rows are range-partitioned and summed in their partition; only one total a partition goes through the driver.
    """

    def kernel(batches):
        from pyspark import TaskContext

        total, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            v = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            stop = total + np.cumsum(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stop - v), pa.array(np.full(len(v), part, np.int64))], names=[*batch.schema.names, name, "part"])
            total = int(stop[-1]) if len(stop) else total

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    local = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(kernel, f"{fields}, `{name}` long, part long"))
    before, base = 0, [(-1, 0)]
    for part, total in sorted((r[0], r[1]) for r in local.groupBy("part").agg(F.max(F.col(name) + F.col(value))).collect()):
        base.append((part, before))
        before += total
    bases = df.sparkSession.createDataFrame(base, "part long, base long")
    return local.join(F.broadcast(bases), "part").withColumn(name, F.col(name) + F.col("base")).drop("part", "base")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


_FILTER_BITS = 25


class KeyFilter:
    """A Bloom filter of fixed size over long keys: never misses one; with more keys it only lets more others pass."""

    def __init__(self, keys: DataFrame, key: str):
        spots = keys.select(F.explode(F.array(*(F.shiftrightunsigned(key, s).bitwiseAND((1 << _FILTER_BITS) - 1) for s in (0, 32)))).alias("at"))
        words = spots.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS INT)))").alias("bits")).toArrow()
        bits = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
        bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
        self.shared = keys.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    @staticmethod
    def test(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        k, found = keys.view(np.uint64), np.ones(len(keys), bool)
        for s in (0, 32):
            spot = ((k >> np.uint64(s)) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
            found &= (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
        return found

    def may_hold(self, df: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be among the keys."""
        shared, at, test = self.shared, df.columns.index(key), self.test

        def kernel(batches):
            for batch in batches:
                yield batch.filter(pa.array(test(shared.value, batch.column(at).to_numpy())))

        return df.mapInArrow(kernel, df.schema)
