"""Connected regions of pixel masks, and what can be reached from seeds, as joins and min-aggregations.

A mask's pixels are first folded into runs (pixels next to one another in a row of the image), so the graph whose components
are sought has a node a run, not a pixel. The edges of a key with at most SMALL of them are an array of its row, and components of a
batch of such rows are found at once. Those of larger keys contract by alternating star rounds, a number that grows with the
logarithm of the graph, not with a region's length; every round is written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir

_ROW = 1 << 31
#: Edges of a key up to which they are an array of one row.
SMALL = 256


def _least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least one that the edges a - b lead to."""
    least = np.arange(n)
    while True:
        nearer = least.copy()
        np.minimum.at(nearer, a, least[b])
        np.minimum.at(nearer, b, least[a])
        nearer = nearer[nearer]
        if (nearer == least).all():
            return least
        least = nearer


def _of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, u, v (arrays of ends) -> a row a node: key, node, component."""
    for batch in batches:
        if not batch.num_rows:
            continue
        u, v = batch.column(1), batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), np.diff(u.offsets.to_numpy()))
        ends = np.empty(2 * len(row), dtype=[("row", "i8"), ("node", "i8")])
        ends["row"] = np.concatenate([row, row])
        ends["node"] = np.concatenate([u.flatten().to_numpy(), v.flatten().to_numpy()])
        nodes, at = np.unique(ends, return_inverse=True)
        least = _least_reachable(len(nodes), at[: len(row)], at[len(row) :])
        keys = batch.column(0).take(pa.array(nodes["row"]))
        yield pa.RecordBatch.from_arrays([keys, pa.array(nodes["node"]), pa.array(nodes["node"][least])], names=[batch.schema.names[0], "node", "component"])


def _of_small(edges: DataFrame, key: str) -> DataFrame:
    ends = edges.groupBy(key).agg(F.collect_list(F.struct("u", "v")).alias("e"))
    of, node = edges.schema[key].dataType.simpleString(), edges.schema["u"].dataType
    found = ends.select(key, F.transform("e", lambda e: e["u"].cast("long")).alias("u"), F.transform("e", lambda e: e["v"].cast("long")).alias("v")).mapInArrow(_of_rows, f"`{key}` {of}, node long, component long")
    return found.select(key, *(F.col(c).cast(node).alias(c) for c in ("node", "component")))


def components(edges: DataFrame, key: str, u: str = "u", v: str = "v") -> DataFrame:
    """(key, node, component) of every node of the edges, which join nodes (whole numbers) of the same key; component is the least node reachable.

    Large star: each larger neighbour of a node hangs on the node's least neighbour; small star: each smaller one does. Edges are
    kept once, larger end first. Done when a round changes nothing.
    """
    checkpoint_dir(edges.sparkSession)
    e = edges.select(key, F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").repartition(key).distinct()
    e = e.withColumn("__n", F.count("*").over(W.partitionBy(key))).checkpoint()
    small = _of_small(e.where(F.col("__n") <= SMALL).drop("__n"), key)
    e = e.where(F.col("__n") > SMALL).drop("__n")
    if e.isEmpty():
        return small
    before = None
    while True:
        ways = e.unionByName(e.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = ways.groupBy(key, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.where("v > u").join(nearest, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy(key, "u").agg(F.min("v").alias("m"))
        hung = large.join(least, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v"))
        e = hung.unionByName(least.select(key, "u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64(key, "u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(key, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return small.unionByName(e.select(key, F.col("u").alias("node"), F.col("v").alias("component"))).unionByName(roots)


def runs(pixels: DataFrame, key: str) -> DataFrame:
    """(key, y, lo, hi, run): pixels (key, x, y) folded along rows; run orders runs as pixels are read."""
    own = W.partitionBy(key, "y").orderBy("x")
    # dealt by row of the image once: the distinct pixels are numbered and folded where they are
    step = pixels.select(key, "x", "y").repartition(key, "y").distinct().withColumn("s", F.col("x") - F.row_number().over(own))
    folded = step.groupBy(key, "y", "s").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).drop("s")
    return folded.withColumn("run", F.col("y").cast("long") * F.lit(_ROW) + F.col("lo"))


def regions(pixels: DataFrame, key: str, diagonal: bool = False) -> DataFrame:
    """(key, y, lo, hi, region): the runs of a mask's pixels (key, x, y) with the number of their region.

    Pixels are joined by their sides, with `diagonal` by their corners too. Regions count from 1 for each key, in the order of
    their first pixels, row by row.
    """
    checkpoint_dir(pixels.sparkSession)
    held, slack = runs(pixels, key).checkpoint(), int(diagonal)
    below = held.select(key, (F.col("y") - 1).alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("run").alias("run2"))
    meets = (F.col("lo2") <= F.col("hi") + slack) & (F.col("hi2") >= F.col("lo") - slack)
    found = components(held.join(below, [key, "y"]).where(meets).select(key, F.col("run").alias("u"), F.col("run2").alias("v")), key)
    rooted = held.join(found.withColumnRenamed("node", "run"), [key, "run"], "left").withColumn("component", F.coalesce("component", "run"))
    numbered = rooted.select(key, "component").distinct().withColumn("region", F.row_number().over(W.partitionBy(key).orderBy("component")))
    return rooted.join(numbered, [key, "component"]).select(key, "y", "lo", "hi", "region")


def unfolded(found: DataFrame, key: str) -> DataFrame:
    """(key, x, y, region): runs as pixels again."""
    return found.select(key, F.explode(F.sequence("lo", "hi")).alias("x"), "y", "region")


def reached(pixels: DataFrame, key: str, seed: str, diagonal: bool = True) -> DataFrame:
    """(key, x, y): the pixels (key, x, y, seed) of every region that has a pixel whose `seed` is true."""
    own = unfolded(regions(pixels, key, diagonal), key).join(pixels.select(key, "x", "y", seed), [key, "x", "y"])
    seeded = own.groupBy(key, "region").agg(F.bool_or(seed).alias("seeded")).where("seeded").drop("seeded")
    return own.join(seeded, [key, "region"]).select(key, "x", "y")


def region_sizes(found: DataFrame, key: str) -> DataFrame:
    """(key, region, size, x, y): pixels and centroid."""
    many = F.col("hi") - F.col("lo") + 1
    sums = found.groupBy(key, "region").agg(F.sum(many).alias("size"), F.sum(many * (F.col("lo") + F.col("hi")) / 2).alias("sx"), F.sum(many * F.col("y")).alias("sy"))
    return sums.select(key, "region", "size", (F.col("sx") / F.col("size")).alias("x"), (F.col("sy") / F.col("size")).alias("y"))
