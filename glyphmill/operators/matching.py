"""Images brought to one histogram, and paired tests by random signs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def average_histogram(pixels: DataFrame, key: str) -> DataFrame:
    """(value, n): the pixels of all images by value."""
    return pixels.groupBy("value").agg(F.count("*").alias("n"))


def matched(pixels: DataFrame, key: str, target: DataFrame, tie: Column) -> DataFrame:
    """pixels: key, value and others. The pixels with `matched`: the image's values, by rank, become those of the target (value, n).

    A pixel of rank r (from 0, equal ones by `tie`) of m takes the target's value at (2 r + 1) / 2 m of its pixels, counted from the
    lowest; so every image of m pixels gets the same values, and the order of its pixels stays. Ranks and values meet by an equality:
    for every image size that occurs the target is laid out once. Null values are left out.
    """
    own = pixels.where("value IS NOT NULL")
    ranked = own.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("value", tie)) - 1)
    sizes = own.groupBy(key).agg(F.count("*").alias("__m"))
    levels = target.where("n > 0").groupBy("value").agg(F.sum("n").alias("n"))
    steps = levels.select(F.col("value").alias("matched"), F.sum("n").over(W.orderBy("value")).alias("upto"), "n").withColumn("all", F.sum("n").over(W.partitionBy()))
    # rank r falls to the first level with upto / all >= (2 r + 1) / 2 m, so a level's last rank is floor((2 m upto - all) / 2 all)
    m, upto, all_ = (F.col(c).cast("decimal(18,0)") for c in ("__m", "upto", "all"))
    last = lambda u: F.floor((2 * m * u - all_) / (2 * all_)).cast("long")
    laid = sizes.select("__m").distinct().join(steps, F.lit(True)).select("__m", "matched", last(upto - F.col("n")).alias("a"), last(upto).alias("b")).where("b > a")
    slots = laid.select("__m", F.explode(F.sequence(F.col("a") + 1, "b")).alias("__r"), "matched")
    return ranked.join(sizes, key).join(slots, ["__m", "__r"]).drop("__m", "__r")


def signed_sums(rows: DataFrame, by: list[str], rounds: int) -> DataFrame:
    """rows: by, d (millionths), h (hexadecimal digits). (by, round, s, n): the sum of d, each turned where the round's digit is over 7; round 0 has d as it is.

    A batch adds up its rows for all rounds; of each batch and group only the sums leave the task. They are held in billions and the rest, so they're exact.
    """
    schema = StructType([rows.schema[c] for c in by] + StructType.fromDDL("n bigint, high array<bigint>, low array<bigint>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            group = np.zeros(b.num_rows, "int64")
            for c in by:
                code = b.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                group = np.unique(group * (b.num_rows + 2) + code + 1, return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            digits = np.array(b.column("h").to_pylist(), dtype=bytes).view("uint8").reshape(b.num_rows, -1)[order, :rounds]
            keep = np.concatenate([np.ones((b.num_rows, 1), bool), digits < ord("8")], axis=1)
            d = b.column("d").to_numpy()[order]
            parts = [np.add.reduceat(np.where(keep, v[:, None], -v[:, None]), starts, axis=0) for v in (d // 10**9, d % 10**9)]
            ends = np.arange(len(starts) + 1, dtype="int32") * (rounds + 1)
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in parts]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(order[starts])) for c in by), pa.array(np.diff(starts, append=b.num_rows)), *lists], names=schema.names)

    each = rows.mapInArrow(run, schema).select(*by, "n", F.posexplode(F.arrays_zip("high", "low")).alias("round", "v"))
    whole = (F.sum("v.high").cast("decimal(28,0)") * F.lit(10**9).cast("decimal(10,0)") + F.sum("v.low")).cast("decimal(38,0)")
    return each.groupBy(*by, "round").agg((whole / F.lit(10**6).cast("decimal(7,0)")).cast("decimal(38,6)").alias("s"), F.sum("n").alias("n"))


def sign_test(pairs: DataFrame, by: list[str], first: Column, second: Column, row: Column, rounds: int = 256, seed: str = "") -> DataFrame:
    """(by, n, mean, p_one, p_two): whether the mean of first - second could be chance.

    In each round every difference keeps or turns its sign by a digit of a digest of seed, row and round, so the result doesn't depend
    on where rows lie; all rounds are summed in one pass, in decimals, and only their sums are shuffled. p_one: share of rounds with a
    mean above the observed one; p_two: with one farther from zero. Pairs with a null are left out.
    """
    if rounds < 1:
        raise ValueError("at least one round is needed")
    digests = F.array_join(F.transform(F.sequence(F.lit(0), F.lit((rounds - 1) // 32)), lambda k: F.md5(F.concat_ws(":", F.lit(seed), row.cast("string"), k.cast("string")))), "")
    d = (first.cast("decimal(18,6)") - second.cast("decimal(18,6)")) * 1000000
    sums = signed_sums(pairs.select(*by, d.cast("long").alias("d"), digests.alias("h")).where("d IS NOT NULL AND h IS NOT NULL"), by, rounds)
    seen = sums.where("round = 0").select(*by, F.col("s").alias("seen"), "n")
    chance = sums.where("round > 0").select(*by, "s").join(seen, by) if by else sums.where("round > 0").select("s").join(seen, F.lit(True))
    return chance.groupBy(*by, "n", "seen").agg((F.count_if(F.col("s") > F.col("seen")) / rounds).alias("p_one"), (F.count_if(F.abs("s") > F.abs("seen")) / rounds).alias("p_two")).select(*by, "n", (F.col("seen").cast("double") / F.col("n")).alias("mean"), "p_one", "p_two")
