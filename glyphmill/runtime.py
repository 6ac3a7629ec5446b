"""The folder that cut lineage is written to, and numbering of rows over partitions."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that's unset and the session is of one machine, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not re.fullmatch(r"local(\[.*)?", sc.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="glyphmill-"))
    return sc.getCheckpointDir()


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`: the row's number from 1 in the given order.

    Rows are dealt by ranges of the order and numbered in their range; only the ranges' sizes meet in one place.
    """
    checkpoint_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    own = dealt.withColumn(name, F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    before = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    return own.join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")
