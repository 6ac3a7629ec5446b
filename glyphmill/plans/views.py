"""Logical views over the driver tables. Timestamps stay without a zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("image_id"), F.col("l_suppkey").alias("user_id"), F.col("l_returnflag").alias("attribute_key"), F.col("l_discount").alias("value"),
        (F.col("l_quantity") * 100).cast("int").alias("duration_ms"), F.when(F.col("l_linestatus") == "O", "science_pipeline_v3.4").otherwise("manual").alias("source"), F.col("l_shipdate").alias("created_at"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("filename"), F.concat(F.lit("store/"), "p_name", F.lit(".jpg")).alias("storage_path"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_brand").alias("upload_batch_id"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("RUNNING")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("image_id"), status.alias("status"), F.col("o_orderdate").alias("queued_at"), F.col("o_orderpriority").alias("config_fingerprint"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("provider"), F.col("user_id").alias("tool_id"), F.col("value").alias("cost_usd"), F.col("props").alias("meta"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tag_id"), F.col("text").alias("definition"), F.col("lang").alias("domain"), F.col("source").alias("category"))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", (2 * F.pi() * F.hour("ts") / 24).alias("a"), "value")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 grey images: a row a pixel."""
    at = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("pos", "v"))
    return at.select("image_id", "label", "pos", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), F.floor((F.col("v").cast("double") + 1) * 128).cast("int").alias("grey"))
