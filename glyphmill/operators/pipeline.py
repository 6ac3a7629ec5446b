"""Around a feature pipeline: requirements, tiers, provenance, runs, composites with bins, detail views, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Tiers of analyzers in order.
TIERS = ["L0", "L1", "L2", "L3"]


def missing_requirements(analyzers: DataFrame, available: DataFrame) -> DataFrame:
    """analyzers: name, requires (array); available: item, provided (array). What an analyzer lacks on an item."""
    # analyzers are a fixed, short list
    return available.join(F.broadcast(analyzers)).select("item", "name", F.array_except("requires", "provided").alias("missing")).where(F.size("missing") > 0)


def tier_violations(steps: DataFrame) -> DataFrame:
    """steps: pipeline, position, name, tier. Steps of a lower tier than the one before them."""
    rank = F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col("tier"))
    s = steps.withColumn("rank", rank)
    before = W.partitionBy("pipeline").orderBy("position")
    return s.withColumn("previous", F.lag("rank").over(before)).where("rank < previous").select("pipeline", "position", "name", "tier")


def provenance(attributes: DataFrame) -> DataFrame:
    """attributes: item, key, level. Per level the number of attributes and their keys."""
    return attributes.groupBy("level").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("key")).alias("keys"))


def richness(wide: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The mean of the columns that aren't null, and its bin; null without any."""
    there = F.filter(F.array(*columns), lambda x: x.isNotNull())
    mean = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))
    return wide.withColumn(name, mean).withColumn(f"{name}_bin", F.when(F.col(name).isNotNull(), S.index_bin(F.col(name))))


def request_runs(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Runs after a request: a new one is PENDING, a FAILED or STALE one is PENDING again, others stay."""
    j = wanted.select(*keys).distinct().withColumn("wanted", F.lit(True)).join(existing.select(*keys, F.col("status").alias("old")), keys, "full")
    retry = F.col("wanted").isNotNull() & (F.col("old").isNull() | F.col("old").isin("FAILED", "STALE"))
    return j.select(*keys, F.when(retry, "PENDING").otherwise(F.col("old")).alias("status"), F.coalesce(retry, F.lit(False)).alias("queued"))


def progress(rows: DataFrame, done: Column, started: Column, now: Column) -> DataFrame:
    """Throughput of a backfill and the seconds that the rest will take."""
    n, k = F.count("*"), F.count_if(done)
    seconds = F.timestamp_diff("SECOND", F.min(started), now)
    return rows.agg(n.alias("total"), k.alias("done"), seconds.alias("elapsed_s")).withColumn("per_s", F.try_divide("done", "elapsed_s")).withColumn("eta_s", F.try_divide(F.col("total") - F.col("done"), F.col("per_s")))


def migrate(tags: DataFrame) -> DataFrame:
    """Content migrations: extractability spelt alike, a status for every tag; with what each changed."""
    low = F.lower(F.trim("from_2d"))
    norm = F.when(low.isin("y", "true", "yes"), "yes").when(low.isin("n", "false", "no"), "no").when(low.isin("partially", "some", "partial"), "partial").otherwise(F.col("from_2d"))
    status = F.when(F.coalesce("status", F.lit("")) == "", "active").otherwise(F.col("status"))
    return tags.withColumns({"__e": ~norm.eqNullSafe(F.col("from_2d")), "__s": ~status.eqNullSafe(F.col("status")), "from_2d": norm, "status": status}).withColumnsRenamed({"__e": "extractability_changed", "__s": "status_changed"})


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) of each field that differs in rows of both versions."""
    j = old.select(key, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields)).join(new.select(key, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields)), key)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("before"), F.col(f"b_{f}").alias("after")) for f in fields)))
    return j.select(key, each.alias("c")).select(key, "c.*").where(~F.col("before").eqNullSafe(F.col("after")))


def node_names(texts: DataFrame, id_col: str, text_col: str, pattern: str = r"\b([A-Z][A-Z0-9_]{2,})\b") -> DataFrame:
    """Distinct upper-case names in texts."""
    return texts.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1))).alias("node")).distinct()


def request_flags(df: DataFrame, column: str) -> DataFrame:
    """Whether a text looks like SQL injection, script injection or path traversal."""
    c = F.col(column)
    return df.withColumns({"sql": c.rlike(r"(?i)\b(union\s+select|drop\s+table|insert\s+into|delete\s+from)\b|--|;\s*$"), "script": c.rlike(r"(?i)<script|javascript:|on\w+\s*="), "traversal": F.contains(c, F.lit("..")) | c.rlike(r"(?i)%2e%2e")})


def split_detail(attributes: DataFrame, prefix: str = "science_pipeline") -> DataFrame:
    """Per item two sorted lists of its latest values: from the pipeline and from people."""
    latest = attributes.groupBy("item", "key", F.col("source").startswith(prefix).alias("science")).agg(F.max_by("value", F.struct("created_at", "value")).alias("value"))
    pairs = F.struct("key", "value")
    return latest.groupBy("item").agg(F.sort_array(F.collect_list(F.when(F.col("science"), pairs))).alias("science"), F.sort_array(F.collect_list(F.when(~F.col("science"), pairs))).alias("human"))


#: Composite indices that a network may take as inputs, their labels and the column of their bins.
INDEX_CATALOG = [
    ("science.visual_richness", "Visual richness", "science.visual_richness_bin"),
    ("science.organized_complexity", "Organized complexity", "science.organized_complexity_bin"),
    ("biophilia.index", "Biophilia index", None),
]
STATES = ["low", "mid", "high"]
#: What kind of claim an attribute makes.
LEVELS = ["proximal", "derived", "structural", "hypothesis"]


def codebook(spark) -> DataFrame:
    """(key, role, type, state) of the catalogue's indices and their bins: a row a state, null for numbers."""
    rows = [(k, "index", "float", None) for k, _, _ in INDEX_CATALOG] + [(b, "bin", "category", s) for _, _, b in INDEX_CATALOG if b for s in STATES]
    return spark.createDataFrame(rows, "key string, role string, type string, state string")


def missing_indices(snapshots: DataFrame, codes: DataFrame) -> DataFrame:
    """snapshots: item, key. Indices of the codebook that an item lacks."""
    wanted = codes.where("role = 'index'").select("key").distinct()
    return snapshots.select("item").distinct().join(F.broadcast(wanted)).join(snapshots.select("item", "key").distinct(), ["item", "key"], "left_anti")  # a short list of indices


def at_level(values: DataFrame, level: str, source: str, confidence: float = 1.0) -> DataFrame:
    """values: item, key, value. Rows of one level of claim; values that aren't finite are left out."""
    if level not in LEVELS:
        raise ValueError(f"no level {level}")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs(F.col("value")) != float("inf"))
    return values.where(finite).select("item", "key", F.col("value").cast("double").alias("value"), F.lit(level).alias("level"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
