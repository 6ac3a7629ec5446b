"""Analytics over validations (item, attribute, rater or run, value): rates, agreement, snapshots, queues, search.

Agreement is closed-form on value counts, never a self-join of raters: a group of n equal judgments has n(n-1)/2 agreeing
pairs. All aggregations are partial before the shuffle. "Latest" is the greatest (created_at, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S


def within_hours(df: DataFrame, as_of: Column, hours: float, default: float = 24, ts: str = "created_at") -> DataFrame:
    """Rows of the last hours before as_of; non-positive hours mean the default."""
    return df.where(F.col(ts) >= as_of - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {3600 * (hours if hours > 0 else default)})"))


def velocity(validations: DataFrame, users: DataFrame) -> DataFrame:
    """Per rater: images validated, mean duration (truncated) and whether there's any. A null rater is `unknown`, id 0."""
    each = validations.groupBy("user_id").agg(F.countDistinct("image_id").alias("images_validated"), F.avg("duration_ms").alias("d"))
    named = each.join(users, each["user_id"] == users["id"], "left")
    return named.select(F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), F.coalesce("username", F.lit("unknown")).alias("username"), "images_validated", F.coalesce("d", F.lit(0)).cast("int").alias("avg_duration_ms"), F.when(F.col("images_validated") > 0, "active").otherwise("idle").alias("status"))


def agreement(validations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per key with two or more judgments: n, agreeing and conflicting pairs, and the share that agrees."""
    keys = keys or ["image_id", "attribute_key"]
    counted = validations.groupBy(*keys, "value").agg(F.count("*").alias("c"))
    pairs = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.expr("c * (c - 1) div 2")).alias("agree")).where("n >= 2")
    total = F.expr("n * (n - 1) div 2")
    return pairs.select(*keys, "n", (F.col("agree") / total).alias("agreement_score"), (total - F.col("agree")).alias("conflict_count"))


def agreement_with_raters(validations: DataFrame, users: DataFrame, images: DataFrame) -> DataFrame:
    """Agreement with the image's file name and the sorted names of its raters."""
    named = validations.join(users, validations["user_id"] == users["id"], "left").groupBy("image_id", "attribute_key").agg(F.sort_array(F.collect_set(F.coalesce("username", F.lit("unknown")))).alias("raters"))
    return agreement(validations).join(named, ["image_id", "attribute_key"]).join(images.select(F.col("id").alias("image_id"), "filename"), "image_id")


def image_agreement(validations: DataFrame) -> DataFrame:
    """Per image: the mean agreement of its attributes, and its bin."""
    return agreement(validations).groupBy("image_id").agg(F.avg("agreement_score").alias("agreement_score")).withColumn("irr_bin", S.agreement_bin(F.round("agreement_score", 9)))


def latest(validations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return validations.groupBy(*(keys or ["image_id", "attribute_key"])).agg(F.max_by("value", F.struct("created_at", "value")).alias("value"))


def snapshot(images: DataFrame, validations: DataFrame, attributes: list[str], prefix: str = "science_pipeline") -> DataFrame:
    """Wide: an image a row, the latest pipeline value of each attribute and its bin, agreement and its bin."""
    wide = latest(validations.where(F.col("source").startswith(prefix))).groupBy("image_id").pivot("attribute_key", attributes).agg(F.first("value"))
    out = images.select(F.col("id").alias("image_id")).join(wide, "image_id", "left").join(image_agreement(validations), "image_id", "left")
    return out.select("image_id", *(F.col(a).alias(f"index_{a}") for a in attributes), *(F.when(F.col(a).isNotNull(), S.index_bin(F.col(a))).alias(f"bin_{a}") for a in attributes), "agreement_score", "irr_bin")


def least_validated(images: DataFrame, validations: DataFrame, user_id: int, n: int) -> DataFrame:
    """The n images with fewest validations that a user hasn't judged."""
    done = validations.where(F.col("user_id") == user_id).select(F.col("image_id").alias("id"))
    counts = validations.groupBy("image_id").agg(F.count("*").alias("n_validations"))
    left = images.join(done, "id", "left_anti").join(counts, images["id"] == counts["image_id"], "left")
    return left.select("id", F.coalesce("n_validations", F.lit(0)).alias("n_validations")).orderBy("n_validations", "id").limit(n)


def search(images: DataFrame, validations: DataFrame, text: str | None = None, attributes: list[str] | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """Images whose name, path or kind holds the text and which have one of the attributes, a page at a time, newest id first."""
    size, page = max(1, min(size, 200)), max(1, page)
    out = images
    if text:
        t = F.lower(F.lit(text))
        out = out.where(F.contains(F.lower("filename"), t) | F.contains(F.lower("storage_path"), t) | F.contains(F.lower("kind"), t))
    if attributes:
        out = out.join(validations.where(F.col("attribute_key").isin(attributes)).select(F.col("image_id").alias("id")), "id", "left_semi")
    return out.orderBy(F.desc("id")).offset((page - 1) * size).limit(size)


def value_mode(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Per key: the most frequent value (of equally frequent ones the smallest), and its count."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.max(F.struct("c", (-F.col(value)).alias("v"))).alias("m")).select(*keys, (-F.col("m.v")).alias("mode_value"), F.col("m.c").alias("mode_count"))


def variance_audit(validations: DataFrame, min_n: int = 50, min_mode: float = 0.9, max_std: float = 0.02) -> DataFrame:
    """Attributes whose values, rounded to two places, have collapsed: one dominates, or there's no spread."""
    v = validations.withColumn("value", F.round("value", 2))
    stats = v.groupBy("attribute_key").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).where(F.col("n") >= min_n)
    out = stats.join(value_mode(v, ["attribute_key"]), "attribute_key").withColumn("mode_ratio", F.col("mode_count") / F.col("n"))
    return out.withColumn("collapsed", (F.col("mode_ratio") >= min_mode) | (F.col("std") < max_std))


def variance_audit_by_source(validations: DataFrame, min_n: int = 30) -> DataFrame:
    keys = ["attribute_key", "source"]
    stats = validations.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min_value"), F.max("value").alias("max_value")).where(F.col("n") >= min_n)
    out = stats.join(value_mode(validations, keys), keys).withColumn("range_value", F.col("max_value") - F.col("min_value")).withColumn("dominant_fraction", F.col("mode_count") / F.col("n"))
    return out.select(*keys, "n", "mean", "std", "min_value", "max_value", "range_value", F.col("mode_value").alias("dominant_value"), "dominant_fraction", (F.col("std") <= 0.02).alias("low_std"), (F.col("range_value") <= 0.05).alias("low_range"), (F.col("dominant_fraction") >= 0.95).alias("dominated"))


def daily_cost(usage: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Cost by day over a window of 1 to 90 days that starts at as_of's time of day."""
    days = max(1, min(days, 90))
    return usage.where(F.col("created_at") >= as_of - F.expr(f"make_interval(0, 0, 0, {days - 1})")).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.sum("cost_usd").alias("total_cost"))


def week_over_week(daily: DataFrame) -> DataFrame:
    """Sum of the last seven rows against the seven before, and the largest. daily: at most one row a day."""
    ranked = daily.withColumn("r", F.row_number().over(W.orderBy(F.desc("day"))))
    now, before = F.sum(F.when(F.col("r") <= 7, F.col("total_cost"))), F.sum(F.when(F.col("r").between(8, 14), F.col("total_cost")))
    return ranked.agg(now.alias("this_week"), before.alias("last_week"), F.try_divide(now - before, before).alias("change"), F.max("total_cost").alias("largest_day"))


def status_counts(runs: DataFrame, statuses: list[str]) -> DataFrame:
    return runs.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses), F.count("*").alias("total"))


def orphans(validations: DataFrame, known: DataFrame) -> DataFrame:
    """Attribute keys in use that no registry row has."""
    return validations.select("attribute_key").distinct().join(known, "attribute_key", "left_anti")


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Rows per bucket of upper bound, and cumulatively; the buckets are as many as the bounds."""
    bucket = F.lit(float("inf"))
    for b in reversed(bounds):
        bucket = F.when(F.col(value) <= b, F.lit(b)).otherwise(bucket)
    counts = df.groupBy(bucket.alias("le")).agg(F.count("*").alias("n"))
    return counts.withColumn("cumulative", F.sum("n").over(W.orderBy("le").rowsBetween(W.unboundedPreceding, 0)))


def histogram_percentile(buckets: DataFrame, p: float) -> DataFrame:
    """The smallest upper bound that holds a share p of the rows."""
    total = buckets.agg(F.max("cumulative").alias("total"))
    return buckets.join(F.broadcast(total)).where(F.col("cumulative") >= p * F.col("total")).agg(F.min("le").alias("percentile"))


def pool(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, spread, quartiles and extremes of a region's values; NaN is left out."""
    v = df.where(~F.isnan(value))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return v.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), q[0].alias("p25"), q[1].alias("median"), q[2].alias("p75"), F.count("*").alias("n"))


def first_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def confusion(pairs: DataFrame, truth: str, pred: str, ignore: int | None = None) -> DataFrame:
    """Per class: intersection over union, F1 and support, from counts of (truth, prediction)."""
    p = pairs if ignore is None else pairs.where(F.col(truth) != ignore)
    c = p.groupBy(truth, pred).agg(F.count("*").alias("c"))
    rows, cols = c.groupBy(F.col(truth).alias("k")).agg(F.sum("c").alias("r")), c.groupBy(F.col(pred).alias("k")).agg(F.sum("c").alias("s"))
    hits = c.where(F.col(truth) == F.col(pred)).select(F.col(truth).alias("k"), "c")
    both = rows.join(cols, "k", "full").join(hits, "k", "left").fillna(0)
    return both.select("k", (F.col("c") / (F.col("r") + F.col("s") - F.col("c"))).alias("iou"), (2 * F.col("c") / (F.col("r") + F.col("s"))).alias("f1"), F.col("r").alias("support"))
