"""Queries of the annotation, ledger and run families over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation as A
from . import views as V
from .catalog import query

def _as_of():
    return F.lit("2024-01-31").cast("timestamp_ntz")


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("agg01_velocity", "SELECT v.user_id, coalesce(username, 'unknown') AS username, count(DISTINCT image_id) AS images_validated, CAST(trunc(avg(duration_ms)) AS INTEGER) AS avg_duration_ms, 'active' AS status FROM validations v LEFT JOIN users u ON u.id = v.user_id GROUP BY ALL")
def _(spark, d):
    return A.velocity(V.validations(spark, d), V.users(spark, d))


@query("agg02_total_cost", "SELECT round(coalesce(sum(cost_usd), 0), 4) AS total FROM usage")
def _(spark, d):
    return V.usage(spark, d).agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("total"))


@query("agg03_daily_cost", "SELECT strftime(created_at, '%Y-%m-%d') AS day, round(sum(cost_usd), 4) AS total_cost FROM usage WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 13 DAY GROUP BY 1")
def _(spark, d):
    return A.daily_cost(V.usage(spark, d), _as_of(), 14).withColumn("total_cost", F.round("total_cost", 4))


@query("agg04_run_status", "SELECT count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) AS total FROM runs")
def _(spark, d):
    return A.status_counts(V.runs(spark, d), ["PENDING", "RUNNING", "COMPLETED", "FAILED"])


_IRR = """c AS (SELECT image_id, attribute_key, value, count(*) AS c FROM validations GROUP BY ALL),
irr AS (SELECT image_id, attribute_key, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * (c - 1) // 2) AS BIGINT) AS agree FROM c GROUP BY ALL HAVING sum(c) >= 2),
score AS (SELECT image_id, attribute_key, n, agree / (n * (n - 1) / 2) AS agreement_score, CAST(n * (n - 1) // 2 - agree AS BIGINT) AS conflict_count FROM irr)"""


@query("agg05_irr_pairwise", f"""+{_IRR},
raters AS (SELECT image_id, attribute_key, list_sort(list(DISTINCT coalesce(username, 'unknown'))) AS raters FROM validations v LEFT JOIN users u ON u.id = v.user_id GROUP BY ALL)
SELECT s.image_id, filename, s.attribute_key, n, round(agreement_score, 6) AS agreement_score, conflict_count, raters FROM score s JOIN raters USING (image_id, attribute_key) JOIN images i ON i.id = s.image_id""")
def irr(spark, d):
    return _r(A.agreement_with_raters(V.validations(spark, d), V.users(spark, d), V.images(spark, d)), "agreement_score")


@query("agg06_image_irr", f"+{_IRR}, m AS (SELECT image_id, avg(agreement_score) AS a FROM score GROUP BY 1) SELECT image_id, round(a, 6) AS agreement_score, CASE WHEN round(a, 9) < 0.4 THEN 'low' WHEN round(a, 9) < 0.7 THEN 'medium' ELSE 'high' END AS irr_bin FROM m")
def _(spark, d):
    return _r(A.image_agreement(V.validations(spark, d)), "agreement_score")


@query("agg07_latest_value", "SELECT image_id, attribute_key, max(struct_pack(t := created_at, v := value)).v AS value FROM validations GROUP BY 1, 2")
def _(spark, d):
    return A.latest(V.validations(spark, d))


@query("agg08_snapshot", f"""+{_IRR},
latest AS (SELECT image_id, attribute_key, max(struct_pack(t := created_at, v := value)).v AS value FROM validations WHERE starts_with(source, 'science_pipeline') GROUP BY 1, 2),
wide AS (SELECT i.id AS image_id, max(value) FILTER (attribute_key = 'A') AS a, max(value) FILTER (attribute_key = 'N') AS n, max(value) FILTER (attribute_key = 'R') AS r FROM images i LEFT JOIN latest l ON l.image_id = i.id GROUP BY 1),
m AS (SELECT image_id, avg(agreement_score) AS s FROM score GROUP BY 1)
SELECT w.image_id, a AS "index_A", n AS "index_N", r AS "index_R", {", ".join(f'CASE WHEN {c} < 0.33 THEN $$low$$ WHEN {c} < 0.66 THEN $$mid$$ WHEN {c} IS NOT NULL THEN $$high$$ END AS "bin_{c.upper()}"' for c in "anr")},
round(s, 6) AS agreement_score, CASE WHEN round(s, 9) < 0.4 THEN 'low' WHEN round(s, 9) < 0.7 THEN 'medium' WHEN s IS NOT NULL THEN 'high' END AS irr_bin FROM wide w LEFT JOIN m USING (image_id)""")
def _(spark, d):
    return _r(A.snapshot(V.images(spark, d), V.validations(spark, d), ["A", "N", "R"]), "agreement_score")


_MODE = "mode AS (SELECT {k}, c AS mode_count, v AS mode_value FROM (SELECT {k}, v, count(*) AS c, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, v) AS r FROM src GROUP BY {k}, v) WHERE r = 1)"


@query("agg09_variance_audit", f"+src AS (SELECT attribute_key, round(value, 2) AS v FROM validations), {_MODE.format(k='attribute_key')} SELECT attribute_key, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, any_value(mode_value) AS mode_value, any_value(mode_count) AS mode_count, round(any_value(mode_count) / count(*), 6) AS mode_ratio, any_value(mode_count) / count(*) >= 0.9 OR stddev_pop(v) < 0.02 AS collapsed FROM src JOIN mode USING (attribute_key) GROUP BY attribute_key HAVING count(*) >= 50")
def _(spark, d):
    return _r(A.variance_audit(V.validations(spark, d)), "mean", "std", "mode_ratio")


@query("agg10_variance_audit_by_source", f"+src AS (SELECT attribute_key, source, value AS v FROM validations), {_MODE.format(k='attribute_key, source')} SELECT attribute_key, source, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min_value, max(v) AS max_value, round(max(v) - min(v), 6) AS range_value, any_value(mode_value) AS dominant_value, round(any_value(mode_count) / count(*), 6) AS dominant_fraction, stddev_pop(v) <= 0.02 AS low_std, max(v) - min(v) <= 0.05 AS low_range, any_value(mode_count) / count(*) >= 0.95 AS dominated FROM src JOIN mode USING (attribute_key, source) GROUP BY ALL HAVING count(*) >= 30")
def _(spark, d):
    return _r(A.variance_audit_by_source(V.validations(spark, d)), "mean", "std", "range_value", "dominant_fraction")


@query("agg22_latency_histogram", "SELECT le, n, CAST(sum(n) OVER (ORDER BY le) AS BIGINT) AS cumulative FROM (SELECT CASE WHEN cost_usd <= 1 THEN 1 WHEN cost_usd <= 5 THEN 5 WHEN cost_usd <= 25 THEN 25 WHEN cost_usd <= 100 THEN 100 ELSE CAST('inf' AS DOUBLE) END AS le, count(*) AS n FROM usage GROUP BY 1)")
def _(spark, d):
    return A.histogram(V.usage(spark, d), "cost_usd", [1.0, 5.0, 25.0, 100.0])


@query("agg22_histogram_percentile", "+h AS (SELECT CASE WHEN cost_usd <= 1 THEN 1 WHEN cost_usd <= 5 THEN 5 WHEN cost_usd <= 25 THEN 25 WHEN cost_usd <= 100 THEN 100 ELSE CAST('inf' AS DOUBLE) END AS le, count(*) AS n FROM usage GROUP BY 1), c AS (SELECT le, sum(n) OVER (ORDER BY le) AS c, sum(n) OVER () AS t FROM h) SELECT CAST(min(le) AS DOUBLE) AS percentile FROM c WHERE c >= 0.9 * t")
def _(spark, d):
    return A.histogram_percentile(A.histogram(V.usage(spark, d), "cost_usd", [1.0, 5.0, 25.0, 100.0]), 0.9)


@query("agg23_endpoint_rollup", "SELECT provider, count(*) AS n, count(DISTINCT tool_id) AS tools, round(sum(cost_usd), 4) AS cost FROM usage GROUP BY 1 ORDER BY n DESC, provider LIMIT 20")
def _(spark, d):
    return V.usage(spark, d).groupBy("provider").agg(F.count("*").alias("n"), F.countDistinct("tool_id").alias("tools"), F.round(F.sum("cost_usd"), 4).alias("cost")).orderBy(F.desc("n"), "provider").limit(20)


@query("agg24_error_rate", "SELECT round_even(count(*) FILTER (provider = 'error') / count(*), 4) AS error_rate FROM usage")
def _(spark, d):
    return V.usage(spark, d).agg(F.bround(F.try_divide(F.count_if(F.col("provider") == "error"), F.count("*")), 4).alias("error_rate"))


@query("agg25_cache_hit_rate", "SELECT provider, round_even(count(*) FILTER (cost_usd < 10) / count(*), 3) AS hit_rate, CASE WHEN count(*) FILTER (cost_usd < 10) / count(*) > 0.8 THEN 'excellent' WHEN count(*) FILTER (cost_usd < 10) / count(*) > 0.5 THEN 'good' ELSE 'poor' END AS effectiveness FROM usage GROUP BY 1")
def _(spark, d):
    rate = F.try_divide(F.count_if(F.col("cost_usd") < 10), F.count("*"))
    return V.usage(spark, d).groupBy("provider").agg(F.bround(rate, 3).alias("hit_rate"), F.when(rate > 0.8, "excellent").when(rate > 0.5, "good").otherwise("poor").alias("effectiveness"))


@query("agg32_region_pooling", "SELECT label, round(avg(grey), 6) AS mean, round(stddev_pop(grey), 6) AS std, min(grey) AS min, max(grey) AS max, round(quantile_cont(grey, 0.25), 6) AS p25, round(quantile_cont(grey, 0.5), 6) AS median, round(quantile_cont(grey, 0.75), 6) AS p75, count(*) AS n FROM pixels GROUP BY 1")
def _(spark, d):
    return _r(A.pool(V.pixels(spark, d), ["label"], "grey"), "mean", "std", "p25", "median", "p75")


@query("agg35_confusion", "+c AS (SELECT quality AS t, toxic AS p, count(*) AS c FROM labels GROUP BY 1, 2), r AS (SELECT t AS k, sum(c) AS r FROM c GROUP BY 1), s AS (SELECT p AS k, sum(c) AS s FROM c GROUP BY 1), h AS (SELECT t AS k, c FROM c WHERE t = p) SELECT k, round(coalesce(c, 0) / (coalesce(r, 0) + coalesce(s, 0) - coalesce(c, 0)), 6) AS iou, round(2 * coalesce(c, 0) / (coalesce(r, 0) + coalesce(s, 0)), 6) AS f1, CAST(coalesce(r, 0) AS BIGINT) AS support FROM r FULL JOIN s USING (k) LEFT JOIN h USING (k)")
def _(spark, d):
    return _r(A.confusion(V.table(spark, d, "labels"), "quality", "toxic"), "iou", "f1")


@query("agg37_dashboard", f"+{_IRR} SELECT round(avg(agreement_score), 6) AS global_irr, CAST(sum(n) AS BIGINT) AS judgments, count(*) FILTER (agreement_score < 0.4) AS flagged FROM score")
def _(spark, d):
    return A.agreement(V.validations(spark, d)).agg(F.round(F.avg("agreement_score"), 6).alias("global_irr"), F.sum("n").alias("judgments"), F.count_if(F.col("agreement_score") < 0.4).alias("flagged"))


@query("agg38_week_over_week", "+dd AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, sum(cost_usd) AS c, row_number() OVER (ORDER BY strftime(created_at, '%Y-%m-%d') DESC) AS r FROM usage WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 29 DAY GROUP BY 1), s AS (SELECT sum(c) FILTER (r <= 7) AS a, sum(c) FILTER (r BETWEEN 8 AND 14) AS b, max(c) AS m FROM dd) SELECT round(a, 4) AS this_week, round(b, 4) AS last_week, round((a - b) / b, 6) AS change, round(m, 4) AS largest_day FROM s")
def _(spark, d):
    out = A.week_over_week(A.daily_cost(V.usage(spark, d), _as_of(), 30))
    return out.select(F.round("this_week", 4).alias("this_week"), F.round("last_week", 4).alias("last_week"), F.round("change", 6).alias("change"), F.round("largest_day", 4).alias("largest_day"))


@query("jon01_training_export", "SELECT image_id, filename AS image_filename, attribute_key, value, user_id, duration_ms, created_at, 'human_validation' AS source FROM validations v JOIN images i ON i.id = v.image_id")
def training_export(spark, d):
    v, i = V.validations(spark, d), V.images(spark, d)
    return v.join(i, v["image_id"] == i["id"]).select("image_id", F.col("filename").alias("image_filename"), "attribute_key", "value", "user_id", "duration_ms", "created_at", F.lit("human_validation").alias("source"))


@query("jon03_least_validated_queue", "SELECT i.id, count(v.image_id) AS n_validations FROM images i LEFT JOIN validations v ON v.image_id = i.id WHERE NOT EXISTS (SELECT 1 FROM validations w WHERE w.image_id = i.id AND w.user_id = 7) GROUP BY 1 ORDER BY 2, 1 LIMIT 25")
def _(spark, d):
    return A.least_validated(V.images(spark, d), V.validations(spark, d), 7, 25)


@query("jon05_search", "SELECT id, filename, storage_path, kind, size, upload_batch_id FROM images i WHERE (contains(lower(filename), 'a') OR contains(lower(storage_path), 'a') OR contains(lower(kind), 'a')) AND EXISTS (SELECT 1 FROM validations v WHERE v.image_id = i.id AND attribute_key IN ('A', 'R')) ORDER BY id DESC LIMIT 40 OFFSET 40")
def _(spark, d):
    return A.search(V.images(spark, d), V.validations(spark, d), "a", ["A", "R"], 2, 40)


@query("jon06_images_with_runs", "SELECT image_id, count(*) AS n_runs, list_sort(list(DISTINCT config_fingerprint)) AS fingerprints FROM runs WHERE status = 'COMPLETED' GROUP BY 1")
def _(spark, d):
    return V.runs(spark, d).where("status = 'COMPLETED'").groupBy("image_id").agg(F.count("*").alias("n_runs"), F.sort_array(F.collect_set("config_fingerprint")).alias("fingerprints"))


@query("jon17_job_items", "SELECT c_custkey AS job_id, list_sort(list(o_orderkey)) AS items FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    c, o = V.table(spark, d, "customer"), V.table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"]).groupBy(F.col("c_custkey").alias("job_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("items"))


@query("flt04_pipeline_rows", "SELECT count(*) AS n, count(DISTINCT image_id) AS images FROM validations WHERE starts_with(source, 'science_pipeline')")
def _(spark, d):
    return V.validations(spark, d).where(F.col("source").startswith("science_pipeline")).agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("images"))


@query("flt07_recent_window", "SELECT id, cost_usd FROM usage WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR")
def _(spark, d):
    return A.within_hours(V.usage(spark, d), _as_of(), 48).select("id", "cost_usd")


@query("srt02_page", "SELECT id, filename FROM images ORDER BY id LIMIT 30 OFFSET 60")
def _(spark, d):
    return V.images(spark, d).select("id", "filename").orderBy("id").offset(60).limit(30)


@query("srt07_pending_fifo", "SELECT id, image_id, queued_at FROM runs WHERE status = 'PENDING' ORDER BY queued_at, id LIMIT 100")
def _(spark, d):
    return V.runs(spark, d).where("status = 'PENDING'").select("id", "image_id", "queued_at").orderBy("queued_at", "id").limit(100)


@query("set01_orphan_keys", "SELECT DISTINCT attribute_key FROM validations WHERE attribute_key NOT IN ('A', 'N')")
def _(spark, d):
    return A.orphans(V.validations(spark, d), spark.createDataFrame([("A",), ("N",)], "attribute_key string"))


@query("set02_candidates", "SELECT id FROM images WHERE id NOT IN (SELECT image_id FROM runs WHERE status IN ('COMPLETED', 'RUNNING'))")
def _(spark, d):
    return V.images(spark, d).select("id").join(V.runs(spark, d).where("status in ('COMPLETED', 'RUNNING')").select(F.col("image_id").alias("id")), "id", "left_anti")


@query("set03_common_keys", "SELECT image_id FROM validations INTERSECT SELECT image_id FROM runs")
def _(spark, d):
    return V.validations(spark, d).select("image_id").intersect(V.runs(spark, d).select("image_id"))


@query("set04_keys_by_prefix", "SELECT DISTINCT source || '/' || attribute_key AS key FROM validations ORDER BY 1")
def _(spark, d):
    v = V.validations(spark, d)
    key = F.concat_ws("/", "source", "attribute_key").alias("key")
    return v.where(F.col("source").startswith("science")).select(key).union(v.where(F.col("source") == "manual").select(key)).distinct().orderBy("key")


@query("win01_mode", f"+src AS (SELECT image_id, value AS v FROM validations), {_MODE.format(k='image_id')} SELECT image_id, mode_value, mode_count FROM mode")
def _(spark, d):
    return A.value_mode(V.validations(spark, d), ["image_id"])


@query("win06_first_per_group", "SELECT upload_batch_id, id, rank FROM (SELECT upload_batch_id, id, CAST(row_number() OVER (PARTITION BY upload_batch_id ORDER BY id) AS INTEGER) AS rank FROM images) WHERE rank <= 8")
def _(spark, d):
    return A.first_per_group(V.images(spark, d).select("upload_batch_id", "id"), "upload_batch_id", ["id"], 8)


@query("win03_normalised_share", "SELECT image_id, pos, round(grey / sum(grey) OVER (PARTITION BY image_id), 6) AS share FROM pixels")
def _(spark, d):
    from pyspark.sql import Window as W

    return V.pixels(spark, d).select("image_id", "pos", F.round(F.col("grey") / F.sum("grey").over(W.partitionBy("image_id")), 6).alias("share"))


@query("dml08_retention", "SELECT count(*) FILTER (created_at < TIMESTAMP '2024-01-15') AS to_delete, count(*) FILTER (created_at >= TIMESTAMP '2024-01-15') AS kept FROM usage")
def _(spark, d):
    old = F.col("created_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    return V.usage(spark, d).agg(F.count_if(old).alias("to_delete"), F.count_if(~old).alias("kept"))


@query("dml03_kill_switch", "SELECT provider, cost_usd > 0 AS paid, false AS is_enabled, count(*) AS n FROM usage WHERE cost_usd > 0 GROUP BY ALL UNION ALL SELECT provider, false, true, count(*) FROM usage WHERE NOT cost_usd > 0 GROUP BY ALL")
def _(spark, d):
    u = V.usage(spark, d).withColumn("paid", F.col("cost_usd") > 0)
    return u.withColumn("is_enabled", ~F.col("paid")).groupBy("provider", "paid", "is_enabled").agg(F.count("*").alias("n"))
