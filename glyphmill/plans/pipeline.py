"""Queries around runs, provenance, detail views and further registry reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pipeline as P
from ..operators import registry as R
from . import views as V
from .catalog import query
from .registry import _REG, _newer, registry


@query("add03_missing_requirements", "SELECT image_id AS item, a.name, list_sort(list_filter(a.requires, lambda x: NOT list_contains(p, x))) AS missing FROM (SELECT image_id, coalesce(list(DISTINCT attribute_key) FILTER (value >= 0.09), []) AS p FROM validations GROUP BY 1), (VALUES ('fluency', ['A', 'N']), ('summary', ['R'])) a(name, requires) WHERE len(list_filter(a.requires, lambda x: NOT list_contains(p, x))) > 0")
def _(spark, d):
    have = V.validations(spark, d).groupBy(F.col("image_id").alias("item")).agg(F.collect_set(F.when(F.col("value") >= 0.09, F.col("attribute_key"))).alias("provided"))
    return P.missing_requirements(spark.createDataFrame([("fluency", ["A", "N"]), ("summary", ["R"])], "name string, requires array<string>"), have).withColumn("missing", F.sort_array("missing"))


@query("add04_tier_violations", "+s AS (SELECT o_custkey AS pipeline, o_orderkey AS position, o_orderpriority AS name, CASE o_orderstatus WHEN 'F' THEN 'L0' WHEN 'O' THEN 'L1' ELSE 'L2' END AS tier FROM orders), p AS (SELECT *, lag(tier) OVER (PARTITION BY pipeline ORDER BY position) AS b FROM s) SELECT pipeline, position, name, tier FROM p WHERE tier < b")
def _(spark, d):
    t = F.when(F.col("o_orderstatus") == "F", "L0").when(F.col("o_orderstatus") == "O", "L1").otherwise("L2")
    return P.tier_violations(V.table(spark, d, "orders").select(F.col("o_custkey").alias("pipeline"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("name"), t.alias("tier")))


@query("add01_provenance", "SELECT source AS level, count(*) AS n, list_sort(list(DISTINCT attribute_key)) AS keys FROM validations GROUP BY 1")
def _(spark, d):
    return P.provenance(V.validations(spark, d).select(F.col("image_id").alias("item"), F.col("attribute_key").alias("key"), F.col("source").alias("level")))


@query("cmp03_richness", "+w AS (SELECT image_id, max(value) FILTER (attribute_key = 'A') AS a, max(value) FILTER (attribute_key = 'N') AS b FROM validations GROUP BY 1), m AS (SELECT image_id, round(coalesce((a + b) / 2, a, b) * 8, 6) AS r FROM w) SELECT image_id, r AS richness, CASE WHEN r < 0.33 THEN 'low' WHEN r < 0.66 THEN 'mid' WHEN r IS NOT NULL THEN 'high' END AS richness_bin FROM m")
def _(spark, d):
    w = V.validations(spark, d).groupBy("image_id").pivot("attribute_key", ["A", "N"]).agg(F.round(F.max("value") * 8, 9))
    out = P.richness(w, ["A", "N"], "richness")
    from ..functions import scalars as S

    r = F.round("richness", 6)
    return out.select("image_id", r.alias("richness"), F.when(r.isNotNull(), S.index_bin(r)).alias("richness_bin"))


@query("dml04_request_runs", "+w AS (SELECT DISTINCT p_partkey * 2 AS image_id FROM part), e AS (SELECT c_custkey AS image_id, CASE c_custkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'RUNNING' ELSE 'STALE' END AS old FROM customer) SELECT image_id, CASE WHEN w.image_id IS NOT NULL AND (old IS NULL OR old IN ('FAILED', 'STALE')) THEN 'PENDING' ELSE old END AS status, w.image_id IS NOT NULL AND (old IS NULL OR old IN ('FAILED', 'STALE')) AS queued FROM w FULL JOIN e USING (image_id)")
def _(spark, d):
    k = F.col("c_custkey") % 4
    e = V.table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), F.when(k == 0, "FAILED").when(k == 1, "COMPLETED").when(k == 2, "RUNNING").otherwise("STALE").alias("status"))
    return P.request_runs(V.table(spark, d, "part").select((F.col("p_partkey") * 2).alias("image_id")), e, ["image_id"])


@query("agg40_progress", "+c AS (SELECT count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS done, CAST(date_diff('second', min(queued_at), TIMESTAMP '2030-01-01') AS BIGINT) AS elapsed_s FROM runs) SELECT total, done, elapsed_s, round(done / elapsed_s, 9) AS per_s, round((total - done) / (done / elapsed_s), 2) AS eta_s FROM c")
def _(spark, d):
    out = P.progress(V.runs(spark, d), F.col("status") == "COMPLETED", F.col("queued_at"), F.lit("2030-01-01").cast("timestamp_ntz"))
    return out.select("total", "done", "elapsed_s", F.round("per_s", 9).alias("per_s"), F.round("eta_s", 2).alias("eta_s"))


@query("add06_migrate", f"+{_REG} SELECT tag_id, CASE WHEN k % 4 = 0 THEN 'yes' WHEN k % 4 = 1 THEN 'partial' WHEN k % 4 = 2 THEN 'no' END AS from_2d, status, k % 4 = 1 AS extractability_changed, false AS status_changed FROM reg")
def _(spark, d):
    t = registry(spark, d).withColumn("from_2d", F.when(F.col("from_2d") == "partial", " Some").otherwise(F.col("from_2d")))
    return P.migrate(t).select("tag_id", "from_2d", "status", "extractability_changed", "status_changed")


@query("reg06_changelog", f"+{_REG} SELECT tag_id, 'value_type' AS field, value_type AS before, 'binary' AS after FROM reg WHERE k % 19 <> 0 AND k % 23 = 0 UNION ALL SELECT tag_id, 'definition', definition, definition || ' More.' FROM reg WHERE k % 19 <> 0 AND k % 29 = 0 AND definition IS NOT NULL UNION ALL SELECT tag_id, 'from_2d', from_2d, NULL FROM reg WHERE k % 19 <> 0 AND k % 31 = 0 AND from_2d IS NOT NULL")
def _(spark, d):
    old = registry(spark, d)
    return P.field_changes(old, _newer(old), "tag_id", ["value_type", "definition", "from_2d"])


@query("agg18_quality_bands", rf"""+{_REG}, q AS (SELECT CASE WHEN definition IS NULL THEN 0 ELSE CASE WHEN length(definition) >= 50 THEN 10 WHEN length(definition) >= 20 THEN 5 ELSE 0 END + 10 + CASE WHEN regexp_matches(trim(definition), '[.?!]$') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(definition, '^(The|A|An)\s') THEN 0 ELSE 5 END END + CASE WHEN canonical_name = '' THEN 15 ELSE 20 END + CASE WHEN domain IS NULL THEN 0 ELSE 10 END + CASE WHEN from_2d IS NULL THEN 0 ELSE 5 END + 4 AS s FROM reg)
SELECT CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 60 THEN 'good' WHEN s >= 40 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n, round(avg(s), 4) AS mean FROM q GROUP BY 1""")
def _(spark, d):
    return R.quality(registry(spark, d)).groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("percentage"), 4).alias("mean"))


@query("agg16_domain_samples", "SELECT domain, count(*) AS n, list_sort(list(tag_id))[1:3] AS sample FROM tags GROUP BY 1")
def _(spark, d):
    # the three smallest, without gathering a domain: ranked by a window that keeps only them
    from pyspark.sql import Window as W

    t = V.tags(spark, d)
    few = t.withColumn("r", F.row_number().over(W.partitionBy("domain").orderBy("tag_id"))).where("r <= 3").groupBy("domain").agg(F.sort_array(F.collect_list("tag_id")).alias("sample"))
    return t.groupBy("domain").agg(F.count("*").alias("n")).join(few, "domain")


@query("set08_contract_coverage", f"+{_REG}, u AS (SELECT DISTINCT 'env.part.t' || l_partkey * 3 AS tag_id FROM lineitem), a AS (SELECT tag_id FROM reg WHERE status = 'active') SELECT 'unused' AS kind, count(*) AS n FROM a WHERE tag_id NOT IN (SELECT tag_id FROM u) UNION ALL SELECT 'violation', count(*) FROM u WHERE tag_id NOT IN (SELECT tag_id FROM a)")
def _(spark, d):
    used = V.table(spark, d, "lineitem").select(F.concat(F.lit("env.part.t"), (F.col("l_partkey") * 3).cast("string")).alias("tag_id")).distinct()
    allowed = registry(spark, d).where("status = 'active'").select("tag_id")
    return allowed.join(used, "tag_id", "left_anti").agg(F.lit("unused").alias("kind"), F.count("*").alias("n")).union(used.join(allowed, "tag_id", "left_anti").agg(F.lit("violation").alias("kind"), F.count("*").alias("n")))


@query("add12_node_names", r"SELECT DISTINCT o_orderkey AS id, unnest(regexp_extract_all(o_orderpriority || ' ' || o_orderstatus, '\b([A-Z][A-Z0-9_]{2,})\b', 1)) AS node FROM orders")
def _(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("t"))
    return P.node_names(o, "id", "t")


@query("add13_request_flags", r"SELECT page_id, regexp_matches(url, '(?i)\b(union\s+select|drop\s+table|insert\s+into|delete\s+from)\b|--|;\s*$') AS sql, regexp_matches(url, '(?i)<script|javascript:|on\w+\s*=') AS script, contains(url, '..') OR regexp_matches(url, '(?i)%2e%2e') AS traversal FROM pages")
def _(spark, d):
    return P.request_flags(V.table(spark, d, "pages").select("page_id", "url"), "url").drop("url")


@query("tag08_detail", "+l AS (SELECT image_id AS item, attribute_key AS key, starts_with(source, 'science_pipeline') AS s, max(struct_pack(t := created_at, v := value)).v AS value FROM validations GROUP BY 1, 2, 3) SELECT item, CAST(coalesce(count(*) FILTER (s), 0) AS BIGINT) AS n_science, CAST(coalesce(count(*) FILTER (NOT s), 0) AS BIGINT) AS n_human, max(value) FILTER (s AND key = 'A') AS science_a FROM l GROUP BY 1")
def _(spark, d):
    v = V.validations(spark, d).withColumnsRenamed({"image_id": "item", "attribute_key": "key"})
    out = P.split_detail(v)
    return out.select("item", F.size("science").cast("long").alias("n_science"), F.size("human").cast("long").alias("n_human"), F.try_element_at(F.filter("science", lambda p: p["key"] == "A"), F.lit(1))["value"].alias("science_a"))


@query("cmp10_flat_export", "SELECT image_id, user_id, attribute_key, value, source, coalesce(duration_ms, 0) AS duration_ms FROM validations WHERE value IS NOT NULL AND (starts_with(source, 'science_pipeline') OR source = 'manual')")
def _(spark, d):
    v = V.validations(spark, d)
    return v.where(F.col("value").isNotNull() & (F.col("source").startswith("science_pipeline") | (F.col("source") == "manual"))).select("image_id", "user_id", "attribute_key", "value", "source", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"))


@query("agg39_key_groups", "SELECT kind, id, rank FROM (SELECT split_part(kind, ' ', 1) AS kind, id, CAST(row_number() OVER (PARTITION BY split_part(kind, ' ', 1) ORDER BY id) AS INTEGER) AS rank FROM images) WHERE rank <= 8")
def _(spark, d):
    from ..operators.annotation import first_per_group

    i = V.images(spark, d).select(F.substring_index("kind", " ", 1).alias("kind"), "id")
    return first_per_group(i, "kind", ["id"], 8)


@query("cmp07_codebook", "SELECT key, 'index' AS role, 'float' AS type, CAST(NULL AS VARCHAR) AS state FROM (VALUES ('science.visual_richness'), ('science.organized_complexity'), ('biophilia.index')) k(key) UNION ALL SELECT key, 'bin', 'category', state FROM (VALUES ('science.visual_richness_bin'), ('science.organized_complexity_bin')) k(key) CROSS JOIN (VALUES ('low'), ('mid'), ('high')) s(state)")
def _(spark, d):
    return P.codebook(spark)


@query("cmp07_missing_indices", "+s AS (SELECT DISTINCT image_id AS item, CASE WHEN value >= 0.09 THEN 'biophilia.index' ELSE 'science.visual_richness' END AS key FROM validations) SELECT i.item, k.key FROM (SELECT DISTINCT item FROM s) i CROSS JOIN (VALUES ('science.visual_richness'), ('science.organized_complexity'), ('biophilia.index')) k(key) LEFT JOIN s ON s.item = i.item AND s.key = k.key WHERE s.key IS NULL")
def _(spark, d):
    s = V.validations(spark, d).select(F.col("image_id").alias("item"), F.when(F.col("value") >= 0.09, "biophilia.index").otherwise("science.visual_richness").alias("key"))
    return P.missing_indices(s, P.codebook(spark))


@query("add02_levels", "SELECT event_id AS item, event_type AS key, value, 'derived' AS level, 'rollup' AS source, 0.5 AS confidence FROM events WHERE event_id % 2 = 0 AND event_id % 3 > 0")
def _(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 2 == 0, F.col("value"))
    return P.at_level(V.table(spark, d, "events").select(F.col("event_id").alias("item"), F.col("event_type").alias("key"), v.alias("value")), "derived", "rollup", 0.5)
