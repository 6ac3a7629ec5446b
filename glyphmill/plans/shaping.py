"""Queries of lookups, predicates, shaped documents and small writes over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import shaping as H
from ..operators import tags as T
from . import views as V
from .catalog import query
from .registry import _REG, registry


@query("src03_point_lookup", "SELECT id, filename FROM images WHERE id = 42")
def _(spark, d):
    return V.images(spark, d).where("id = 42").select("id", "filename")


@query("flt06_null_predicates", "SELECT event_id FROM events WHERE props IS NOT NULL AND value IS NOT NULL AND (event_type = 'click') IS TRUE")
def _(spark, d):
    return V.table(spark, d, "events").where(F.col("props").isNotNull() & F.col("value").isNotNull() & F.coalesce(F.col("event_type") == "click", F.lit(False))).select("event_id")


@query("flt08_pipeline_or_manual", "SELECT source, count(*) AS n FROM validations WHERE starts_with(source, 'science_pipeline') OR source = 'manual' GROUP BY 1")
def _(spark, d):
    v = V.validations(spark, d)
    return v.where(F.col("source").startswith("science_pipeline") | (F.col("source") == "manual")).groupBy("source").agg(F.count("*").alias("n"))


@query("flt14_feature_list", f"+{_REG} SELECT tag_id FROM reg WHERE status = 'active' AND domain = 'Brand#2' AND value_type = 'ordinal'")
def _(spark, d):
    r = registry(spark, d)
    for c, v in (("domain", "Brand#2"), ("value_type", "ordinal"), ("status", "active")):
        r = r.where(F.col(c) == v)
    return r.select("tag_id")


@query("flt15_score_lists", "+m AS (SELECT image_id, max(1 + 60 * value) FILTER (attribute_key = 'A') AS a, max(1 + 60 * value) FILTER (attribute_key = 'N') AS n, max(1 + 63 * value) AS t FROM validations GROUP BY 1) SELECT image_id, 'N' AS id, 0 AS place, round(n, 4) AS score FROM m WHERE n IS NOT NULL AND round(t, 4) <= 7 UNION ALL SELECT image_id, 'A', CASE WHEN n IS NULL THEN 0 ELSE 1 END, round(a, 4) FROM m WHERE a IS NOT NULL AND round(t, 4) <= 7")
def _(spark, d):
    v = V.validations(spark, d)
    m = v.groupBy("image_id", F.col("attribute_key").alias("k")).agg(F.round(F.max(1 + 60 * F.col("value")), 4).alias("s"), F.round(F.max(1 + 63 * F.col("value")), 4).alias("t"))
    g = m.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("s"), F.max("t").alias("t"))
    # the largest stands in the map as an id that isn't asked for, so that it can spoil the payload
    full = F.map_concat("s", F.create_map(F.lit("*"), F.col("t")))
    return g.select("image_id", F.posexplode(H.scores_of(full, ["N", "A", "Z"])).alias("place", "s")).select("image_id", "s.id", "place", "s.score")


@query("flt18_upload_guard", "+u AS (SELECT p_brand AS batch, p_partkey AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.gif' ELSE '' END AS name, p_size * 250000 AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part) SELECT id, CASE WHEN place > 200 THEN 'too many files' WHEN id % 4 > 1 THEN 'extension' WHEN size > 10485760 THEN 'too large' END AS fault FROM u")
def _(spark, d):
    k = F.col("p_partkey") % 4
    u = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(k == 0, ".JPG").when(k == 1, ".png").when(k == 2, ".gif").otherwise("")).alias("name"), (F.col("p_size") * 250000).alias("size"), F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")).alias("place"))
    return u.select("id", H.upload_fault(F.col("name"), F.col("size"), F.col("place")).alias("fault"))


@query("prj04_source_label", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Semantic Tagger · VLM' WHEN 1 THEN 'Room Classifier · VLM' WHEN 2 THEN 'Material Analyzer' ELSE 'Science Pipeline' END AS label FROM orders")
def _(spark, d):
    k = F.col("o_orderkey") % 4
    key = F.when(k == 0, "style.modern").when(k == 1, "spatial.room_function.office").when(k == 2, "material.oak").otherwise("other.x")
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), H.source_label(key).alias("label"))


@query("stu08_families", "SELECT CASE WHEN len(string_split(k, '.')) > 2 THEN split_part(k, '.', 2) ELSE string_split(k, '.')[-1] END AS family, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'cnfa.' || p_type || '.' || p_name ELSE 'cnfa.' || p_name END AS k FROM part) GROUP BY 1")
def _(spark, d):
    key = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(".", F.lit("cnfa"), "p_type", "p_name")).otherwise(F.concat(F.lit("cnfa."), "p_name"))
    return V.table(spark, d, "part").groupBy(H.family(key).alias("family")).agg(F.count("*").alias("n"))


@query("str14_split_key", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || '::' || o_orderstatus ELSE 'plain' END AS head, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS tail FROM orders")
def _(spark, d):
    key = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("::", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string"))).otherwise("plain")
    head, tail = H.split_last(key, "::")
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), head.alias("head"), tail.alias("tail"))


@query("stu06_captions", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' ELSE '' END || p_type || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_brand END AS caption FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    return V.table(spark, d, "part").select(k.alias("id"), H.caption(F.when(k % 2 == 0, F.concat(F.lit(" "), "p_name")), F.col("p_type"), F.when(k % 3 == 0, "  ").otherwise(F.col("p_brand"))).alias("caption"))


@query("dat03_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_trunc('second', ts) AS back FROM events")
def _(spark, d):
    e = V.table(spark, d, "events").select("event_id", H.iso(F.col("ts")).alias("iso"))
    return e.select("event_id", "iso", H.from_iso(F.col("iso")).alias("back"))


@query("arr06_deep_merge", """SELECT o_orderkey AS id, '{"a":{"x":1,"y":"' || o_orderstatus || '"},"b":' || CASE WHEN o_orderkey % 2 = 0 THEN '[2]' ELSE '[1]' END || ',"c":"' || o_orderpriority || '"}' AS doc FROM orders""")
def _(spark, d):
    base, more = F.lit('{"a":{"x":1,"y":2},"b":[1]}'), F.concat(F.lit('{"a":{"y":"'), "o_orderstatus", F.lit('"},"c":"'), "o_orderpriority", F.lit('"'), F.when(F.col("o_orderkey") % 2 == 0, ',"b":[2]').otherwise(""), F.lit("}"))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), H.deep_merge(base, more).alias("doc"))


@query("arr07_json_or_text", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN '["' || o_orderstatus || '"]' ELSE '"' || o_orderpriority || '"' END AS value FROM orders""")
def _(spark, d):
    k = F.col("o_orderkey") % 3
    v = F.when(k == 0, F.col("o_custkey").cast("string")).when(k == 1, F.concat(F.lit('["'), "o_orderstatus", F.lit('"]'))).otherwise(F.col("o_orderpriority"))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), H.json_or_text(v).alias("value"))


@query("arr08_allowed_few", "SELECT o_custkey AS id, list_filter(list(o_orderpriority ORDER BY o_orderkey), lambda x: x IN ('2-HIGH', '5-LOW'))[1:3] AS types FROM orders GROUP BY 1")
def _(spark, d):
    o = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))["o_orderpriority"].alias("t"))
    return o.select("id", H.allowed_few(F.col("t"), ["2-HIGH", "5-LOW"]).alias("types"))


@query("add22_building_tags", "SELECT DISTINCT 'building_type.' || replace(replace(replace(lower(t), ' / ', '_'), ' & ', '_'), ' ', '_') AS tag_key, t AS label FROM (SELECT p_type || CASE WHEN p_size % 2 = 0 THEN ' / ' ELSE ' & ' END || p_name AS t FROM part)")
def _(spark, d):
    t = V.table(spark, d, "part").select(F.concat("p_type", F.when(F.col("p_size") % 2 == 0, " / ").otherwise(" & "), "p_name").alias("label")).distinct()
    return t.select(F.concat(F.lit("building_type."), H.slug_chain(F.col("label"))).alias("tag_key"), "label")


@query("jsn01_json_search", "SELECT event_id FROM events WHERE props ILIKE '%\"K\": 6%'")
def _(spark, d):
    return V.table(spark, d, "events").where(F.col("props").ilike('%"K": 6%')).select("event_id")


@query("set09_later_wins", "+a AS (SELECT o_custkey AS id, o_orderstatus AS k, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), b AS (SELECT c_custkey AS id, 'F' AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0), u AS (SELECT id, k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (id, k)) SELECT id, k AS key, v AS value FROM u WHERE id IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    a = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), "o_orderstatus").agg(F.max("o_totalprice").alias("v")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias("a"))
    b = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("F"), "c_acctbal")).alias("b"))
    j = b.join(a, "id", "left")
    return j.select("id", F.explode(H.later_wins(F.col("a"), F.col("b"))).alias("key", "value"))


@query("srt10_groups_by_name", "SELECT name, n, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS place FROM (SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1)")
def _(spark, d):
    g = V.table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n"))
    return g.select("name", "n", F.row_number().over(W.orderBy("name")).alias("place"))  # a row a group


@query("snk08_ragged_columns", "+w AS (SELECT o_custkey AS id, max(o_totalprice) FILTER (o_orderstatus = 'F') AS \"F\", max(o_totalprice) FILTER (o_orderstatus = 'O') AS \"O\", max(o_totalprice) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1) SELECT id, \"F\", \"O\", \"P\", NULL AS extra FROM w UNION ALL SELECT s_suppkey, NULL, NULL, NULL, s_name FROM supplier")
def _(spark, d):
    from ..sources.files import ragged_union

    wide = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))
    return ragged_union([wide, V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("extra"))])


@query("dml01_insert", "SELECT image_id, user_id, attribute_key, value FROM validations UNION ALL SELECT o_orderkey, o_custkey, 'new', o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    new = V.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("user_id"), F.lit("new").alias("attribute_key"), F.col("o_totalprice").alias("value"))
    return V.validations(spark, d).select("image_id", "user_id", "attribute_key", "value").unionByName(new)


@query("dml02_partial_update", "SELECT s_suppkey AS id, CASE WHEN s_suppkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN coalesce((SELECT c_acctbal FROM customer WHERE c_custkey = s_suppkey AND c_acctbal > 0), s_acctbal) ELSE s_acctbal END AS balance FROM supplier")
def _(spark, d):
    change = V.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("new"))
    j = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")).join(change, "id", "left")
    return j.select("id", F.coalesce("new", "balance").alias("balance"))


@query("dml06_settings_upsert", "SELECT s_suppkey AS key, coalesce((SELECT max(struct_pack(t := o_orderdate, v := o_orderkey)).v FROM orders WHERE o_custkey = s_suppkey), -1) AS value FROM supplier UNION ALL SELECT o_custkey, max(struct_pack(t := o_orderdate, v := o_orderkey)).v FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def _(spark, d):
    new = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("value"))
    return T.upsert(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(-1).cast("long").alias("value")), new, ["key"])


@query("add28_seed_absent", "SELECT s_suppkey AS key, s_name AS value FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    have = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    return have.unionByName(T.missing_tags(V.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")), have, ["key"]))


@query("add29_current_run_tags", "+r AS (SELECT image_id, max(struct_pack(q := queued_at, id := id)).id AS id FROM runs WHERE status = 'COMPLETED' AND config_fingerprint = '2-HIGH' GROUP BY 1) SELECT r.image_id, r.id, l_returnflag AS tag_key, l_linenumber AS n FROM r JOIN lineitem ON l_orderkey = r.id")
def _(spark, d):
    cur = V.runs(spark, d).where("status = 'COMPLETED' AND config_fingerprint = '2-HIGH'").groupBy("image_id").agg(F.max_by("id", F.struct("queued_at", "id")).alias("id"))
    t = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("tag_key"), F.col("l_linenumber").alias("n"))
    return cur.join(t, "id").select("image_id", "id", "tag_key", "n").orderBy("image_id", "tag_key", "n")


@query("tag07_fallback_tags", "+l AS (SELECT image_id, attribute_key AS k, round(max(value) * 8, 6) AS v FROM validations GROUP BY 1, 2), c AS (SELECT DISTINCT image_id FROM runs WHERE status = 'COMPLETED') SELECT image_id, 'style.' || lower(k) AS attribute_key, v AS confidence FROM l WHERE v >= 0.5 AND k IN ('A', 'R') AND image_id NOT IN (SELECT image_id FROM c)")
def _(spark, d):
    k = F.col("attribute_key")
    a = V.validations(spark, d).groupBy("image_id", k).agg(F.round(F.max("value") * 8, 6).alias("value")).select("image_id", F.when(k.isin("A", "R"), F.concat(F.lit("style."), F.lower(k))).otherwise(F.concat(F.lit("other."), F.lower(k))).alias("attribute_key"), "value")
    done = V.runs(spark, d).where("status = 'COMPLETED'").select("image_id").distinct()
    return T.fallback_tags(a, done).select("image_id", "attribute_key", "confidence")


@query("stu04_run_files", "SELECT 'run' || o_custkey AS run_id, bool_or(o_orderstatus = 'F') AS has_variance_audit, bool_or(o_orderstatus = 'O') AS has_turing_summary FROM orders GROUP BY 1")
def _(spark, d):
    from ..sources.files import health_runs

    name = F.when(F.col("o_orderstatus") == "F", "derived/vlm_variance_audit.csv").when(F.col("o_orderstatus") == "O", "derived/vlm_turing_summary.txt").otherwise("raw/answers.csv")
    files = V.table(spark, d, "orders").select(F.concat(F.lit("/reports/run"), F.col("o_custkey").cast("string"), F.lit("/"), name).alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return health_runs(files, "/reports").select("run_id", "has_variance_audit", "has_turing_summary")


@query("mod02_mapped_labels", "SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'hot' WHEN '2-HIGH' THEN 'warm' WHEN '5-LOW' THEN 'cold' WHEN '3-MEDIUM' THEN 'mid' END AS label FROM orders")
def _(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), H.mapped_label(F.col("o_orderpriority"), {"1-urgent": "hot", "high": "warm", "low": "cold", "now 3-medium": "mid"}).alias("label"))


@query("add11_canon_guard", f"+{_REG} SELECT tag_id FROM reg WHERE k NOT IN (SELECT l_partkey FROM lineitem) AND k NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    named = lambda t, c: V.table(spark, d, t).select(F.concat(F.lit("env.part.t"), F.col(c).cast("string")).alias("tag_id"))
    return registry(spark, d).select("tag_id").join(named("lineitem", "l_partkey"), "tag_id", "left_anti").join(named("supplier", "s_suppkey"), "tag_id", "left_anti")


@query("agg34_coverage_by_source", f"+{_REG}, c AS (SELECT r.tag_id, CASE WHEN r.k IN (SELECT l_partkey FROM lineitem) THEN 'computed' WHEN r.k IN (SELECT s_suppkey FROM supplier) THEN 'stub' ELSE 'missing' END AS source_type FROM reg r) SELECT source_type, count(*) AS n FROM c GROUP BY 1")
def _(spark, d):
    named = lambda t, c, n: V.table(spark, d, t).select(F.concat(F.lit("env.part.t"), F.col(c).cast("string")).alias("tag_id")).distinct().withColumn(n, F.lit(True))
    j = registry(spark, d).select("tag_id").join(named("lineitem", "l_partkey", "computed"), "tag_id", "left").join(named("supplier", "s_suppkey", "stub"), "tag_id", "left")
    return j.groupBy(F.when(F.col("computed"), "computed").when(F.col("stub"), "stub").otherwise("missing").alias("source_type")).agg(F.count("*").alias("n"))


@query("add15_log_rollup", "SELECT event_type AS level, count(*) AS n, CAST(max(json_extract_string(props, '$.k')) AS VARCHAR) AS top FROM events GROUP BY 1")
def _(spark, d):
    from ..sources.files import log_rows

    line = F.to_json(F.struct(F.col("event_type").alias("level"), F.col("ts").cast("string").alias("timestamp"), F.from_json("props", "k string").alias("context")))
    rows = log_rows(V.table(spark, d, "events").select(line.alias("value")), "k string")
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.max("context.k").alias("top"))


@query("add17_health_text", "SELECT 'proposals_total{status=\"' || s || '\"} ' || n AS line FROM (SELECT CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS s, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT 'tags_total ' || count(*) FROM part")
def _(spark, d):
    from ..sources.files import prometheus
    from .governance import proposals

    p = prometheus(proposals(spark, d).groupBy("status").agg(F.count("*").alias("n")), "proposals_total", ["status"], "n")
    return p.union(registry(spark, d).agg(F.concat(F.lit("tags_total "), F.count("*").cast("string"))))
