"""Queries of the registry, tag and composite families over documents, parts, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as R
from ..operators import similarity as S
from ..operators import tags as T
from . import views as V
from .catalog import query


def registry(spark, d):
    """Parts as tags: a nested registry with gaps in every field."""
    k = F.col("p_partkey")
    p = V.table(spark, d, "part")
    return p.select(
        F.concat(F.lit("env.part.t"), k.cast("string")).alias("tag_id"), F.when(k % 11 == 0, "").otherwise(F.col("p_name")).alias("canonical_name"), F.when(k % 7 == 0, F.concat(F.lit("The "), "p_type")).when(k % 13 != 0, F.concat("p_type", F.lit(" of "), "p_name", F.lit("."))).alias("definition"),
        F.when(k % 5 != 0, F.col("p_brand")).alias("domain"), F.lit("part").alias("category"), F.when(k % 3 == 0, "ordinal").otherwise("continuous").alias("value_type"), F.when(k % 17 == 0, "deprecated").otherwise("active").alias("status"),
        F.when(k % 17 == 0, F.concat(F.lit("env.part.t"), (k + 17).cast("string"))).alias("replaced_by"), F.lit("1.0").alias("version"), F.array(F.col("p_brand"), F.lower("p_type")).alias("aliases"),
        F.array(F.concat(F.lit("env.part.t"), (k * 2).cast("string"))).alias("parents"), F.when(k % 4 == 0, "yes").when(k % 4 == 1, "partial").when(k % 4 == 2, "no").alias("from_2d"),
    )


_REG = """reg AS (SELECT 'env.part.t' || p_partkey AS tag_id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS canonical_name, CASE WHEN p_partkey % 7 = 0 THEN 'The ' || p_type WHEN p_partkey % 13 <> 0 THEN p_type || ' of ' || p_name || '.' END AS definition,
CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS domain, CASE WHEN p_partkey % 3 = 0 THEN 'ordinal' ELSE 'continuous' END AS value_type, CASE WHEN p_partkey % 17 = 0 THEN 'deprecated' ELSE 'active' END AS status, CASE WHEN p_partkey % 17 = 0 THEN 'env.part.t' || (p_partkey + 17) END AS replaced_by,
[p_brand, lower(p_type)] AS aliases, ['env.part.t' || (p_partkey * 2)] AS parents, CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'partial' WHEN 2 THEN 'no' END AS from_2d, p_partkey AS k FROM part)"""


def _newer(old):
    """A second version: some tags gone, some changed."""
    k = F.regexp_extract("tag_id", r"(\d+)$", 1).cast("long")
    kept = old.where(k % 19 != 0)
    return kept.withColumns({"value_type": F.when(k % 23 == 0, "binary").otherwise(F.col("value_type")), "definition": F.when(k % 29 == 0, F.concat("definition", F.lit(" More."))).otherwise(F.col("definition")), "from_2d": F.when(k % 31 == 0, F.lit(None)).otherwise(F.col("from_2d")), "aliases": F.when(k % 37 == 0, F.concat("aliases", F.array(F.lit("more")))).otherwise(F.col("aliases"))})


@query("reg05_diff", f"""+{_REG}, n AS (SELECT tag_id, k, CASE WHEN k % 23 = 0 THEN 'binary' ELSE value_type END AS value_type, CASE WHEN k % 29 = 0 THEN definition || ' More.' ELSE definition END AS definition, CASE WHEN k % 31 = 0 THEN NULL ELSE from_2d END AS from_2d FROM reg WHERE k % 19 <> 0)
SELECT tag_id, 'BREAKING' AS severity, 'TAG_REMOVED' AS change FROM reg WHERE k % 19 = 0
UNION ALL SELECT tag_id, 'BREAKING', 'VALUE_TYPE_CHANGED' FROM n WHERE k % 23 = 0
UNION ALL SELECT tag_id, 'WARNING', 'EXTRACTABILITY_DOWNGRADE' FROM reg WHERE k % 19 <> 0 AND k % 31 = 0 AND from_2d IS NOT NULL
UNION ALL SELECT tag_id, 'INFO', 'DEFINITION_CHANGED' FROM n WHERE k % 29 = 0 AND definition IS NOT NULL
UNION ALL SELECT tag_id, 'INFO', 'ALIASES_ADDED' FROM n WHERE k % 37 = 0""")
def _(spark, d):
    old = registry(spark, d)
    return R.diff(old, _newer(old))


@query("agg21_severity_summary", f"+{_REG} SELECT severity, count(*) AS n FROM (SELECT 'BREAKING' AS severity FROM reg WHERE k % 19 = 0 UNION ALL SELECT 'BREAKING' FROM reg WHERE k % 19 <> 0 AND k % 23 = 0 UNION ALL SELECT 'WARNING' FROM reg WHERE k % 19 <> 0 AND k % 31 = 0 AND from_2d IS NOT NULL UNION ALL SELECT 'INFO' FROM reg WHERE k % 19 <> 0 AND k % 29 = 0 AND definition IS NOT NULL UNION ALL SELECT 'INFO' FROM reg WHERE k % 19 <> 0 AND k % 37 = 0) GROUP BY 1")
def _(spark, d):
    old = registry(spark, d)
    return R.diff(old, _newer(old)).groupBy("severity").agg(F.count("*").alias("n"))


@query("reg09_lint", rf"""+{_REG} SELECT tag_id, level, code FROM (SELECT tag_id, unnest([
CASE WHEN canonical_name = '' THEN struct_pack(level := 'error', code := 'NAM001') END, CASE WHEN regexp_matches(canonical_name, '^\p{{Ll}}') THEN struct_pack(level := 'warning', code := 'NAM002') END, CASE WHEN length(canonical_name) BETWEEN 1 AND 2 THEN struct_pack(level := 'info', code := 'NAM003') END,
CASE WHEN definition IS NULL THEN struct_pack(level := 'warning', code := 'DEF001') END, CASE WHEN length(definition) < 20 THEN struct_pack(level := 'warning', code := 'DEF002') END, CASE WHEN NOT regexp_matches(rtrim(definition), '[.?!]$') THEN struct_pack(level := 'info', code := 'DEF003') END,
CASE WHEN regexp_matches(definition, '^(The|A|An)\s') THEN struct_pack(level := 'info', code := 'DEF004') END, CASE WHEN domain IS NULL THEN struct_pack(level := 'warning', code := 'DOM001') END, CASE WHEN canonical_name = '' THEN struct_pack(level := 'error', code := 'REQ001:canonical_name') END,
CASE WHEN lower(canonical_name) IN (lower(aliases[1]), aliases[2]) THEN struct_pack(level := 'info', code := 'ALI002') END, CASE WHEN lower(aliases[1]) = aliases[2] THEN struct_pack(level := 'warning', code := 'ALI001') END], recursive := true) FROM reg) WHERE code IS NOT NULL""")
def _(spark, d):
    return R.lint(registry(spark, d))


@query("reg10_quality", rf"""+{_REG}, q AS (SELECT tag_id, domain, CASE WHEN definition IS NULL THEN 0 ELSE CASE WHEN length(definition) >= 50 THEN 10 WHEN length(definition) >= 20 THEN 5 ELSE 0 END + 10 + CASE WHEN regexp_matches(trim(definition), '[.?!]$') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(definition, '^(The|A|An)\s') THEN 0 ELSE 5 END END AS d,
CASE WHEN canonical_name = '' THEN 15 ELSE 20 END + CASE WHEN domain IS NULL THEN 0 ELSE 10 END + CASE WHEN from_2d IS NULL THEN 0 ELSE 5 END + 4 AS o FROM reg)
SELECT tag_id, domain, CAST(d AS INTEGER) AS definition_score, CAST(d + o AS INTEGER) AS score, CAST(d + o AS DOUBLE) AS percentage, CASE WHEN d + o >= 80 THEN 'excellent' WHEN d + o >= 60 THEN 'good' WHEN d + o >= 40 THEN 'fair' ELSE 'poor' END AS band FROM q""")
def _(spark, d):
    return R.quality(registry(spark, d))


@query("agg17_shared_aliases", f"+{_REG} SELECT alias, count(*) AS n, list_sort(list(tag_id)) AS tag_ids FROM (SELECT DISTINCT tag_id, lower(unnest(aliases)) AS alias FROM reg) GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return R.shared_aliases(registry(spark, d))


@query("jon12_dangling_parents", f"+{_REG}, r AS (SELECT tag_id, unnest(parents) AS ref FROM reg) SELECT tag_id, ref FROM r WHERE ref NOT IN (SELECT tag_id FROM reg)")
def _(spark, d):
    return R.dangling(registry(spark, d))


@query("reg08_validity", f"+{_REG}, w AS (SELECT 'env.part.t' || o_orderkey AS tag_id FROM orders) SELECT DISTINCT w.tag_id, status IS NOT NULL AS \"exists\", coalesce(status = 'active', false) AS active, coalesce(status = 'deprecated', false) AS deprecated, replaced_by FROM w LEFT JOIN reg USING (tag_id)")
def _(spark, d):
    w = V.table(spark, d, "orders").select(F.concat(F.lit("env.part.t"), F.col("o_orderkey").cast("string")).alias("tag_id"))
    return R.validity(w, registry(spark, d))


@query("agg15_field_coverage", f"+{_REG}, c AS (SELECT count(*) AS t, count(*) FILTER (canonical_name <> '') AS a, count(definition) AS b, count(domain) AS c FROM reg) SELECT field, filled, total, round_even(100 * filled / total, 1) AS percent FROM (SELECT 'canonical_name' AS field, a AS filled, t AS total FROM c UNION ALL SELECT 'definition', b, t FROM c UNION ALL SELECT 'domain', c, t FROM c)")
def _(spark, d):
    return R.coverage(registry(spark, d), ["canonical_name", "definition", "domain"])


@query("agg13_frequency", f"+{_REG} SELECT coalesce(domain, 'unknown') AS domain, count(*) AS n FROM reg GROUP BY 1")
def _(spark, d):
    return R.frequency(registry(spark, d), "domain")


@query("agg14_domains", "SELECT DISTINCT domain FROM tags ORDER BY 1")
def _(spark, d):
    return V.tags(spark, d).select("domain").distinct().orderBy("domain")


@query("reg02_autocomplete", f"+{_REG} SELECT tag_id, canonical_name, CAST(CASE WHEN starts_with(lower(tag_id), 'a') THEN 0 WHEN starts_with(lower(canonical_name), 'a') THEN 1 ELSE 2 END AS INTEGER) AS rank FROM reg WHERE starts_with(lower(tag_id), 'a') OR starts_with(lower(canonical_name), 'a') OR contains(' ' || lower(canonical_name), ' a') ORDER BY rank, tag_id LIMIT 10")
def _(spark, d):
    return R.autocomplete(registry(spark, d), "a")


@query("reg03_resolve", f"+{_REG} SELECT tag_id FROM reg WHERE contains(lower(tag_id || ' | ' || array_to_string(aliases, ' | ')), 't12') ORDER BY 1 LIMIT 10")
def _(spark, d):
    return R.resolve(registry(spark, d), "T12").select("tag_id")


@query("reg01_fuzzy_search")
def _(spark, d):
    return R.fuzzy_search(registry(spark, d), "antique part")


@query("jon09_similar_names")
def _(spark, d):
    return S.similar_texts(registry(spark, d), "tag_id", "canonical_name", ["domain", "value_type"], 0.85)[0]


@query("reg11_similar_definitions")
def _(spark, d):
    return S.similar_texts(registry(spark, d), "tag_id", "definition", cutoff=0.7, longer_than=20)[0]


@query("reg11_definition_members", f"+{_REG}, t AS (SELECT tag_id, lower(definition) AS text FROM reg WHERE length(definition) > 20) SELECT min(tag_id) OVER (PARTITION BY text) AS text_id, tag_id FROM t")
def _(spark, d):
    return S.similar_texts(registry(spark, d), "tag_id", "definition", cutoff=0.7, longer_than=20)[1]


@query("mth13_consolidation")
def _(spark, d):
    return S.consolidation(registry(spark, d), block=["domain", "value_type"])[0]


@query("reg07_replacement_cycles", "SELECT 'env.part.t' || p_partkey AS tag_id FROM part WHERE p_partkey IN (17, 34)")
def _(spark, d):
    from .. import runtime

    runtime.checkpoint_dir(spark)
    return R.replacement_cycles(registry(spark, d).withColumn("replaced_by", F.when(F.col("tag_id") == "env.part.t34", "env.part.t17").otherwise(F.col("replaced_by"))))


@query("dml05_review", """SELECT o_orderkey AS proposal_id, CASE WHEN o_orderstatus <> 'P' THEN CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'rejected' END
ELSE CASE (SELECT min(struct_pack(at := l_shipdate, n := l_linenumber, a := l_returnflag)).a FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('A', 'R')) WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'pending' END END AS status,
CASE WHEN o_orderstatus = 'P' THEN greatest((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('A', 'R')) - 1, 0) ELSE 0 END AS refused FROM orders""")
def _(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected")
    p = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("proposal_id"), status.alias("status"))
    action = F.when(F.col("l_returnflag") == "A", "approve").when(F.col("l_returnflag") == "R", "reject").otherwise("request_changes")
    r = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("proposal_id"), action.alias("action"), F.col("l_shipdate").alias("reviewed_at"), F.struct("l_linenumber", "l_returnflag").alias("review_id"))
    return R.review(p, r)


@query("dml10_merge_approved", f"""+{_REG}, p AS (SELECT 'env.part.t' || o_orderkey AS tag_id, CASE o_orderkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'modify' ELSE 'deprecate' END AS kind, CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority END AS nd FROM orders)
SELECT coalesce(r.tag_id, p.tag_id) AS tag_id, CASE WHEN (kind = 'new' AND r.tag_id IS NOT NULL) OR (kind IN ('modify', 'deprecate') AND r.tag_id IS NULL) THEN definition ELSE coalesce(nd, definition) END AS definition,
CASE WHEN kind = 'deprecate' AND r.tag_id IS NOT NULL THEN 'deprecated' WHEN r.tag_id IS NOT NULL THEN status WHEN kind = 'new' THEN 'active' END AS status, CASE WHEN kind = 'new' AND r.tag_id IS NOT NULL THEN 'already exists' WHEN kind IN ('modify', 'deprecate') AND r.tag_id IS NULL THEN 'not found' END AS error FROM reg r FULL JOIN p USING (tag_id)""")
def _(spark, d):
    k = F.col("o_orderkey")
    p = V.table(spark, d, "orders").select(F.concat(F.lit("env.part.t"), k.cast("string")).alias("tag_id"), F.when(k % 3 == 0, "new").when(k % 3 == 1, "modify").otherwise("deprecate").alias("kind"), F.when(k % 3 < 2, F.col("o_orderpriority")).alias("definition"), F.lit("approved").alias("status"))
    return R.merge_approved(registry(spark, d), p)


@query("dml12_bulk_update", f"+{_REG} SELECT tag_id, CASE WHEN k % 5 <> 0 AND contains(domain, '1') THEN 'Ones' ELSE domain END AS domain, CASE WHEN k % 5 <> 0 AND contains(domain, '1') THEN '1.1' ELSE '1.0' END AS version FROM reg")
def _(spark, d):
    return R.bulk_update(registry(spark, d), F.coalesce(F.contains("domain", F.lit("1")), F.lit(False)), {"domain": F.lit("Ones")}, "1.1").select("tag_id", "domain", "version")


def _scores(spark, d):
    return V.validations(spark, d).groupBy(F.col("image_id").alias("item"), F.col("attribute_key").alias("id")).agg((1 + 60 * F.max("value")).alias("score"))


@query("tag01_affordance", "+s AS (SELECT image_id AS item, attribute_key AS id, 1 + 60 * max(value) AS score FROM validations GROUP BY 1, 2), l AS (SELECT *, CASE WHEN score >= 5.5 THEN 'high' WHEN score >= 3.5 THEN 'medium' END AS level FROM s) SELECT item, 'affordance.' || lower(id) || '.' || level AS tag_key, id || ' (' || level || ')' AS label, 'affordance' AS namespace, round_even((score - 1) / 6, 3) AS confidence, 'affordance_lgbm' AS source_analyzer, 'affordance.' || id AS attribute_key FROM l WHERE level IS NOT NULL")
def _(spark, d):
    return T.affordance_tags(_scores(spark, d))


_ROOM = "p AS (SELECT vec_id AS item, CAST(pos AS VARCHAR) AS label, pos, abs(CAST(v AS DOUBLE)) AS p FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)), c AS (SELECT item, 'room_' || (pos // 16) AS coarse, sum(p) AS p FROM p GROUP BY 1, 2), n AS (SELECT item, coarse, p / sum(p) OVER (PARTITION BY item) AS p FROM c)"


def _rooms(spark, d):
    p = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.posexplode("embedding").alias("label", "v")).select("item", F.col("label").cast("string").alias("label"), F.abs(F.col("v").cast("double")).alias("p"))
    mapping = spark.createDataFrame([(str(i), f"room_{i // 16}") for i in range(64)], "label string, coarse string")
    return T.coarse_rooms(p, mapping)


@query("agg27_coarse_rooms", f"+{_ROOM} SELECT item, coarse, round(p, 6) AS p FROM n")
def _(spark, d):
    return _rooms(spark, d).withColumn("p", F.round("p", 6))


@query("srt08_top_classes", f"+{_ROOM}, r AS (SELECT item, coarse AS label, p, CAST(row_number() OVER (PARTITION BY item ORDER BY p DESC, coarse) AS INTEGER) AS rank FROM n) SELECT item, label, round(p, 6) AS p, rank FROM r WHERE rank = 1 OR (rank <= 4 AND p > 0.15)")
def _(spark, d):
    return T.top_classes(_rooms(spark, d).withColumnRenamed("coarse", "label")).withColumn("p", F.round("p", 6)).select("item", "label", "p", "rank")


@query("tag02_room", f"+{_ROOM}, r AS (SELECT item, coarse AS label, p, row_number() OVER (PARTITION BY item ORDER BY p DESC, coarse) AS rank FROM n) SELECT item, 'room_type.' || label AS tag_key, upper(label[1:1]) || replace(label[2:], '_', ' ') AS label, 'room_type' AS namespace, round_even(p, 3) AS confidence, 'places365' AS source_analyzer, 'room.type_coarse' AS attribute_key FROM r WHERE rank = 1 AND p >= 0.2")
def _(spark, d):
    return T.room_tags(T.top_classes(_rooms(spark, d).withColumnRenamed("coarse", "label"), 1).drop("rank"))


@query("agg26_merge_materials", """+m AS (SELECT o_custkey AS item, lower(o_orderstatus) AS material, least(sum(o_totalprice / 2e6), 1) AS a, max(o_totalprice / 5e5) AS confidence, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT *, sum(a) OVER (PARTITION BY item) AS t FROM m)
SELECT item, material, round(CASE WHEN t > 1 THEN a / t ELSE a END, 6) AS coverage_2d, round(confidence, 4) AS confidence FROM s""")
def _(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.concat("o_orderstatus", F.lit(" ")).alias("material"), (F.col("o_totalprice") / 2e6).alias("coverage_2d"), (F.col("o_totalprice") / 2e6).alias("coverage_3d"), (F.col("o_totalprice") / 5e5).alias("confidence"), F.lit(1.0).alias("depth"))
    return T.merge_materials(o).select("item", "material", F.round("coverage_2d", 6).alias("coverage_2d"), F.round("confidence", 4).alias("confidence"))


@query("agg29_presence_counts", "SELECT o_custkey AS item, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def _(spark, d):
    return T.presence_counts(V.table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("label")), ["F", "O", "P"])


@query("agg36_composite", "SELECT image_id AS item, round(sum(value * duration_ms) / sum(duration_ms), 6) AS score FROM validations GROUP BY 1")
def _(spark, d):
    return T.weighted_composite(V.validations(spark, d).withColumnRenamed("image_id", "item"), ["item"], "value", "duration_ms").withColumn("score", F.round("score", 6))


@query("cmp01_fluency", "SELECT event_id, round((greatest(0, least(1, 1 - x / 0.25)) + greatest(0, 1 - 2 * abs(x - 0.5)) + CASE WHEN event_id % 2 = 0 THEN greatest(0, least(1, 1 - x)) ELSE 0 END) / CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END, 6) AS fluency FROM (SELECT event_id, value / 500 AS x FROM events)")
def _(spark, d):
    x = F.col("value") / 500
    return V.table(spark, d, "events").select("event_id", F.round(T.fluency(x, x * 8, F.when(F.col("event_id") % 2 == 0, x * 10)), 6).alias("fluency"))


@query("cmp02_biophilia", "+w AS (SELECT image_id, max(value) FILTER (attribute_key = 'A') AS p, max(value) FILTER (attribute_key = 'N') AS e, max(value) FILTER (attribute_key = 'R') AS b FROM validations GROUP BY 1), m AS (SELECT *, coalesce((e + b) / 2, e, b) AS m FROM w) SELECT image_id, round(coalesce(0.3 * p + 0.7 * m, m, p), 6) AS biophilia FROM m")
def _(spark, d):
    w = V.validations(spark, d).groupBy("image_id").pivot("attribute_key", ["A", "N", "R"]).agg(F.max("value"))
    none = F.lit(None).cast("double")
    return w.select("image_id", F.round(T.biophilia(F.col("A"), F.col("N"), F.col("R"), none, none), 6).alias("biophilia"))


@query("jon14_region_contrasts", "+f AS (SELECT image_id AS item, attribute_key AS region, source AS feature, avg(value) AS value FROM validations GROUP BY 1, 2, 3) SELECT x.item, x.region AS a, y.region AS b, x.feature, round(x.value - y.value, 6) + 0.0 AS contrast FROM f x JOIN f y USING (item, feature) WHERE (x.region, y.region) IN (('A', 'N'), ('A', 'R'))")
def _(spark, d):
    f = V.validations(spark, d).groupBy(F.col("image_id").alias("item"), F.col("attribute_key").alias("region"), F.col("source").alias("feature")).agg(F.avg("value").alias("value"))
    return T.region_contrasts(f, spark.createDataFrame([("A", "N"), ("A", "R")], "a string, b string")).withColumn("contrast", F.round("contrast", 6) + 0.0)
