"""Queries of keys, proposals, releases, contracts and registry reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as G
from . import views as V
from .catalog import query
from .registry import _REG, registry

_NOW = "TIMESTAMP '1998-06-01'"


def _now():
    return F.lit("1998-06-01").cast("timestamp_ntz")


def keys(spark, d):
    """Customers as keys: used when they last ordered; some revoked, some with an end."""
    used = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last_used_at"))
    c = V.table(spark, d, "customer")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    k = c.select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("role"), F.when(F.col("c_acctbal") < 5000, at("1995-01-01")).otherwise(at("1998-05-20")).alias("created_at"), F.when(F.col("c_nationkey") == 3, at("1996-01-01")).alias("revoked_at"), F.when(F.col("c_nationkey") % 5 == 1, at("1998-01-01")).when(F.col("c_nationkey") % 5 == 2, at("1998-06-01")).alias("expires_at"))
    return k.join(used, "id", "left")


_KEYS = """u AS (SELECT o_custkey AS id, max(o_orderdate) AS last_used_at FROM orders GROUP BY 1), keys AS (SELECT c_custkey AS id, lower(c_mktsegment) AS role, CASE WHEN c_acctbal < 5000 THEN TIMESTAMP '1995-01-01' ELSE TIMESTAMP '1998-05-20' END AS created_at, CASE WHEN c_nationkey = 3 THEN TIMESTAMP '1996-01-01' END AS revoked_at,
CASE c_nationkey % 5 WHEN 1 THEN TIMESTAMP '1998-01-01' WHEN 2 THEN TIMESTAMP '1998-06-01' END AS expires_at, last_used_at FROM customer LEFT JOIN u ON u.id = c_custkey)"""


def proposals(spark, d):
    """Orders as proposals on the tags of customers' numbers."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected")
    return V.table(spark, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, "new_tag").when(k % 3 == 1, "modify_tag").otherwise("deprecate_tag").alias("kind"), F.concat(F.lit("env.part.t"), F.col("o_custkey").cast("string")).alias("tag_id"), status.alias("status"), F.col("o_orderpriority").alias("submitter"), F.col("o_orderdate").alias("created_at"))


_PROPOSALS = "proposals AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'new_tag' WHEN 1 THEN 'modify_tag' ELSE 'deprecate_tag' END AS kind, 'env.part.t' || o_custkey AS tag_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status, o_orderpriority AS submitter, o_orderdate AS created_at FROM orders)"


@query("flt12_active_keys", f"+{_KEYS} SELECT id, role FROM keys WHERE revoked_at IS NULL AND (expires_at IS NULL OR expires_at >= {_NOW})")
def _(spark, d):
    return G.active_keys(keys(spark, d), _now()).select("id", "role")


@query("flt11_expired_keys", f"+{_KEYS} SELECT id, role FROM keys WHERE revoked_at IS NULL AND (last_used_at IS NULL OR last_used_at < {_NOW} - INTERVAL 90 DAY) AND created_at < {_NOW} - INTERVAL 90 DAY")
def _(spark, d):
    return G.expire_keys(keys(spark, d), _now(), 90).where("expired").select("id", "role")


@query("dml07_revoke", f"+{_KEYS} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = id) AND revoked_at IS NULL THEN {_NOW} ELSE revoked_at END AS revoked_at FROM keys")
def _(spark, d):
    return G.revoke(keys(spark, d), V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), _now()).select("id", "revoked_at")


@query("dml09_pending_guard", f"+{_PROPOSALS}, b AS (SELECT p_partkey AS k, 'env.part.t' || (p_partkey // 2) AS tag_id FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY k) AS n FROM b) SELECT k, tag_id, CASE WHEN n > 1 OR tag_id IN (SELECT tag_id FROM proposals WHERE status = 'pending') THEN 'pending' ELSE 'created' END AS outcome FROM r")
def _(spark, d):
    b = V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("env.part.t"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("tag_id"))
    return G.batch_proposals(b, proposals(spark, d).where("status = 'pending'"), ["k"]).select("k", "tag_id", "outcome")


@query("reg15_batch_import", """SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 'no id' ELSE 'created' END AS outcome, CASE WHEN p_partkey % 9 <> 0 THEN '{"canonical_name":"' || p_name || '","status":"active","value_type":"ordinal","domain":"' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END || '","definition":"","category":"environmental"' || CASE WHEN p_partkey % 4 > 0 THEN ',"extractability":{"from_2d":"' || CASE p_partkey % 4 WHEN 1 THEN 'partial' WHEN 2 THEN 'no' ELSE 'yes' END || '"}' ELSE '' END || '}' END AS payload FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    rows = V.table(spark, d, "part").select(k.alias("k"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("new.t"), k.cast("string"))).alias("tag_id"), F.col("p_name").alias("canonical_name"), F.when(k % 2 == 1, F.col("p_brand")).alias("domain"), F.when(k % 4 == 1, "partial").when(k % 4 == 2, "no").when(k % 4 == 3, "yes").alias("extractability_2d"))
    return G.batch_proposals(rows, proposals(spark, d).where("status = 'pending'"), ["k"]).select("k", "outcome", "payload")


@query("dml11_release_gate", f"+{_PROPOSALS} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved' AND kind = 'new_tag') AS tags_added, count(*) FILTER (status = 'approved' AND kind = 'modify_tag') AS tags_modified, count(*) FILTER (status = 'approved' AND kind = 'deprecate_tag') AS tags_removed, count(*) FILTER (status = 'pending') = 0 AS allowed FROM proposals")
def _(spark, d):
    return G.release_summary(proposals(spark, d))


@query("dml11_release", f"+{_PROPOSALS} SELECT 'open' AS run, id, CASE status WHEN 'approved' THEN 'merged' WHEN 'pending' THEN 'rejected' ELSE status END AS status FROM proposals UNION ALL SELECT 'shut', id, status FROM proposals")
def _(spark, d):
    p = proposals(spark, d)
    decided = p.withColumn("status", F.when(F.col("status") == "pending", "rejected").otherwise(F.col("status")))
    return G.release(decided).select(F.lit("open").alias("run"), "id", "status").union(G.release(p).select(F.lit("shut"), "id", "status"))


@query("reg17_proposals", f"+{_PROPOSALS} SELECT id, kind, tag_id, created_at FROM proposals WHERE status = 'pending' AND submitter = '1-URGENT' ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 5")
def _(spark, d):
    return G.list_proposals(proposals(spark, d), "pending", "1-URGENT", 100, 5).select("id", "kind", "tag_id", "created_at")


@query("add32_proposal_lookup", f"+{_PROPOSALS} SELECT id, kind, tag_id, status FROM proposals WHERE id = 77")
def _(spark, d):
    return proposals(spark, d).where("id = 77").select("id", "kind", "tag_id", "status")


@query("dml13_audit_rows", f"""+{_KEYS} SELECT 'api_key_expired' AS action, 'maintenance' AS user_id, 'api_key' AS target_type, CAST(id AS VARCHAR) AS target_id, '{{"role":"' || role || '"}}' AS details FROM keys WHERE revoked_at IS NULL AND (last_used_at IS NULL OR last_used_at < {_NOW} - INTERVAL 90 DAY) AND created_at < {_NOW} - INTERVAL 90 DAY""")
def _(spark, d):
    gone = G.expire_keys(keys(spark, d), _now(), 90).where("expired")
    return G.audit_rows(gone, "api_key_expired", F.lit("maintenance"), "api_key", F.col("id"), _now(), ["role"]).drop("created_at")


@query("reg13_contract_annotator", f"+{_REG} SELECT tag_id, value_type, from_2d FROM reg")
def _(spark, d):
    return G.contract(registry(spark, d), "annotator").select("tag_id", "value_type", "extractability.from_2d")


@query("reg13_contract_article_eater", f"+{_REG} SELECT tag_id, status, CASE WHEN canonical_name <> '' THEN [canonical_name] ELSE [] END AS search_terms, aliases FROM reg")
def _(spark, d):
    return G.contract(registry(spark, d), "article_eater")


@query("reg13_contract_bn", f"+{_REG} SELECT tag_id, '{{\"parent_tags\":[\"' || parents[1] || '\"]}}' AS bn FROM reg")
def _(spark, d):
    return G.contract(registry(spark, d), "bn").select("tag_id", F.to_json("bn").alias("bn"))


@query("reg13_contract_preference", f"+{_REG} SELECT tag_id, value_type, definition FROM reg")
def _(spark, d):
    return G.contract(registry(spark, d), "preference_testing")


@query("add33_latest_contract", "SELECT max(name) AS name FROM (SELECT 'v' || p_size || '_' || p_type || '.json' AS name FROM part) WHERE contains(lower(name), 'promo') HAVING max(name) IS NOT NULL")
def _(spark, d):
    return G.latest_contract(V.table(spark, d, "part").select(F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("_"), "p_type", F.lit(".json")).alias("name")), "Promo")


@query("reg14_compliance", f"""+{_REG}, u AS (SELECT DISTINCT 'env.part.t' || c_custkey * 2 AS tag_id FROM customer) SELECT coalesce(u.tag_id, r.tag_id) AS tag_id, CASE WHEN r.tag_id IS NULL THEN 'not_in_contract' WHEN u.tag_id IS NULL THEN 'unused' ELSE 'deprecated' END AS violation, CASE WHEN r.tag_id IS NULL THEN 'error' WHEN u.tag_id IS NULL THEN 'info' ELSE 'warning' END AS severity,
CASE WHEN r.tag_id IS NULL THEN 'Tag ''' || u.tag_id || ''' is not in the contract' WHEN u.tag_id IS NULL THEN 'Contract tag ''' || r.tag_id || ''' is not being used' ELSE 'Tag ''' || u.tag_id || ''' is deprecated. Use ''' || replaced_by || '''' END AS message FROM u FULL JOIN reg r USING (tag_id) WHERE r.tag_id IS NULL OR u.tag_id IS NULL OR status = 'deprecated'""")
def _(spark, d):
    used = V.table(spark, d, "customer").select(F.concat(F.lit("env.part.t"), (F.col("c_custkey") * 2).cast("string")).alias("tag_id"))
    return G.compliance(used, registry(spark, d), coverage=True)


_REPORT = rf"""+{_REG}, f AS (SELECT unnest([('completeness', 'canonical_name', canonical_name <> ''), ('completeness', 'value_type', true), ('completeness', 'status', true), ('completeness', 'definition', definition IS NOT NULL), ('completeness', 'domain', domain IS NOT NULL), ('completeness', 'category', true),
('completeness', 'missing_required', canonical_name = '' OR definition IS NULL), ('quality', 'too_short', coalesce(length(definition) < 20, false)), ('quality', 'placeholder', coalesce(contains(lower(definition), 'operational tag'), false)), ('quality', 'no_punctuation', coalesce(NOT regexp_matches(trim(definition), '[.?!]$'), false)), ('distribution', 'from_2d_yes', coalesce(from_2d = 'yes', false)), ('metadata', 'total_tags', true)]) AS x FROM reg),
report AS (SELECT x[1] AS section, x[2] AS key, count(*) FILTER (x[3]) AS n FROM f GROUP BY 1, 2 UNION ALL SELECT 'domain', coalesce(domain, 'NONE'), count(*) FROM reg GROUP BY 2 UNION ALL SELECT 'value_type', value_type, count(*) FROM reg GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM reg GROUP BY 2
UNION ALL SELECT 'consistency', 'duplicate_aliases', count(*) FILTER (c > 1) FROM (SELECT count(*) AS c FROM (SELECT lower(unnest(aliases)) AS a FROM reg) GROUP BY a))"""


@query("reg12_validation_report", f"{_REPORT} SELECT section, key, n FROM report")
def _(spark, d):
    return G.validation_report(registry(spark, d))


@query("reg12_report_issues", f"{_REPORT} SELECT 'error' AS severity, 'completeness' AS category, n || ' tags missing required fields' AS message FROM report WHERE key = 'missing_required' AND n > 0 UNION ALL SELECT 'warning', 'quality', n || ' tags have placeholder definitions' FROM report WHERE key = 'placeholder' AND n > 0 UNION ALL SELECT 'warning', 'consistency', n || ' duplicate aliases found' FROM report WHERE key = 'duplicate_aliases' AND n > 0")
def _(spark, d):
    return G.report_issues(G.validation_report(registry(spark, d)))


@query("snk12_report_markdown", f"{_REPORT}, l AS (SELECT row_number() OVER (ORDER BY section, key) + 1 AS line_no, '| ' || section || ' | ' || key || ' | ' || n || ' |' AS line FROM report) SELECT line_no, line FROM l UNION ALL VALUES (0, '| section | key | n |'), (1, '|---|---|---|')")
def _(spark, d):
    return G.markdown_table(G.validation_report(registry(spark, d)), ["section", "key", "n"], ["section", "key"])


@query("add07_documentation_stats", f"+{_REG} SELECT 'status' AS field, status AS value, count(*) AS n, count(*) FILTER (from_2d = 'yes') AS extractable FROM reg GROUP BY 2 UNION ALL SELECT 'value_type', value_type, count(*), count(*) FILTER (from_2d = 'yes') FROM reg GROUP BY 2 UNION ALL SELECT 'domain', coalesce(domain, 'unknown'), count(*), count(*) FILTER (from_2d = 'yes') FROM reg GROUP BY 2")
def _(spark, d):
    return G.documentation_stats(registry(spark, d), ["status", "value_type", "domain"])


@query("reg16_generated_definitions", f"""+{_REG} SELECT tag_id, definition AS old_definition, 'Measures ' || lower(canonical_name) || ' attributes of the built environment. ' || CASE value_type WHEN 'ordinal' THEN 'Rated on an ordered scale' ELSE 'Measured as a continuous value' END || '.' AS new_definition FROM reg WHERE definition IS NULL OR length(definition) < 20 OR contains(lower(definition), 'operational tag')""")
def _(spark, d):
    return G.generated_definitions(registry(spark, d))


@query("reg18_filter_tags", f"+{_REG} SELECT tag_id, domain, status FROM reg WHERE (contains(tag_id, 'ring') OR contains(lower(canonical_name), 'ring') OR contains(lower(coalesce(definition, '')), 'ring')) AND domain IN ('Brand#2', 'Brand#17') AND status = 'active'")
def _(spark, d):
    return G.filter_tags(registry(spark, d), "Ring", ["Brand#2", "Brand#17"], ["active"]).select("tag_id", "domain", "status")
