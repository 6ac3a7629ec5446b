"""Queries of column functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from . import views as V
from .catalog import query


@query("str01_title_label", "SELECT p_partkey AS id, array_to_string(list_transform(string_split(replace(p_type, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS label FROM part")
def _(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.title_label(F.col("p_type")).alias("label"))


@query("str03_slug", "SELECT p_partkey AS id, substring(regexp_replace(lower(translate(p_name, ' -/', '___')), '[^a-z0-9_]', '_', 'g'), 1, 60) AS slug FROM part")
def _(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.slug(F.col("p_name")).alias("slug"))


@query("str06_strip_html", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^\n]*?>', '', 'g'), '[ \t\n\f\r\x0B]+', ' ', 'g')) AS text FROM pages")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.strip_html(F.col("html")).alias("text"))


@query("str07_without_digits", r"SELECT page_id, trim(regexp_replace(url, '[0-9]+', '', 'g')) AS url FROM pages")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.without_digits(F.col("url")).alias("url"))


@query("str12_definition_checks", r"SELECT tag_id, regexp_matches(definition, '^(The|A|An)\s') AS article, regexp_matches(rtrim(definition), '[.?!]$') AS ended, length(definition) AS n FROM tags")
def _(spark, d):
    t = V.tags(spark, d)
    return t.select("tag_id", S.starts_with_article(F.col("definition")).alias("article"), S.ends_sentence(F.col("definition")).alias("ended"), F.length("definition").cast("long").alias("n"))


@query("str13_path_template", "SELECT page_id, regexp_replace(url, '/[0-9]+', '/{id}', 'g') AS path FROM pages")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.path_template(F.col("url")).alias("path"))


@query("str19_fingerprint", "SELECT page_id, substring(sha256(url), 1, 16) AS fp, md5(url) AS key FROM pages")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.fingerprint(F.col("url")).alias("fp"), S.cache_key(F.col("url")).alias("key"))


@query("str21_glob", "SELECT page_id FROM pages WHERE regexp_full_match(url, 'https://.*\\.example\\.com/en/.*', 's')")
def _(spark, d):
    return V.table(spark, d, "pages").where(S.glob_like(F.col("url"), "https://*.example.com/en/*")).select("page_id")


@query("str18_id_list", "SELECT event_id, list_filter([TRY_CAST(trim(x) AS BIGINT) for x in string_split(event_id || ', x,' || user_id, ',')], lambda x: x IS NOT NULL) AS ids FROM events")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", S.ids_in(F.concat_ws("", F.col("event_id").cast("string"), F.lit(", x,"), F.col("user_id").cast("string"))).alias("ids"))


@query("mth02_bins", "SELECT event_id, CASE WHEN x < 0.33 THEN 'low' WHEN x < 0.66 THEN 'mid' ELSE 'high' END AS index_bin, CASE WHEN x < 0.4 THEN 'low' WHEN x < 0.7 THEN 'medium' ELSE 'high' END AS agreement_bin, CASE WHEN x < 0.33 THEN 'LOW' WHEN x < 0.66 THEN 'MID' ELSE 'HIGH' END AS node_bin, greatest(0, least(1, round(x * 2 - 0.5, 9))) AS clamped FROM (SELECT event_id, value / 500 AS x FROM events)")
def _(spark, d):
    x = F.col("value") / 500
    return V.table(spark, d, "events").select("event_id", S.index_bin(x).alias("index_bin"), S.agreement_bin(x).alias("agreement_bin"), S.node_bin(x.cast("string")).alias("node_bin"), S.clamp01(F.round(x * 2 - 0.5, 9)).alias("clamped"))


@query("mth05_squash", "SELECT event_id, round(greatest(0, 1 - 2 * abs(x - 0.5)), 6) AS u, round(1 / (1 + exp(-(x - 0.5) / 0.1)), 6) AS logistic, round(1 + 1.5 * pow(x, 1.35), 6) AS weight, round(10 * log10(pow(10, x) + pow(10, 2 * x)), 6) AS db FROM (SELECT event_id, value / 500 AS x FROM events)")
def _(spark, d):
    x = F.col("value") / 500
    return V.table(spark, d, "events").select("event_id", F.round(S.inverted_u(x), 6).alias("u"), F.round(S.squash(x, 0.5, 0.1), 6).alias("logistic"), F.round(S.surface_weight(x), 6).alias("weight"), F.round(S.db_sum(x * 10, x * 20), 6).alias("db"))


@query("mth11_restorativeness", """+w AS (SELECT image_id, max(value) FILTER (attribute_key = 'A') * 10 AS nat, max(value) FILTER (attribute_key = 'N') * 10 AS ent, max(value) FILTER (attribute_key = 'R') * 10 AS clu FROM validations GROUP BY 1),
s AS (SELECT image_id, (nat IS NOT NULL)::INT + (ent IS NOT NULL)::INT + (clu IS NOT NULL)::INT AS k, coalesce(0.4 * least(nat, 1), 0) + coalesce(0.3 * greatest(0, 1 - 2 * abs(least(ent, 1) - 0.5)), 0) + coalesce(0.15 * (1 - least(clu, 1)), 0) AS t, (nat IS NOT NULL)::INT * 0.4 + (ent IS NOT NULL)::INT * 0.3 + (clu IS NOT NULL)::INT * 0.15 AS w FROM w)
SELECT image_id, CASE WHEN k >= 2 THEN round(CAST(t AS DOUBLE) / CAST(w AS DOUBLE), 6) END AS score FROM s""")
def _(spark, d):
    w = V.validations(spark, d).groupBy("image_id").pivot("attribute_key", ["A", "N", "R"]).agg(F.max("value") * 10)
    return w.select("image_id", F.round(S.restorativeness(F.col("A"), F.col("N"), F.col("R"), F.lit(None).cast("double")), 6).alias("score"))


@query("set07_merge_tags", "SELECT o_orderkey AS id, list_concat(['Urgent', o_orderpriority], list_filter([lower(o_orderpriority), o_orderstatus], lambda x: NOT list_contains(['urgent', lower(o_orderpriority)], lower(x)))) AS tags FROM orders")
def _(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.merge_ignoring_case(F.array(F.lit("Urgent"), "o_orderpriority"), F.array(F.lower("o_orderpriority"), "o_orderstatus")).alias("tags"))


@query("jsn02_lenient_json", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS json FROM events")
def _(spark, d):
    p = F.col("props")
    wrapped = F.when(F.col("event_id") % 4 == 0, p).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("Here it is: "), p, F.lit(" I hope."))).otherwise(F.lit("no idea"))
    return V.table(spark, d, "events").select("event_id", S.lenient_json(wrapped).alias("json"))


@query("jsn04_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.missing", "bigint"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")).alias("k"))


@query("dat01_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", F.to_date("ts").cast("string").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("add13_sanitised", "SELECT page_id, replace(replace(replace(replace(replace(substring(html, 1, 10000), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM pages")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.sanitised(F.col("html")).alias("html"))
