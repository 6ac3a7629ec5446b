"""Queries of studies, streaming and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import study as U
from ..sources import files as S
from ..streaming import ledger as L
from . import views as V
from .catalog import query


def _labels(spark, d):
    t = V.table(spark, d, "labels")
    return tuple(t.select(F.col("doc_id").alias("image_id"), F.lit("q").alias("attribute_key"), F.col(c).cast("string").alias("label")) for c in ("quality", "toxic"))


@query("stu01_panel", "SELECT doc_id AS image_id, quality <> toxic AS differs FROM labels WHERE quality <> toxic")
def _(spark, d):
    h, m = _labels(spark, d)
    return U.panel(h, m).select("image_id", (F.col("label_A") != F.col("label_B")).alias("differs"))


@query("agg11_panel_score", "+j AS (SELECT l_suppkey AS rater_id, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS w, CASE l_returnflag WHEN 'A' THEN ' a' WHEN 'R' THEN 'B' ELSE '' END AS g, l_quantity AS ra, l_discount AS rb FROM lineitem) SELECT rater_id, count(*) AS total, count(*) FILTER (upper(trim(g)) = w) AS correct, round(count(*) FILTER (upper(trim(g)) = w) / count(*), 6) AS accuracy, round(avg(CASE WHEN w = 'A' THEN ra ELSE rb END), 6) AS mean_rating_model, round(avg(CASE WHEN w = 'B' THEN ra ELSE rb END), 6) AS mean_rating_human FROM j GROUP BY 1")
def _(spark, d):
    j = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("rater_id"), F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("B").alias("which_is_model"), F.when(F.col("l_returnflag") == "A", " a").when(F.col("l_returnflag") == "R", "B").otherwise("").alias("guess"), F.col("l_quantity").cast("string").alias("rating_A"), F.col("l_discount").cast("string").alias("rating_B"))
    out = U.panel_score(j, ["rater_id"])
    return out.select("rater_id", "total", "correct", *(F.round(c, 6).alias(c) for c in ("accuracy", "mean_rating_model", "mean_rating_human")))


@query("agg12_prior_sums", "SELECT l_returnflag AS node, CASE WHEN l_linestatus = 'O' THEN l_linestatus END AS parents, round(sum(l_discount), 4) AS total FROM lineitem GROUP BY 1, 2 HAVING abs(sum(l_discount) - 1) > 1e-6")
def _(spark, d):
    p = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("node"), F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("parents"), F.col("l_discount").alias("p"))
    return U.prior_sums(p).withColumn("total", F.round("total", 4))


@query("set05_replace_nodes", "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    n, r = V.table(spark, d, "nation"), V.table(spark, d, "region")
    return U.replace_nodes(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v")), "k")


@query("src15_table_counts", "SELECT 'nation' AS \"table\", count(*) AS n FROM nation UNION ALL SELECT 'events', count(*) FROM events")
def _(spark, d):
    return S.table_counts({t: V.table(spark, d, t) for t in ("nation", "events")})


@query("src16_recent", "SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 100")
def _(spark, d):
    return S.recent(V.table(spark, d, "events").select("event_id", "ts"), "event_id", 100)


@query("snk13_prometheus", "SELECT 'events{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def _(spark, d):
    c = V.table(spark, d, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
    return S.prometheus(c, "events", ["type"], "n")


@query("stm03_job_status", "+c AS (SELECT o_custkey AS job_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS failed FROM orders GROUP BY 1) SELECT *, CASE WHEN completed + failed < total THEN 'RUNNING' WHEN failed = 0 THEN 'COMPLETED' WHEN completed = 0 THEN 'FAILED' ELSE 'COMPLETED_WITH_ERRORS' END AS status FROM c")
def _(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("RUNNING")
    return L.job_status(V.table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), s.alias("status")))


@query("stm01_daily_cost", "SELECT strftime(created_at, '%Y-%m-%d') AS day, provider, round(sum(cost_usd), 4) AS total_cost, count(*) AS n FROM usage GROUP BY 1, 2")
def _(spark, d):
    u = V.usage(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return L.daily_cost(u).select(F.col("day").cast("string").alias("day"), "provider", F.round("total_cost", 4).alias("total_cost"), "n")


@query("stm09_sessions", """+e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM g GROUP BY user_id, g""")
def _(spark, d):
    e = V.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return L.sessions(e).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("stm05_role_limits", "SELECT event_id, CASE event_type WHEN 'click' THEN 1000 WHEN 'view' THEN 100 ELSE 30 END AS \"limit\" FROM events")
def _(spark, d):
    role = F.when(F.col("event_type") == "click", "Admin").when(F.col("event_type") == "view", "viewer").otherwise("guest")
    return L.role_limits(V.table(spark, d, "events").select("event_id", role.alias("role"))).select("event_id", "limit")
