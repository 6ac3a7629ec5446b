"""The catalogue: query name -> callable, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The logical views (see views.py) as SQL over the driver tables.
VIEWS_SQL = """
validations AS (SELECT l_partkey AS image_id, l_suppkey AS user_id, l_returnflag AS attribute_key, l_discount AS value, CAST(l_quantity * 100 AS INTEGER) AS duration_ms,
    CASE WHEN l_linestatus = 'O' THEN 'science_pipeline_v3.4' ELSE 'manual' END AS source, l_shipdate AS created_at FROM lineitem),
images AS (SELECT p_partkey AS id, p_name AS filename, 'store/' || p_name || '.jpg' AS storage_path, p_type AS kind, p_size AS size, p_brand AS upload_batch_id FROM part),
users AS (SELECT s_suppkey AS id, s_name AS username FROM supplier),
runs AS (SELECT o_orderkey AS id, o_custkey AS image_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'RUNNING' END AS status, o_orderdate AS queued_at, o_orderpriority AS config_fingerprint FROM orders),
usage AS (SELECT event_id AS id, ts AS created_at, event_type AS provider, user_id AS tool_id, value AS cost_usd, props AS meta FROM events),
tags AS (SELECT doc_id AS tag_id, text AS definition, lang AS domain, source AS category FROM documents),
angles AS (SELECT event_type, 2 * pi() * extract(hour FROM ts) / 24 AS a, value FROM events),
pixels AS (SELECT vec_id AS image_id, label, CAST(pos AS INTEGER) AS pos, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y, CAST(floor((CAST(v AS DOUBLE) + 1) * 128) AS INTEGER) AS grey
    FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings))
"""


def query(name: str, sql: str | None = None):
    """Register a query. sql may use the views above; None if SQL can't express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {VIEWS_SQL.strip()}{',' if sql.lstrip().startswith('+') else ''}\n{sql.strip().lstrip('+')}"
        return f

    return add
