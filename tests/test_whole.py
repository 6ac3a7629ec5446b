"""Queries over whole tables. Where the catalogue's SQL takes a part of the rows, the SQL over all of them is here."""

import pytest
from test_catalog import SF, db, rows  # noqa: F401

from glyphmill.plans import load
from glyphmill.plans.catalog import QUERIES, VIEWS_SQL
from glyphmill.plans.registry import _REG

load()

WHOLE = {
    "geo01_free_share": "SELECT image_id AS plan_id, round(avg(CASE WHEN grey > 145 THEN 0.0 ELSE 1.0 END), 6) AS free FROM pixels GROUP BY 1",
    "geo16_mirrors": "+s AS (SELECT image_id AS plan_id, x AS x1, y AS y1 FROM pixels WHERE pos % 16 = 0), v AS (SELECT image_id AS plan_id, x AS px, y AS py FROM pixels WHERE pos % 8 = 3), j AS (SELECT *, ((px - x1) * 2 + (py - y1)) / 5 AS t FROM v JOIN s USING (plan_id)) SELECT plan_id, px, py, round(2 * (x1 + 2 * t) - px, 6) + 0.0 AS ix, round(2 * (y1 + t) - py, 6) + 0.0 AS iy, round(2 * sqrt(pow(x1 + 2 * t - px, 2) + pow(y1 + t - py, 2)), 6) AS image_distance, t BETWEEN 0 AND 1 AS self_visible FROM j",
    "reg08_validity": f"+{_REG}, w AS (SELECT 'env.part.t' || o_orderkey AS tag_id FROM orders) SELECT w.tag_id, status IS NOT NULL AS \"exists\", coalesce(status = 'active', false) AS active, coalesce(status = 'deprecated', false) AS deprecated, replaced_by FROM w LEFT JOIN reg USING (tag_id)",
    "dml10_merge_approved": f"""+{_REG}, p AS (SELECT 'env.part.t' || o_orderkey AS tag_id, CASE o_orderkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'modify' ELSE 'deprecate' END AS kind, CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority END AS nd FROM orders)
SELECT coalesce(r.tag_id, p.tag_id) AS tag_id, CASE WHEN (kind = 'new') = (r.tag_id IS NOT NULL) THEN definition ELSE coalesce(nd, definition) END AS definition,
CASE WHEN kind = 'deprecate' AND r.tag_id IS NOT NULL THEN 'deprecated' WHEN r.tag_id IS NOT NULL THEN status WHEN kind = 'new' THEN 'active' END AS status, CASE WHEN kind = 'new' AND r.tag_id IS NOT NULL THEN 'already exists' WHEN kind <> 'new' AND r.tag_id IS NULL THEN 'not found' END AS error FROM reg r FULL JOIN p USING (tag_id)""",
    "add13_sanitised": "SELECT page_id, replace(replace(replace(replace(replace(substring(html, 1, 10000), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM pages",
}


def whole(db, sql):  # noqa: F811
    return db.sql(f"WITH {VIEWS_SQL.strip()}{',' if sql.startswith('+') else ''}\n{sql.lstrip('+')}").df()


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_same_as_sql_over_all_rows(spark, db, name):  # noqa: F811
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(whole(db, WHOLE[name]))


@pytest.mark.parametrize("name", ["geo04_isovists", "geo05_visibility_graph"])
def test_every_free_cell_has_a_row(spark, db, name):  # noqa: F811
    free = whole(db, "SELECT image_id AS plan_id, x, y FROM pixels WHERE grey <= 145")
    assert rows(QUERIES[name](spark, SF).select("plan_id", "x", "y").toPandas()) == rows(free)


def test_distances_start_in_every_plan(spark, db):  # noqa: F811
    plans = whole(db, "SELECT DISTINCT image_id AS plan_id FROM pixels WHERE grey <= 145")
    assert rows(QUERIES["geo13_geodesic"](spark, SF).where("distance = 0").select("plan_id").toPandas()) == rows(plans)
