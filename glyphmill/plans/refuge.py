"""Queries of sight, refuge and sound in plans (embeddings as 8 x 8 plans), seen from each plan's first free cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import refuge as R
from ..operators import sight as S
from . import views as V
from .catalog import query
from .spatial import _GRAPH, plans


def first_cells(spark, d):
    first = S.free_cells(plans(spark, d)).groupBy("plan_id").agg(F.min(F.struct("y", "x")).alias("o"))
    return first.select("plan_id", F.col("o.x").alias("ox"), F.col("o.y").alias("oy"))


def lines(spark, d):
    return R.sight_lines(first_cells(spark, d), plans(spark, d))


def masks(spark, d):
    return R.masks(first_cells(spark, d), plans(spark, d))


_FIRST = """pl AS (SELECT image_id AS plan_id, x, y, grey, grey > 145 AS wall FROM pixels), o AS (SELECT plan_id, o.x AS ox, o.y AS oy FROM (SELECT plan_id, min(struct_pack(y := y, x := x)) AS o FROM pl WHERE NOT wall GROUP BY 1))"""
_LINES = f"""{_FIRST}, l AS (SELECT plan_id, ox, oy, x, y, greatest(abs(x - ox), abs(y - oy)) * 2 + 1 AS n FROM o JOIN pl USING (plan_id) WHERE NOT wall), s AS (SELECT plan_id, ox, oy, x, y, n, unnest(range(0, n + 1)) AS i FROM l),
c AS (SELECT plan_id, ox, oy, x, y, CAST(floor(ox + (x - ox) * (CAST(i AS DOUBLE) / n)) AS INTEGER) AS sx, CAST(floor(oy + (y - oy) * (CAST(i AS DOUBLE) / n)) AS INTEGER) AS sy FROM s), vis AS (SELECT c.plan_id, ox, oy, c.x, c.y, NOT bool_or(w.wall) AS visible FROM c JOIN pl w ON w.plan_id = c.plan_id AND w.x = sx AND w.y = sy GROUP BY ALL)"""


def _rays(n, first):
    """SQL of rays from o: each half cell from step `first`, what's there, and the step at which each ray stops (23 if at none)."""
    return f"""rs AS (SELECT plan_id, i, k, CAST(floor(ox + cos(i * (2 * pi() / {n})) * (k * CAST(0.5 AS DOUBLE))) AS INTEGER) AS x, CAST(floor(oy + sin(i * (2 * pi() / {n})) * (k * CAST(0.5 AS DOUBLE))) AS INTEGER) AS y FROM o, range(0, {n}) a(i), range({first}, 23) b(k)),
rw AS (SELECT plan_id, i, k, x, y, wall FROM rs LEFT JOIN pl USING (plan_id, x, y)), rt AS (SELECT plan_id, i, coalesce(min(k) FILTER (coalesce(wall, true)), 23) AS stop, coalesce(arg_min(wall, k) FILTER (coalesce(wall, true)), false) AS w0, min(k) FILTER (wall IS NULL) AS gone FROM rw GROUP BY ALL)"""


_MASK = f"""{_FIRST}, {_rays(1440, 0)}, seen AS (SELECT DISTINCT plan_id, x, y FROM rw JOIN rt USING (plan_id, i) WHERE k < stop), vis AS (SELECT pl.plan_id, ox, oy, pl.x, pl.y, seen.x IS NOT NULL AS visible FROM pl JOIN o USING (plan_id) LEFT JOIN seen ON seen.plan_id = pl.plan_id AND seen.x = pl.x AND seen.y = pl.y WHERE NOT wall)"""
_ISOVIST = f"""{_FIRST}, {_rays(720, 1)}, rr AS (SELECT plan_id, i, stop * 0.5 AS r, stop < 23 AND (gone IS NULL OR gone > stop) AS solid FROM rt), rn AS (SELECT a.plan_id, a.i, a.r, b.r AS r2, a.solid AND b.solid AS solid FROM rr a JOIN rr b ON a.plan_id = b.plan_id AND b.i = (a.i + 1) % 720),
rl AS (SELECT *, sqrt(greatest(0, r * r + r2 * r2 - 2 * r * r2 * cos(2 * pi() / 720))) AS len FROM rn), iso AS (SELECT plan_id, 0.5 * sin(2 * pi() / 720) * sum(r * r2) AS area, sum(len) AS perimeter, coalesce(sum(len) FILTER (NOT solid OR abs(r - r2) > 3), 0) AS occlusivity, max(r) AS max_radial, avg(r) AS mean_radial, var_pop(r) AS radial_variance FROM rl GROUP BY 1)"""


@query("geo02_lines_of_sight", f"+{_LINES} SELECT plan_id, x, y, visible FROM vis")
def _(spark, d):
    return lines(spark, d).select("plan_id", "x", "y", "visible")


@query("geo03_first_isovists", f"+{_ISOVIST} SELECT plan_id, round(area, 4) AS area, round(perimeter, 4) AS perimeter, round(occlusivity, 4) AS occlusivity, max_radial, round(mean_radial, 4) AS mean_radial, round(sqrt(radial_variance) / mean_radial, 4) AS dispersion FROM iso")
def _(spark, d):
    m = S.isovists(first_cells(spark, d), plans(spark, d))
    return m.select("plan_id", "max_radial", *(F.round(c, 4).alias(c) for c in ("area", "perimeter", "occlusivity", "mean_radial", "dispersion")))


@query("geo06_visible_cells", f"+{_MASK} SELECT plan_id, x, y, visible FROM vis")
def _(spark, d):
    return masks(spark, d).select("plan_id", "x", "y", "visible")


@query("geo07_entrances", "SELECT image_id AS plan_id, x, y FROM pixels WHERE grey <= 145 AND (x IN (0, 7) OR y IN (0, 7))")
def _(spark, d):
    return R.entrances(plans(spark, d))


@query("geo08_dead_ground", f"+{_MASK} SELECT plan_id, round(count(*) FILTER (NOT visible) / count(*), 6) AS dead_ground FROM vis WHERE sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) <= 2 GROUP BY 1")
def _(spark, d):
    return R.dead_ground(masks(spark, d), 2.0).select("plan_id", F.round("dead_ground", 6).alias("dead_ground"))


@query("geo09_exposure", f"+{_LINES} SELECT plan_id, round(coalesce(count(*) FILTER (visible AND (x IN (0, 7) OR y IN (0, 7))) / nullif(count(*) FILTER (x IN (0, 7) OR y IN (0, 7)), 0), 0), 6) AS exposure FROM vis GROUP BY 1")
def _(spark, d):
    return R.exposure(lines(spark, d), R.entrances(plans(spark, d))).select("plan_id", F.round("exposure", 6).alias("exposure"))


@query("geo10_least_exposed_paths")
def _(spark, d):
    return R.least_exposed_paths(masks(spark, d), R.entrances(plans(spark, d)))


@query("geo10_first_detection")
def _(spark, d):
    at = masks(spark, d)
    return R.first_detection(at, R.least_exposed_paths(at, R.entrances(plans(spark, d))))


@query("geo11_covisibility", f"+{_GRAPH}, {_MASK} SELECT plan_id, round(coalesce(sum(integration) FILTER (visible), 0) / CASE WHEN sum(integration) = 0 THEN 1 ELSE sum(integration) END, 6) AS covisibility FROM vis JOIN g USING (plan_id, x, y) GROUP BY 1")
def _(spark, d):
    return R.covisibility(masks(spark, d), S.visibility_graph(plans(spark, d))).select("plan_id", F.round("covisibility", 6).alias("covisibility"))


@query("geo12_prospect_refuge", f"+{_ISOVIST}, ms AS ({_MASK.join(('WITH ', ' SELECT * FROM vis'))}), dd AS (SELECT plan_id, count(*) FILTER (NOT visible) / count(*) AS dead FROM ms WHERE sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) <= 2 GROUP BY 1) SELECT plan_id, round(least(1, max_radial / sqrt(128)) * greatest(0, least(1, 1 - occlusivity / perimeter)) * (1 - dead), 5) AS prospect_refuge FROM iso JOIN dd USING (plan_id)")
def _(spark, d):
    # the radius is a quarter of the shorter side
    m = S.isovists(first_cells(spark, d), plans(spark, d)).join(R.dead_ground(masks(spark, d), 2.0), "plan_id")
    index = R.prospect_refuge(F.col("max_radial"), F.try_divide("real_surface_perimeter", "perimeter"), F.col("dead_ground"), F.sqrt(F.lit(128.0)))
    return m.select("plan_id", F.round(index, 5).alias("prospect_refuge"))


_HEARD = """h AS (SELECT event_id, event_type, event_id % 2 = 0 AS visible, 62 - 20 * log10(greatest(value, 1)) AS direct, 62 - 18 + 10 * log10((1 - 0.3) / 0.3) AS f FROM events),
e AS (SELECT event_id, event_type, visible, 10 * log10(pow(10, direct / 10) + pow(10, f / 10)) AS level, greatest(0, least(1, (direct - 10 * log10(pow(10, 3.5) + pow(10, f / 10)) + 15) / 30)) AS speech_index FROM h)"""


def _heard(spark, d, **options):
    cells = V.table(spark, d, "events").select("event_id", "event_type", F.col("value").alias("distance"), (F.col("event_id") % 2 == 0).alias("visible"))
    return R.eavesdropping(cells, absorption=0.3, **options)


@query("geo15_speech", f"+{_HEARD} SELECT event_id, round(level, 6) AS level, round(speech_index, 6) AS speech_index, speech_index > 0.45 AND NOT visible AS eavesdrop FROM e")
def _(spark, d):
    return _heard(spark, d, intelligible=0.45).select("event_id", F.round("level", 6).alias("level"), F.round("speech_index", 6).alias("speech_index"), "eavesdrop")


@query("geo15_eavesdropping_shares", f"+{_HEARD} SELECT event_type, round(count(*) FILTER (level > 35 AND NOT visible) / count(*), 6) AS eavesdrop_area, round(count(*) FILTER (level > 35 AND NOT visible) / greatest(count(*) FILTER (NOT visible), 1), 6) AS of_dead_ground, round(count(*) FILTER (level > 35) / count(*), 6) AS audible_area FROM e GROUP BY 1")
def _(spark, d):
    s = R.eavesdropping_shares(_heard(spark, d), ["event_type"])
    return s.select("event_type", *(F.round(c, 6).alias(c) for c in ("eavesdrop_area", "of_dead_ground", "audible_area")))
