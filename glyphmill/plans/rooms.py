"""Queries of segments, class maps, depth and model answers over orders and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rooms as R
from . import views as V
from .catalog import query
from .registry import _ROOM, _rooms

_LABELS = {"1-URGENT": "chair", "2-HIGH": "couch", "3-MEDIUM": "bed", "4-NOT SPECIFIED": "oven", "5-LOW": "sky"}


def segments(spark, d):
    """Orders as segments of customers: the priority is the label."""
    label = F.coalesce(*(F.when(F.col("o_orderpriority") == k, v) for k, v in _LABELS.items()), F.lit("other"))
    return V.table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("seg"), label.alias("label"), (F.col("o_orderstatus") != "O").alias("is_thing"), (F.col("o_totalprice") / 1e7).alias("area"), (F.col("o_orderkey") % 100 / 100).alias("y"))


_SEG = "seg AS (SELECT o_custkey AS item, o_orderkey AS seg, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items()) + " ELSE 'other' END AS label, o_orderstatus <> 'O' AS is_thing, o_totalprice / 1e7 AS area, o_orderkey % 100 / 100 AS y FROM orders)"


def _r(df, n=6):
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("agg30_room_aggregates", f"""+{_SEG} SELECT item, count(*) FILTER (is_thing) AS objects, count(*) FILTER (NOT is_thing) AS stuff, count(DISTINCT label) AS classes, round(greatest(0, 1 - coalesce(sum(area) FILTER (is_thing), 0)), 6) AS free_floor, round(coalesce(max(area) FILTER (is_thing), 0), 6) AS largest,
round(coalesce(sum(area) FILTER (is_thing AND label IN ('chair', 'couch', 'bed')), 0), 6) AS furniture, round(coalesce(avg(area) FILTER (is_thing), 0), 6) AS mean_area, round(coalesce(stddev_pop(area) FILTER (is_thing), 0), 6) AS sd_area, round(max(y) - min(y), 6) AS vertical_spread, count(*) FILTER (is_thing) * count(DISTINCT label) AS complexity FROM seg GROUP BY 1""")
def _(spark, d):
    return _r(R.room_aggregates(segments(spark, d)))


_COARSE = "CASE coarse WHEN 'room_0' THEN 'bathroom' WHEN 'room_1' THEN 'kitchen' WHEN 'room_2' THEN 'bedroom' ELSE 'living' END"


@query("agg28_consistent_rooms", f"""+{_ROOM}, {_SEG}, l AS (SELECT item, list(label) AS l FROM seg GROUP BY 1), f AS (SELECT item, {_COARSE} AS coarse, p, l FROM n LEFT JOIN l USING (item)),
g AS (SELECT item, coarse, p * CASE WHEN l IS NULL OR p <= 0.1 THEN 1 WHEN coarse = 'bathroom' THEN 0.7 WHEN coarse = 'kitchen' THEN CASE WHEN list_contains(l, 'oven') THEN 1.3 ELSE 0.8 END WHEN coarse = 'bedroom' THEN CASE WHEN list_contains(l, 'bed') THEN 1.3 ELSE 0.8 END WHEN list_contains(l, 'couch') THEN 1.2 ELSE 1 END AS p FROM f)
SELECT item, coarse, round(p / sum(p) OVER (PARTITION BY item), 6) AS p FROM g""")
def _(spark, d):
    names = F.when(F.col("coarse") == "room_0", "bathroom").when(F.col("coarse") == "room_1", "kitchen").when(F.col("coarse") == "room_2", "bedroom").otherwise("living")
    said = segments(spark, d).groupBy("item").agg(F.collect_list("label").alias("labels"))
    return _r(R.consistent_rooms(_rooms(spark, d).withColumn("coarse", names), said))


@query("str05_plain_room", "SELECT o_orderkey AS id, replace(replace(lower(o_orderpriority), ' ', '_'), '-', '_') AS room FROM orders")
def _(spark, d):
    o = V.table(spark, d, "orders")
    ending = F.when(F.col("o_orderkey") % 3 == 0, "_indoor").when(F.col("o_orderkey") % 3 == 1, "-Outdoor").otherwise("")
    return o.select(F.col("o_orderkey").alias("id"), R.plain_room(F.concat("o_orderpriority", ending)).alias("room"))


def class_map(spark, d):
    """Pixels of an embedding's 8 x 8 image with a class by grey level and a depth."""
    g = F.col("grey")
    return V.pixels(spark, d).select(F.col("image_id").alias("item"), "x", "y", F.when(g < 110, "sky").when(g < 130, "grass").when(g < 150, "wall").otherwise("floor").alias("class"), (F.least(F.greatest(g, F.lit(0)), F.lit(255)) / 255.0).alias("depth"))


_MAP = "map AS (SELECT image_id AS item, x, y, CASE WHEN grey < 110 THEN 'sky' WHEN grey < 130 THEN 'grass' WHEN grey < 150 THEN 'wall' ELSE 'floor' END AS class, least(greatest(grey, 0), 255) / 255.0 AS depth FROM pixels)"


@query("agg31_class_coverage", f"+{_MAP} SELECT item, class, count(*) AS px, round(count(*) / 64, 6) AS coverage FROM map GROUP BY 1, 2 HAVING count(*) >= 12")
def _(spark, d):
    return _r(R.class_coverage(class_map(spark, d), 12))


@query("agg31_instance_coverage", f"+{_MAP}, m AS (SELECT item, x // 4 AS instance, class, x, y FROM map WHERE class <> 'sky'), e AS (SELECT item, instance, class, count(*) AS px FROM m GROUP BY ALL HAVING count(*) >= 8) SELECT item, class, count(*) AS n, round(sum(px) / 64, 6) AS coverage FROM e GROUP BY 1, 2 UNION ALL SELECT item, NULL, (SELECT count(*) FROM e WHERE e.item = m.item), round(count(DISTINCT x * 8 + y) / 64, 6) FROM m GROUP BY item")
def _(spark, d):
    m = class_map(spark, d)
    masks = m.where("class <> 'sky'").select("item", F.floor(F.col("x") / 4).alias("instance"), "class", "x", "y")
    return _r(R.instance_coverage(masks, m.groupBy("item").agg(F.count("*").alias("total")), 8))


@query("add25_region_coverage", f"+{_MAP} SELECT item, CASE WHEN class = 'wall' THEN 'wall' ELSE 'floor' END AS region, round(count(*) / 64, 6) AS coverage FROM map WHERE class IN ('wall', 'floor', 'grass') GROUP BY 1, 2")
def _(spark, d):
    vocabulary = spark.createDataFrame([("wall", "wall"), ("floor", "floor"), ("grass", "floor"), ("sky", "outside")], "class string, region string")
    return _r(R.region_coverage(class_map(spark, d), vocabulary, ["ceiling", "floor", "wall", "window", "door"]))


@query("agg33_focal_contrast", "+w AS (SELECT l_orderkey AS item, l_linenumber = 1 AS focal, l_discount AS value FROM lineitem) SELECT item, round(max(value) FILTER (focal) - avg(value) FILTER (NOT focal), 6) + 0.0 AS contrast FROM w GROUP BY 1 HAVING max(value) FILTER (focal) - avg(value) FILTER (NOT focal) IS NOT NULL")
def _(spark, d):
    w = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_linenumber") == 1).alias("focal"), F.col("l_discount").alias("value"))
    return R.focal_contrast(w).select("item", (F.round("contrast", 6) + 0.0).alias("contrast"))


_LOGIT = "l AS (SELECT image_id AS item, x // 4 + 2 * (y // 4) AS superpixel, x, y, grey / 32.0 AS grass, (256 - grey) / 32.0 AS sky, 4.0 AS wall FROM pixels), s AS (SELECT *, exp(grass) + exp(sky) + exp(wall) AS z, greatest(grass, sky, wall) AS top FROM l)"


def _logits(spark, d):
    g = F.col("grey")
    return V.pixels(spark, d).select(F.col("image_id").alias("item"), (F.floor(F.col("x") / 4) + 2 * F.floor(F.col("y") / 4)).alias("superpixel"), "x", "y", F.create_map(F.lit("grass"), g / 32.0, F.lit("sky"), (256 - g) / 32.0, F.lit("wall"), F.lit(4.0)).alias("logits"))


@query("add24_texture_presence", f"+{_LOGIT}, c AS (SELECT item, sum(exp(grass) / z) / 64 AS a, sum(exp(sky) / z) / 64 AS b FROM s GROUP BY 1) SELECT item, unnest(['grass', 'sky', NULL]) AS class, unnest([round(a, 6), round(b, 6), round(a + b, 6)]) AS presence FROM c")
def _(spark, d):
    return _r(R.texture_presence(_logits(spark, d), ["grass", "sky", "leaf"]))


@query("add24_superpixel_presence", f"+{_LOGIT}, c AS (SELECT item, superpixel, sum(exp(grass) / z) AS m, count(*) AS n, count(*) FILTER (grass = top) AS own FROM s GROUP BY 1, 2), k AS (SELECT item, round(sum(CASE WHEN own / n >= 0.5 AND m / n >= 0.4 THEN m ELSE 0 END) / 64, 6) AS p FROM c GROUP BY 1) SELECT item, unnest(['grass', NULL]) AS class, p AS presence FROM k")
def _(spark, d):
    return _r(R.texture_presence(_logits(spark, d), ["grass"], 0.5, 0.4))


_TURNED = f"{_MAP}, o AS (SELECT item, avg(depth) FILTER (y < 1) AS t, avg(depth) FILTER (y >= 6) AS b FROM map GROUP BY 1), turned AS (SELECT item, x, y, class, CASE WHEN b > t THEN 1 - depth ELSE depth END AS depth FROM map JOIN o USING (item))"


@query("add20_oriented_depth", f"+{_TURNED} SELECT item, round(avg(depth), 6) AS depth FROM turned GROUP BY 1")
def _(spark, d):
    return R.oriented_depth(class_map(spark, d)).groupBy("item").agg(F.round(F.avg("depth"), 6).alias("depth"))


@query("pix23_depth_summary", f"+{_MAP}, s AS (SELECT item, CASE WHEN max(depth) OVER w > min(depth) OVER w THEN (depth - min(depth) OVER w) / (max(depth) OVER w - min(depth) OVER w) ELSE 0 END AS depth FROM map WINDOW w AS (PARTITION BY item)) SELECT item, round(avg(depth), 6) AS mean_depth, round(stddev_pop(depth) / 2, 6) AS contrast FROM s GROUP BY 1")
def _(spark, d):
    return _r(R.depth_summary(R.scaled_depth(class_map(spark, d))))


@query("pix28_weighted_coverage", f"+{_TURNED}, c AS (SELECT item, count(*) FILTER (class = 'wall') / 64 AS a, coalesce(sum(1 + 1.5 * pow(depth, 1.35)) FILTER (class = 'wall'), 0) / sum(1 + 1.5 * pow(depth, 1.35)) AS b, coalesce(avg(depth) FILTER (class = 'wall'), 0) AS m FROM turned GROUP BY 1) SELECT item, round(a, 6) AS coverage_2d, round(b, 6) AS coverage_3d, round(m, 6) AS depth_mean, round(CASE WHEN a > 0 THEN b / a ELSE 1 END, 6) AS depth_factor FROM c")
def _(spark, d):
    return _r(R.weighted_coverage(R.oriented_depth(class_map(spark, d)), F.col("class") == "wall"))


@query("pix29_location_bands", "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 0.62 WHEN 1 THEN 0.0 WHEN 2 THEN 0.45 WHEN 3 THEN 0.08 ELSE 0.0 END AS y0, CASE p_size % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.24 WHEN 2 THEN 0.7 WHEN 3 THEN 0.7 ELSE 1.0 END AS y1, CASE p_size % 5 WHEN 2 THEN 0.15 WHEN 3 THEN 0.1 ELSE 0.0 END AS x0, CASE p_size % 5 WHEN 2 THEN 0.85 WHEN 3 THEN 0.9 ELSE 1.0 END AS x1 FROM part")
def _(spark, d):
    k = F.col("p_size") % 5
    words = F.when(k == 0, "Carpet by the wall").when(k == 1, "ceiling light").when(k == 2, "Kitchen island").when(k == 3, "glazing").otherwise("garden")
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), R.location_band(words).alias("b")).select("id", "b.*")


@query("pix26_shallow_isovist", f"""+{_MAP}, c AS (SELECT item, quantile_cont(depth, 0.6) AS t FROM map GROUP BY 1), f AS (SELECT item, x, y FROM map JOIN c USING (item) WHERE depth < t),
b AS (SELECT f.item, f.x, f.y, count(g.x) AS n FROM f LEFT JOIN f g ON g.item = f.item AND abs(g.x - f.x) + abs(g.y - f.y) = 1 GROUP BY ALL), p AS (SELECT item, count(*) / 64 AS area, count(*) FILTER (n < 4) AS perimeter FROM b GROUP BY 1)
SELECT item, round(area, 6) AS area, perimeter, round(4 * pi() * area / (perimeter * perimeter + 1e-9), 6) AS compactness FROM p""")
def _(spark, d):
    return _r(R.shallow_isovist(class_map(spark, d)))


@query("add21_material_answer", """SELECT o_orderkey AS id, 'oak' AS material, 1.0 AS coverage, round(o_totalprice / 1e6, 6) AS confidence, '' AS finish FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT o_orderkey, 'unknown', 0.25, 0.0, 'matte' FROM orders WHERE o_orderkey % 4 > 0""")
def _(spark, d):
    o = V.table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.lit('{"materials": "none"}')).otherwise(F.concat(F.lit('{"materials": [{"coverage": 0.25, "confidence": -1, "finish": "matte"}, {"material": "oak", "coverage": 7, "confidence": '), F.format_string("%.8f", F.col("o_totalprice") / 1e6), F.lit("}]}")))
    m = o.select(F.col("o_orderkey").alias("id"), F.explode(R.material_answer(text)).alias("m"))
    return m.select("id", "m.material", "m.coverage", F.round("m.confidence", 6).alias("confidence"), "m.finish")


@query("jsn05_indicators", """+v AS (SELECT unnest(['A', 'A', 'N']) AS affordance, unnest(['soft_bed', 'desk', 'desk']) AS name), p AS (SELECT DISTINCT l_orderkey AS item, l_returnflag AS affordance, CASE WHEN l_linenumber % 2 = 0 THEN 'soft_bed' ELSE 'desk' END AS name, CASE WHEN l_linestatus = 'O' THEN 'pos' ELSE 'neg' END AS side FROM lineitem WHERE l_linenumber <> 3)
SELECT i.item, 'ind_' || v.affordance || '_' || s.side || '_' || v.name AS feature, CASE WHEN p.item IS NULL THEN 0.0 ELSE 1.0 END AS value FROM (SELECT DISTINCT l_orderkey AS item FROM lineitem) i CROSS JOIN v CROSS JOIN (VALUES ('pos'), ('neg')) s(side) LEFT JOIN p ON p.item = i.item AND p.affordance = v.affordance AND p.name = v.name AND p.side = s.side""")
def _(spark, d):
    n = F.col("l_linenumber")
    p = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("affordance"), F.when(n % 2 == 0, "Soft  bed!").otherwise("DESK").alias("name"), F.when(n == 3, "neutral").when(F.col("l_linestatus") == "O", "Positive").otherwise("negative").alias("polarity"))
    return R.indicator_features(p, spark.createDataFrame([("A", "soft_bed"), ("A", "desk"), ("N", "desk")], "affordance string, name string"))
