"""Small fixtures: scalar functions, tag rules, registry, streaming forms, readers and writers, kernels."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import scalars as S
from glyphmill.operators import annotation as A
from glyphmill.operators import circular as C
from glyphmill.operators import geometry as G
from glyphmill.operators import sight
from glyphmill.operators import pixels as P
from glyphmill.operators import registry as R
from glyphmill.operators import study as U
from glyphmill.operators import tags as T
from glyphmill.sources import files as X
from glyphmill.streaming import ledger as L


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_lenient_json(spark):
    rows = [('{"a": 1}',), ('```json\n{"a": 1}\n```',), ('```\n{"a": 1}\n```',), ('sure: {"a": 1} ok?',), ("nothing",), ("",), (None,)]
    assert [r[0] for r in values(spark, rows, "s string", S.lenient_json(F.col("s")))] == ['{"a": 1}'] * 4 + [None] * 3


def test_bins_of_nan_and_text(spark):
    assert [r[0] for r in values(spark, [("NaN",), ("x",), (None,), ("0.1",), ("0.7",)], "s string", S.node_bin(F.col("s")))] == ["HIGH", "MID", "MID", "LOW", "HIGH"]
    assert [r[0] for r in values(spark, [(float("nan"),), (-1.0,), (2.0,), (None,)], "x double", S.clamp01(F.col("x")))] == [0.0, 0.0, 1.0, None]
    assert [r[0] for r in values(spark, [("a.b_c.VR_room",)], "k string", S.title_label(F.col("k")))] == ["Vr Room"]


def test_agreement_is_pairwise(spark):
    v = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (1, "a", 2.0), (2, "a", 1.0)], "image_id int, attribute_key string, value double")
    r = A.agreement(v).collect()
    assert [(x.image_id, x.n, round(x.agreement_score, 6), x.conflict_count) for x in r] == [(1, 3, round(1 / 3, 6), 2)]


def test_mode_takes_the_smallest_of_equals(spark):
    v = spark.createDataFrame([("k", 2.0), ("k", 2.0), ("k", 1.0), ("k", 1.0), ("k", 3.0)], "attribute_key string, value double")
    assert A.value_mode(v, ["attribute_key"]).first()[1:] == (1.0, 2)


def test_velocity_keeps_pipeline_rows_as_unknown(spark):
    v = spark.createDataFrame([(None, 1, 150), (None, 1, 151), (5, 2, 99)], "user_id long, image_id int, duration_ms int")
    got = {r.user_id: (r.username, r.images_validated, r.avg_duration_ms) for r in A.velocity(v, spark.createDataFrame([(5, "eve")], "id long, username string")).collect()}
    assert got == {0: ("unknown", 1, 150), 5: ("eve", 1, 99)}


def test_tag_rules(spark):
    a = T.affordance_tags(spark.createDataFrame([(1, "L059", 5.5), (1, "L079", 3.5), (1, "zzz", 6.0), (1, "L091", 3.4)], "item int, id string, score double"), spark.createDataFrame([("L059", "Sleep")], "id string, label string"))
    assert {(r.tag_key, r.label, r.confidence) for r in a.collect()} == {("affordance.l059.high", "Sleep (high)", 0.75), ("affordance.l079.medium", "L079 (medium)", 0.417), ("affordance.zzz.high", "zzz (high)", 0.833)}
    rooms = T.room_tags(spark.createDataFrame([(1, "living_room", 0.2), (2, "kitchen", 0.19), (3, None, 0.9)], "item int, label string, p double"))
    assert [(r.item, r.tag_key, r.label) for r in rooms.collect()] == [(1, "room_type.living_room", "Living Room")]
    objects = T.object_tags(spark.createDataFrame([(1, "Potted Plant", 0.01, 0.3), (1, "a", 0.009, 0.9), (1, "b", 0.5, 0.29)], "item int, class_name string, coverage double, confidence double"))
    assert [r.tag_key for r in objects.collect()] == ["object.potted_plant"]
    attributes = T.attribute_tags(spark.createDataFrame([(1, "style.modern_loft", 0.5), (1, "color.red", 0.9), (1, "cognitive.x", 0.4)], "item int, key string, value double"))
    assert [(r.tag_key, r.label, r.namespace) for r in attributes.collect()] == [("style.modern_loft", "Modern Loft", "style")]
    materials = T.material_tags(spark.createDataFrame([(1, " Oak_wood", 0.5, None, None), (1, "glass", 0.9, 0.03, 0.5), (1, "", 0.9, 0.9, 0.9)], "item int, material string, coverage_2d double, coverage_3d double, confidence double"))
    assert [(r.tag_key, r.label) for r in materials.collect()] == [("material.oak_wood", "Oak Wood 50%")]
    assert T.all_tags([a, rooms, objects, attributes, materials, a]).count() == 7


def test_votes_pairs_and_merges(spark):
    v = T.spatial_vote(spark.createDataFrame([(1, "wall", "brick", 0.2), (1, "wall", "wood", 0.6), (1, "wall", None, 0.9), (1, "floor", None, 0.1)], "item int, class string, material string, margin double"))
    assert sorted(str(r.material) for r in v.collect()) == ["None", "brick", "wood", "wood"]
    seg = spark.createDataFrame([(1, 1, "bed", 0.0, 0.0), (1, 2, "lamp", 3.0, 4.0), (2, 3, "bed", 0.0, 0.0)], "item int, seg int, label string, x double, y double")
    assert {tuple(r) for r in T.nearest_pairs(seg, "bed", "lamp").collect()} == {(1, 5.0), (2, -1.0)}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in T.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_reviews(spark):
    p = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "pending"), (4, "approved")], "proposal_id int, status string")
    r = spark.createDataFrame([(1, "request_changes", 1, 1), (1, "approve", 2, 2), (1, "reject", 3, 3), (2, "reject", 1, 4)], "proposal_id int, action string, reviewed_at int, review_id int")
    assert {tuple(x) for x in R.review(p, r).collect()} == {(1, "approved", 1), (2, "rejected", 0), (3, "pending", 0), (4, "approved", 0)}


def test_panel_counts_blank_guesses(spark):
    j = spark.createDataFrame([("A", "a", "5", "3"), ("A", "", "x", "1"), ("B", "A", "2", "4")], "which_is_model string, guess string, rating_A string, rating_B string")
    assert tuple(U.panel_score(j, []).first()) == (3, 1, 1 / 3, 4.5, 2.0)


def test_titles_greedy(spark):
    rows = spark.createDataFrame([("k", 1, "red room 12"), ("k", 2, "red room 13"), ("k", 3, "blue hall"), ("j", 4, "red room 1")], "kw string, n int, title string")
    assert sorted(r.n for r in U.drop_similar_titles(rows, "kw", "title", "n").collect()) == [1, 3, 4]


# --- streaming


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.sql(f"select * from {name}").collect()


def test_rate_limiter_does_not_record_refusals(spark, tmp_path):
    assert L.allow([0, 1, 2, 9.9, 10.5], [], 2, 10)[0] == [True, True, False, False, True]
    spark.createDataFrame([("a", i, float(t)) for i, t in enumerate([0, 1, 2, 9.9, 10.5])], "key string, id long, at double").coalesce(1).write.parquet(str(tmp_path / "r"))
    got = drain(L.rate_limit(spark.readStream.schema("key string, id long, at double").parquet(str(tmp_path / "r")), 2, 10), "limited", "append")
    assert [r.allowed for r in sorted(got, key=lambda r: r.id)] == [True, True, False, False, True]


def test_lifecycle(spark, tmp_path):
    rows = [(1, "start", 1), (1, "complete", 2), (2, "start", 1), (2, "fail", 2), (2, "retry", 3), (3, "complete", 1)]
    spark.createDataFrame(rows, "run_id long, event string, at long").coalesce(1).write.parquet(str(tmp_path / "e"))
    got = drain(L.run_lifecycle(spark.readStream.schema("run_id long, event string, at long").parquet(str(tmp_path / "e"))), "lifecycle", "update")
    assert {r.run_id: (r.status, r.refused) for r in got} == {1: ("COMPLETED", 0), 2: ("PENDING", 0), 3: ("PENDING", 1)}


def test_stream_gives_the_batch_ledger(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("provider"), F.col("value").alias("cost_usd"))
    e.repartition(3).write.parquet(str(tmp_path / "u"))
    got = drain(L.daily_cost(spark.readStream.schema(e.schema).parquet(str(tmp_path / "u"))), "ledger", "complete")
    assert {(r.day, r.provider, r.n) for r in got} == {(r.day, r.provider, r.n) for r in L.daily_cost(e).collect()}


# --- readers and writers


def test_image_json_and_yaml(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"images": [{"filename": "x.jpg", "url": "u/x.jpg", "meta_data": {"width": 3}}, {"path": "p/y.png", "tags": ["t"]}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"name": "z", "storage_path": "s/z"}]))
    got = {(r.filename, r.storage_path, tuple(r.tags)) for r in X.read_image_json(spark, str(tmp_path / "*.json")).collect()}
    assert got == {("x.jpg", "u/x.jpg", ()), ("y.png", "p/y.png", ("t",)), ("z", "s/z", ())}
    (tmp_path / "r.yml").write_text("# header\nattributes:\n  - id: a.b\n    name: 'One'\n    level: 2\n  - id: c\n    name: Two\n")
    assert [r.fields for r in X.read_record_yaml(spark, str(tmp_path / "r.yml")).orderBy("record").collect()] == [{"id": "a.b", "name": "One", "level": "2"}, {"id": "c", "name": "Two"}]


def test_registry_yaml_feeds_lint(spark, tmp_path):
    (tmp_path / "reg.yml").write_text("version: 1.0\ntags:\n  env.test.one:\n    canonical_name: One tag\n    definition: A thing.\n    status: active\n    value_type: ordinal\n    semantics: {aliases: [x, X]}\n")
    tags = X.read_registry_yaml(spark, str(tmp_path / "reg.yml"))
    assert {r.code for r in R.lint(tags).collect()} == {"DEF002", "DEF004", "DOM001", "ALI001"}
    assert R.diff(tags, tags).count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, (2, "a"), ["x", "y"])], "k int, s struct<n:int,t:string>, l array<string>")
    X.write_csv(df, str(tmp_path / "c"))
    assert [r.asDict() for r in X.read_csv(spark, str(tmp_path / "c"), ["k"]).collect()] == [{"k": "1", "s.n": "2", "s.t": "a", "l": "x;y"}]
    with pytest.raises(ValueError):
        X.read_csv(spark, str(tmp_path / "c"), ["absent"])
    rows = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "attribute_key string, value double")
    X.write_attributes(rows, spark.createDataFrame([("a",)], "attribute_key string"), str(tmp_path / "w"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "w")).collect()] == [("a", 0.0)]
    old = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string")
    assert {tuple(r) for r in X.compare_manifests(old, spark.createDataFrame([("p", "9"), ("r", "3")], "path string, sha256 string")).collect()} == {("p", "changed"), ("q", "missing"), ("r", "new")}


# --- kernels


def test_pixel_kernels_have_the_right_directions():
    rng = np.random.default_rng(0)
    flat, noise = np.full((32, 32, 3), 128.0), rng.integers(0, 256, (32, 32, 3)).astype(float)
    assert P.k_basic(flat)["entropy"] == 0 < P.k_basic(noise)["entropy"] and P.k_edges(flat)["edge_density"] == 0 < P.k_edges(noise)["edge_density"]
    assert P.k_colour(flat)["colourfulness"] == 0 and P.k_colour(np.stack([np.full((8, 8), c) for c in (220.0, 120.0, 40.0)], -1))["warmth"] == 1
    mirrored = np.concatenate([noise[:, :16], noise[:, :16][:, ::-1]], axis=1)
    assert P.k_symmetry(mirrored)["symmetry"] == pytest.approx(1) and P.k_symmetry(mirrored)["mirror_mse"] == 0
    assert np.allclose(P.lab(np.array([[[255.0, 255, 255]]])), [[[100, 0, 0]]], atol=0.2) and P.hsv(np.array([[[0.0, 255, 0]]]))[0][0, 0] == 120


def test_failing_kernels_are_told_in_the_row(spark, monkeypatch):
    img = spark.createDataFrame([(1, 2, 2, 3, bytearray(range(12)))], "id int, height int, width int, nChannels int, data binary")
    got = P.extract(img, ["basic", "naturalness"]).collect()
    assert {r.key.split(".")[0] for r in got} == {"basic", "naturalness"} and all(r.error is None for r in got)


def plan(spark, text):
    return spark.createDataFrame([(1, x, y, c == "#") for y, line in enumerate(text.split()) for x, c in enumerate(line)], "plan_id long, x int, y int, wall boolean")


def test_geometry(spark):
    square, corridor = "#######\n" + "#.....#\n" * 5 + "#######", "#########\n#.......#\n#########"
    a, b = (sight.isovists(plan(spark, t).where("not wall").selectExpr("plan_id", "x ox", "y oy"), plan(spark, t)).agg(F.avg("compactness"), F.avg("elongation")).first() for t in (square, corridor))
    assert a[0] > b[0] and a[1] < b[1]
    g = sight.visibility_graph(plan(spark, square)).collect()
    assert all(r.connectivity == 24 and r.mean_depth == 1 and r.clustering == 1 for r in g)
    walls = np.array([[False, True, False], [False, True, False], [False, False, False]])
    assert G.geodesic(walls, (0, 0))[0, 2] == pytest.approx(2 * math.sqrt(2) + 2)
    m = G.mirror_exposure(spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0)], "plan_id long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame([(1, 1.0, 2.0), (1, 9.0, 2.0)], "plan_id long, px double, py double")).orderBy("px").collect()
    assert [(r.iy, r.image_distance, r.self_visible) for r in m] == [(-2.0, 4.0, True), (-2.0, 4.0, False)]


def test_circular(spark):
    a = [0.1, 0.4, 1.0, 6.2, 5.9]
    r = C.descriptive(spark.createDataFrame([(x,) for x in a], "a double"), [], "a").first()
    z = np.exp(1j * np.array(a)).mean()
    assert r["mean"] == pytest.approx(np.angle(z)) and r.r == pytest.approx(abs(z)) and r.std0 == pytest.approx(math.sqrt(-2 * math.log(abs(z))))
    assert r.skewness == pytest.approx(np.sin(2 * (np.array(a) - np.angle(z))).mean())
    assert C.median(spark.createDataFrame([(x,) for x in a], "a double"), [], "a").first()[0] == pytest.approx(0.1)
    d = spark.range(1).select(C.von_mises_density(F.lit(0.3), F.lit(0.0), F.lit(2.0))).first()[0]
    assert d == pytest.approx(math.exp(2 * math.cos(0.3)) / (2 * math.pi * np.i0(2.0)), rel=1e-9)
