"""What is shuffled: sums instead of rows a round, judgments once instead of once a window, an item's words once."""

import datetime
import hashlib
import random
from decimal import Decimal

from pyspark.sql import functions as F

from glyphmill.operators import matching as H
from glyphmill.operators import rooms as R
from glyphmill.streaming import expiring as X


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_signed_sums_are_exact(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), i, Decimal(rng.randrange(-(10**17), 10**17)) / 10**6) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, i int, d decimal(18,6)").repartition(5)
    h = F.concat(F.md5(F.concat(F.lit("0:"), F.col("i").cast("string"))), F.md5(F.concat(F.lit("1:"), F.col("i").cast("string"))))
    got = {tuple(r)[:3]: (r.s, r.n) for r in H.signed_sums(df.select("g", "k", (F.col("d") * 1000000).cast("long").alias("d"), h.alias("h")), ["g", "k"], 40).collect()}
    want = {}
    for g, k, i, d in rows:
        digits = "0" + "".join(hashlib.md5(f"{j}:{i}".encode()).hexdigest() for j in (0, 1))
        for n in range(41):
            s, c = want.get((g, k, n), (Decimal(0), 0))
            want[g, k, n] = (s + (d if digits[n] < "8" else -d), c + 1)
    assert got == want


def test_judgments_are_shuffled_before_windows(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, datetime.datetime(2024, 1, 1))], "image_id long, attribute_key string, value double, created_at timestamp")
    assert plan_of(X.sliding_agreement(rows)).count("hashpartitioning(window") == 1


def test_vocabulary_is_looked_up_without_a_join_of_the_grid(spark):
    said = [(1, "A", "Soft  bed!", "Positive"), (1, "A", "soft bed", "neutral"), (2, None, "desk", "positive"), (2, "A", None, "negative"), (None, "A", "desk", "positive"), (3, "A", "DESK", "negative"), (3, "A", "desk", "negative")]
    found = R.indicator_features(spark.createDataFrame(said, "item long, affordance string, name string, polarity string"), spark.createDataFrame([("A", "soft_bed"), ("A", "desk")], "affordance string, name string"))
    got = {(r.item, r.feature): r.value for r in found.collect()}
    assert {k for k, v in got.items() if v} == {(1, "ind_A_pos_soft_bed"), (3, "ind_A_neg_desk")} and len(got) == found.count() == 16
    assert "LeftOuter" not in plan_of(found)


def test_maps_of_dimension_broadcast_nothing(spark):
    from glyphmill.operators.fractal import dimension_map

    edges = spark.range(512).selectExpr("id DIV 256 AS id", "CAST(id % 16 AS INT) AS x", "CAST(id DIV 16 % 16 AS INT) AS y").selectExpr("*", "CAST((x * y + id) % 3 % 2 AS INT) AS edge")
    assert "Broadcast" not in plan_of(dimension_map(edges, "id", 8, 4))
