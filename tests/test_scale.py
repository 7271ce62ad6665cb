"""Work of operators follows distinct places and stretches, not pairs of rows; results are those of plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from thalweg.operators import geometry as G
from thalweg.operators import montecarlo as N
from thalweg.operators import trends as R


def most(df, kind):
    """The most rows that any node of that kind has made."""
    df.collect()

    def walk(p):
        below = [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
        name, made = p.nodeName(), 0
        if kind in name and p.metrics().contains("numOutputRows"):
            made = p.metrics().apply("numOutputRows").value()
        return max([made, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_distances_are_taken_between_places(spark):
    r = random.Random(5)
    places = [(r.uniform(-180, 180), r.uniform(-89.9, 89.9)) for _ in range(150)] + [(179.9, 10.0), (-179.9, 10.5), (0.0, 89.5), (180.0, 89.6)]
    rows = [(n, *places[n % len(places)]) for n in range(3 * len(places))]
    got = G.pairwise_distance(spark.createDataFrame(rows, "k long, lon double, lat double"), "k", 900.0)
    want = {}
    for a, lon, lat in rows:
        for b, x, y in rows[a + 1 :]:
            cosine = math.sin(math.radians(lat)) * math.sin(math.radians(y)) + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.cos(math.radians(lon - x))
            if (km := 6371.0 * math.acos(max(-1.0, min(1.0, cosine)))) <= 900.0:
                want[a, b] = km
    told = {(x["a"], x["b"]): x["km"] for x in got.collect()}
    assert told.keys() == want.keys() and all(abs(told[k] - v) < 1e-3 for k, v in want.items())
    crowd = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 3).cast("double").alias("lon"), F.lit(0.5).alias("lat"))
    crowd = G.pairwise_distance(crowd, "k", 900.0)
    assert crowd.count() == 600 * 599 // 2 and most(crowd, "Join") < 1000


def crowded(spark):
    """Cells at two places, some missing or without weight, and boxes of two shapes, one across 180 degrees."""
    cells = spark.range(400).select(F.col("id").alias("cell"), F.when(F.col("id") % 2 == 0, 1.5).otherwise(179.5).alias("lon"), F.lit(2.5).alias("lat"), F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("v"), (F.col("id") % 7 - 1.0).alias("w"))
    far = F.col("id") % 3 == 0
    bounds = {"lon_b1": F.when(far, 175.0).otherwise(0.0), "lon_b2": F.when(far, -175.0).otherwise(9.0), "lat_b1": F.lit(0.0), "lat_b2": F.lit(10.0), "across_180": far}
    return cells, spark.range(300).select(F.col("id").alias("box"), *[v.alias(k) for k, v in bounds.items()])


def test_members_come_from_places_and_shapes(spark):
    cells, boxes = crowded(spark)
    got = G.membership(cells.select("cell", "lon", "lat", "v"), boxes, "box")
    assert got.columns == ["box", "cell", "lon", "lat", "v"] and most(got, "Join") < 1000
    assert {(r["box"], r["cell"], r["v"]) for r in got.collect()} == {(b, c, None if c % 5 == 0 else float(c)) for b in range(300) for c in range(400) if (b % 3 == 0) == (c % 2 == 1)}
    assert got.count() == 300 * 200


def test_means_of_regions_make_no_row_for_a_pair(spark):
    cells, boxes = crowded(spark)
    means = G.region_mean(cells, boxes, "box", "v", "w")
    got = {r["box"]: r["v"] for r in means.collect()}
    for b in (0, 1):
        own = [(float(c), max(0.0, c % 7 - 1.0)) for c in range(400) if c % 5 and (b == 0) == (c % 2 == 1)]
        assert abs(got[b] - sum(v * w for v, w in own) / sum(w for _, w in own)) < 1e-9
    assert len(got) == 300 and most(means, "Join") <= 300


def test_points_of_one_place_are_looked_up_once(spark, monkeypatch):
    written, keep = [], G.materialised
    monkeypatch.setattr(G, "materialised", lambda df, name="step": (written.append((name, keep(df, name))), written[-1][1])[1])
    grid = spark.range(400).select((F.col("id") % 20).alias("i"), F.floor(F.col("id") / 20).alias("j"), (F.col("id") % 20 * 2.0).alias("lon"), (F.floor(F.col("id") / 20) * 2.0).alias("lat"))
    points = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3 * 9.3).alias("plon"), (F.col("id") % 2 * 7.1).alias("plat"))
    got = G.nearest_cell(points, grid, "k", []).collect()
    assert {(r["k"], r["i"], r["j"]) for r in got} == {(k, round(k % 3 * 9.3 / 2), round(k % 2 * 7.1 / 2)) for k in range(3000)} and len(got) == 3000
    assert max(df.count() for name, df in written if name == "nearest") <= 6


def test_a_barrier_of_many_points_is_a_few_places(spark, monkeypatch):
    written, keep = [], G.materialised
    monkeypatch.setattr(G, "materialised", lambda df, name="step": (written.append((name, keep(df, name))), written[-1][1])[1])
    grid = spark.range(100).select((F.col("id") % 10).alias("i"), F.floor(F.col("id") / 10).alias("j"), (F.col("id") % 10).cast("double").alias("lon"), F.floor(F.col("id") / 10).cast("double").alias("lat"))
    line = spark.range(2000).select(F.col("id").alias("k"), F.lit(4.2).alias("plon"), (F.col("id") % 10).cast("double").alias("plat"))
    left = G.block_line(grid.select("i", "j"), grid, line, "k").collect()
    assert {(r["i"], r["j"]) for r in left} == {(i, j) for i in range(10) for j in range(10) if i != 4}
    assert max(df.count() for name, df in written if name == "nearest") <= 10


def test_a_barrier_does_not_move_its_points(spark):
    grid = spark.range(100).select((F.col("id") % 10).alias("i"), F.floor(F.col("id") / 10).alias("j"), (F.col("id") % 10).cast("double").alias("lon"), F.floor(F.col("id") / 10).cast("double").alias("lat"))
    line = spark.range(5000).select(F.col("id").alias("k"), F.lit(4.2).alias("plon"), (F.col("id") % 2).cast("double").alias("plat"))
    out = G.block_line(grid.select("i", "j"), grid, line, "k")
    assert {(r["i"], r["j"]) for r in out.collect()} == {(i, j) for i in range(10) for j in range(10) if (i, j) not in ((4, 0), (4, 1))}
    assert most(out, "Join") <= 100


def test_names_of_one_stretch_are_fitted_as_one(spark):
    df = spark.createDataFrame([(k, t, float(t * t + k)) for k in (1, 2) for t in range(30)], "k int, t long, value double")
    names = spark.range(2000).select(F.col("id").alias("s"), (F.col("id") % 2).alias("lo"), F.lit(20).cast("long").alias("hi"), F.when(F.col("id") % 2 == 0, 5).cast("long").alias("cut_lo"), F.when(F.col("id") % 2 == 0, 8).cast("long").alias("cut_hi"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = R.stretch_trends(df, ["k"], "t", names, "s")
        got = {(r["k"], r["s"]): (r["slope"], r["n"]) for r in out.collect()}
        sent = most(out, "BroadcastExchange")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for odd in (0, 1):
        t = np.array([x for x in range(odd, 21) if odd or not 5 <= x <= 8], float)
        assert all(abs(got[k, odd][0] - np.polyfit(t, t * t + k, 1)[0]) < 1e-6 and got[k, odd][1] == len(t) for k in (1, 2))
        assert len({got[1, s] for s in range(odd, 2000, 2)}) == 1
    assert len(got) == 4000 and sent <= 100


def test_nearest_earlier_regions_by_cubes(spark, monkeypatch):
    monkeypatch.setattr(N, "FIRST", 16)
    monkeypatch.setattr(N, "IN_CUBE", 3)
    r = random.Random(8)
    at = [(r.uniform(-89, 89), r.uniform(-180, 180)) for _ in range(200)] + [(80.0 + r.random(), r.uniform(-180, 180)) for _ in range(60)]
    at += [at[r.randrange(200)] for _ in range(100)] + [(5.0, 5.0)] * 40
    r.shuffle(at)
    unit = np.array([(math.cos(math.radians(a)) * math.cos(math.radians(o)), math.cos(math.radians(a)) * math.sin(math.radians(o)), math.sin(math.radians(a))) for a, o in at])
    out = N.neighbour_weights(spark.createDataFrame([(n, a, o) for n, (a, o) in enumerate(at)], "region long, lat double, lon double"), 2000.0, 3)
    got = {x["region"]: x for x in out.collect()}
    assert sorted(got) == list(range(len(at)))
    for n, x in got.items():
        dots = unit[:n, 0] * unit[n, 0] + unit[:n, 1] * unit[n, 1] + unit[:n, 2] * unit[n, 2]
        assert x["neighbours"] == sorted(np.argsort(-dots, kind="stable")[:3].tolist()) and len(x["weights"]) == len(x["neighbours"])


