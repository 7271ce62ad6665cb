"""Properties and hand-computed cases of the operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thalweg.functions import columns as C
from thalweg.functions.probability import normal_two_sided, student_two_sided
from thalweg.operators import aggregates as A
from thalweg.operators import filters, geometry as G, learning as M, relevance as L, tables as U, trends as R, windows as W


def values(df, order, col):
    return [r[col] for r in df.orderBy(order).collect()]


def series(spark, vs, key=1):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(vs)], "k int, t long, value double")


def test_weighted_mean_skips_missing(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, None, 2.0), (1, 3.0, 3.0), (2, None, 1.0), (3, 5.0, 0.0)], "k int, v double, w double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(A.weighted_mean("v", "w").alias("m")).collect()}
    assert got == {1: 2.5, 2: None, 3: None}


def test_centred_smooth(spark):
    assert values(W.centred_smooth(series(spark, [1, 2, 3, 4, 5, 6]), ["k"], "t"), "t", "smooth") == [1, 2, 3, 4, 5, 6]
    assert values(W.centred_smooth(series(spark, [1, 2, None, 4, 5, 6]), ["k"], "t"), "t", "smooth") == [1, 1.5, 3, 4.25, 5, 6]


def test_fill_down_and_reflect(spark):
    assert values(W.fill_down(series(spark, [None, 2, None, None, 5]), ["k"], "t"), "t", "filled") == [None, 2, 2, 2, 5]
    assert values(W.reflect_pad(series(spark, [1, 2, 3, 4]), ["k"], "t", 2), "t", "value") == [3, 2, 1, 2, 3, 4, 3, 2]


def test_extreme_level_takes_first_of_ties(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.0), (1, 2, 1.0), (2, 0, None), (2, 1, None)], "lat int, lev int, value double")
    assert {r["lat"]: r["level"] for r in W.extreme_level(df, ["lat"], "lev").collect()} == {1: 0, 2: 0}


def test_spreads(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 0, 3.0), (1, 1, 10.0), (1, 1, 14.0)], "k int, b int, value double")
    g = A.grand_spread(df, ["k"], 4).first()
    assert g["mean"] == 7 and math.isclose(g["spread"], math.sqrt(110 / 3)) and not g["unpriced"]
    assert math.isclose(A.branch_spread(df, ["k"], "b", 4).first()["spread"], math.sqrt(5))
    short = df.withColumn("value", F.when(F.col("value") != 3, F.col("value")))
    b = A.branch_spread(short, ["k"], "b", 4).first()
    assert b["spread"] is None and b["nobs"] == 3


def test_dateline_boxes_and_binning(spark):
    box = spark.createDataFrame([(1, 179.0, -179.0, -5.0, 5.0, True)], "box int, lon_b1 double, lon_b2 double, lat_b1 double, lat_b2 double, across_180 boolean")
    cells = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate((179.5, -179.5, 178.9, -179.0))], "cell int, lon double, lat double")
    assert sorted(r["cell"] for r in G.membership(cells, box, "box").collect()) == [0, 1]
    nested = cells.join(box, G.in_box(F.col("lon"), F.col("lat")))
    assert sorted(r["cell"] for r in nested.collect()) == [0, 1]


def test_interpolation(spark):
    knots = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 20.0)], "k int, x double, value double")
    at = spark.createDataFrame([(1, 4.0), (1, 12.0), (1, 10.0)], "k int, x double")
    assert values(W.interpolate(knots, at, ["k"], "x"), "x", "value") == [8.0, 20.0, None]
    assert values(W.interpolate(knots, at, ["k"], "x", clamp=True), "x", "value") == [8.0, 20.0, 20.0]


def test_physics(spark):
    df = spark.createDataFrame([(7.4999, 3.0, 4.0), (7.5, 3.0, 4.0)], "s double, u double, v double")
    x, y = C.wind_stress("u", "v")
    a, b = df.select(C.drag_coefficient("s").alias("c"), x.alias("x"), y.alias("y")).collect()
    assert a["c"] == 1e-3 and math.isclose(b["c"], 0.0010825) and math.isclose(a["x"], 0.0183) and math.isclose(a["y"], 0.0244)


def test_text(spark):
    row = spark.range(1).select(
        C.parse_numbers(F.lit("1,6-10")).alias("n"), C.number_slug(F.lit(-45.5)).alias("m"), C.number_slug(F.lit(26.5), True).alias("p"), C.epsilon_slug(F.lit(1e-6)).alias("e"),
        C.epsilon_slug(F.lit(0.0)).alias("z"), C.decimal_year(F.lit("2009-12-01").cast("date")).alias("y"), C.filter_years(F.lit("a_LPF10Year")).alias("f"),
    ).first()
    assert (row["n"], row["m"], row["p"], row["e"], row["z"], row["y"], row["f"]) == ([1, 6, 7, 8, 9, 10], "m45p5", "p26p5", "epsilon_1e-06", "lrp0_z_rule", 2010.0, 10)


def test_false_discovery(spark):
    p = spark.createDataFrame([(i, x) for i, x in enumerate((0.001, 0.02, 0.03, 0.2))] , "k int, p double")
    assert values(R.false_discovery(p, [], alpha=0.091), "k", "fdr_significant") == [True, True, True, False]
    p = spark.createDataFrame([(i, x) for i, x in enumerate((0.01, 0.05, 0.06, 0.09))] + [(9, None)], "k int, p double")
    assert values(R.false_discovery(p, [], alpha=0.091), "k", "fdr_significant") == [True, False, False, False, None]


def test_trend_is_exact_on_lines_and_poisoned_by_gaps(spark):
    good, bad = series(spark, [3 + 2 * t for t in range(10)]), series(spark, [1, None, 3], 2)
    got = {r["k"]: r["slope"] for r in R.ols(good.union(bad), ["k"], "t").collect()}
    assert math.isclose(got[1], 2.0) and got[2] is None


def test_bootstrap_block_length_keeps_slopes(spark):
    rng = np.random.default_rng(1)
    df = series(spark, rng.normal(size=60).cumsum())
    a, b = (R.bootstrap_sigma(df, ["k"], "t", block=k, draws=200).first() for k in (0, 12))
    assert abs(a["slope"] - b["slope"]) < 1e-12 and a["sigma_serial"] > 0 and b["sigma_serial"] > 0
    assert R.block_starts(5, 4, 1, 0).shape == (1, 5)


def test_plain_bootstrap_matches_matrix(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=24)
    got = R.bootstrap_sigma_plain(series(spark, y), ["k"], "t", 24, 5, 30).first()["sigma_serial"]
    t = np.arange(24.0)
    x = t - t.mean()
    slope = y @ x / (x @ x)
    resid = y - y.mean() - slope * x
    idx = np.array([[(d * 7919 + b * 104729 + d * b * 31) % 24 + k for b in range(5) for k in range(5)][:24] for d in range(30)]) % 24
    assert math.isclose(got, (resid[idx] @ (x / (x @ x))).std(ddof=1), rel_tol=1e-9)


@settings(max_examples=20, deadline=None)
@given(st.floats(-5, 5), st.integers(30, 80))
def test_filter_keeps_constants_and_is_symmetric(level, n):
    flat = filters.zero_phase(np.full((n, 1), level), 5, 1 / 24, 24)
    assert np.allclose(flat, level, atol=1e-8 * max(1, abs(level)))
    x = np.random.default_rng(n).normal(size=(n, 1))
    both = filters.zero_phase(x, 5, 1 / 24, 24), filters.zero_phase(x[::-1], 5, 1 / 24, 24)[::-1]
    assert both[0].shape == x.shape


def test_filter_gain_at_cutoff():
    for order in (1, 2, 4, 5):
        z, gain, rest = np.exp(-2j * np.pi / 24), 1.0, 1.0
        for b, a in filters.butterworth(order, 1 / 24):
            gain, rest = gain * abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)), rest * b.sum() / a.sum()
        assert math.isclose(gain**2, 0.5, rel_tol=1e-9) and math.isclose(rest, 1.0, rel_tol=1e-9)
    t = np.arange(960)
    wave = np.cos(2 * np.pi * t / 24)[:, None]
    mid = filters.zero_phase(wave, 5, 1 / 24, 48)[300:660, 0]
    assert abs(mid.max() - 0.5) < 0.02


def test_lowpass_forms_agree_and_gaps_raise(spark):
    df = series(spark, np.random.default_rng(3).normal(size=60))
    a, b = filters.lowpass(df, ["k"], "t"), filters.lowpass_by_matrix(df, ["k"], "t", 60)
    assert np.allclose(values(a, "t", "value"), values(b, "t", "value"))
    with pytest.raises(Exception, match="missing"):
        filters.lowpass(series(spark, [1.0, None] * 12), ["k"], "t").collect()
    assert values(filters.lowpass(series(spark, [None] * 6), ["k"], "t"), "t", "value") == [None] * 6


def test_noise_repeats_and_has_its_sigma(spark):
    e = spark.createDataFrame([(r, t, 2.0) for r in range(20) for t in range(30)], "r int, t long, s double")
    a, b = (filters.noise_draws(e, "r", "t", "s", 2).orderBy("draw", "r", "t").toPandas() for _ in range(2))
    assert a.equals(b) and abs(a["noise"].std() - 2.0) < 0.2
    c = filters.noise_draws(e, "r", "t", "s", 1, "coherent").groupBy("t").agg(F.stddev_pop("noise").alias("s")).agg(F.max("s")).first()[0]
    assert c < 1e-9
    km = np.abs(np.subtract.outer(np.arange(20.0), np.arange(20.0))) * 100
    root = G.exponential_cholesky(km, 300.0)
    assert np.allclose(root @ root.T, np.exp(-km / 300.0), atol=1e-6)
    assert filters.noise_draws(e, "r", "t", "s", 1, "correlated", root).count() == 600


def test_gradients_are_those_of_the_error():
    rng = np.random.default_rng(4)
    x, y, shapes = rng.normal(size=(30, 4)), rng.normal(size=(30, 2)), M.network_shapes(4, 2, (5, 3))
    flat = rng.normal(size=sum(math.prod(s) for s in shapes)) / 2
    half = lambda v, kind: 0.5 * ((M.forward(x, M.unpacked(v, shapes), kind)[0] - y) ** 2).sum()
    for kind in ("linear", "tanh", "sigmoid", "swish", "elu", "leaky_relu"):
        grads = M.gradient_sums(x, y, M.unpacked(flat, shapes), kind)
        for i in range(0, len(flat), 5):
            step = np.zeros_like(flat)
            step[i] = 1e-6
            assert math.isclose(grads[i], (half(flat + step, kind) - half(flat - step, kind)) / 2e-6, rel_tol=1e-4, abs_tol=1e-5), (kind, i)


def test_networks_learn_side_by_side(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 4))
    y = np.stack([x[:, 0] - x[:, 1], x[:, 2]], 1)
    rows = [(i % 2, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "fold int, x array<double>, y array<double>")
    few, more = (M.train_ensemble(df.repartition(n), 2, 1, (6,), epochs=e, rate=0.03).orderBy("fold").collect() for n, e in ((3, 2), (1, 25)))
    assert [(r["fold"], r["member"]) for r in more] == [(0, 0), (1, 0)] and all(b["loss"] < 0.6 * a["loss"] for a, b in zip(few, more))
    # The sums of partitions are those of one matrix: a plain loop over the whole set does the same steps.
    shapes, again = M.network_shapes(4, 2, (6,)), M.train_ensemble(df, 2, 1, (6,), epochs=2, rate=0.03).orderBy("fold").collect()
    assert np.allclose([r["weights"] for r in again], [r["weights"] for r in few], atol=1e-9)
    held = np.arange(120) % 2 == 0
    net = M.unpacked(np.array(more[0]["weights"]), shapes)
    assert math.isclose(((M.forward(x[held], net, "swish")[0] - y[held]) ** 2).mean(), more[0]["loss"], rel_tol=1e-9)


def test_relevance_is_conserved(spark):
    rng = np.random.default_rng(0)
    x, shapes = rng.normal(size=(20, 4)), M.network_shapes(4, 2, (8, 6))
    net = M.unpacked(rng.normal(size=sum(math.prod(s) for s in shapes)), shapes)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample int, x array<double>")
    for kind in ("swish", "tanh", "relu"):
        got, minus = (L.explain(rows, [(0, *net)], "sample", [h, 0.0], kind=kind).toPandas() for h in (1.0, -1.0))
        assert np.abs(got["remainder"]).max() < 1e-8
        assert np.allclose(got["relevance"].map(sum) + got["bias"], got["output"])
        assert np.allclose(got["output"], M.forward(x, net, kind)[0][got["sample"], 0])
        assert np.allclose(np.stack(got["relevance"]), -np.stack(minus["relevance"]))


def test_one_linear_layer():
    r, bias, rest, out = L._backward(np.array([[1.0, 2.0]]), [np.array([[1.0], [1.0]]), np.array([[1.0]])], [np.zeros(1), np.zeros(1)], np.zeros((1, 1)), np.array([1.0]), 1e-12, "linear")
    assert np.allclose(r, [[1.0, 2.0]]) and np.allclose(rest, 0) and np.allclose(out, 3)


def test_components_reconstruct(spark):
    x = np.random.default_rng(5).normal(size=(40, 3)) @ np.diag([3.0, 2.0, 1.0]) + 7.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample int, x array<double>")
    comps = M.fit_components(df, "sample", 3)
    scores = M.project(df, comps, "sample")
    assert np.allclose(np.stack(scores.orderBy("sample").toPandas()["score"]).var(axis=0, ddof=1), np.linalg.eigvalsh(np.cov(x.T))[::-1])
    long = scores.select("sample", F.posexplode("score").alias("component", "score"))
    back = M.unproject(long, comps, "sample", "feature").toPandas().pivot(index="sample", columns="feature", values="value").to_numpy()
    assert np.allclose(back, x)


def test_flood_fill_and_sets(spark):
    g = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, 3)], "i int, j int")
    assert sorted((r["i"], r["j"]) for r in G.flood_fill(g, (0, 0)).collect()) == [(0, 0), (0, 1), (1, 1)]
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted((r["k"], r["state"]) for r in U.set_difference(a, b, ["k"]).collect()) == [(1, "missing"), (3, "extra")]


def test_tail_probabilities(spark):
    two, four = lambda t: 1 - t / math.sqrt(2 + t * t), lambda t: 1 - 0.75 * t / math.sqrt(1 + t * t / 4) * (1 - t * t / (12 + 3 * t * t))
    known = [(2.0, 10.0, 0.07338803), (0.0, 5.0, 1.0), (12.706205, 1.0, 0.05), *[(t, 2.0, two(t)) for t in (0.5, 3.0, 20.0)], *[(t, 4.0, four(t)) for t in (0.5, 3.0, 20.0)]]
    got = spark.createDataFrame([(float(i), t, d) for i, (t, d, _) in enumerate(known)], "i double, t double, d double").withColumn("p", student_two_sided(F.col("t"), F.col("d"))).orderBy("i").collect()
    assert all(math.isclose(r["p"], p, rel_tol=2e-6) for r, (_, _, p) in zip(got, known)), got
    zs = [0.0, 1e-9, 0.3, 1.4999, 1.5001, 2.0, 5.0, 8.0]
    ps = [r["p"] for r in spark.createDataFrame([(z,) for z in zs], "z double").withColumn("p", normal_two_sided(F.col("z"))).orderBy("z").collect()]
    assert all(math.isclose(p, math.erfc(z / math.sqrt(2)), rel_tol=1e-9) for z, p in zip(zs, ps))


def test_percentiles_and_false_discovery(spark):
    rng = np.random.default_rng(8)
    v, k = rng.integers(0, 40, 500) / 4.0, rng.integers(0, 3, 500)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(k, v)] + [(0, None), (9, None)], "k int, value double")
    got = {r["k"]: (r["p5"], r["p90"], r["median"]) for r in A.percentiles(df, ["k"], (0.05, 0.9)).collect()}
    assert set(got) == {0, 1, 2} and all(np.allclose(got[i], np.quantile(v[k == i], (0.05, 0.9, 0.5))) for i in got)
    p = np.round(rng.random(60) ** 3, 2)
    told = [r["fdr_significant"] for r in R.false_discovery(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(99, None)], "i int, p double"), []).orderBy("i").collect()]
    ranked = np.sort(p)
    passing = ranked[ranked <= np.arange(1, 61) / 60 * R.FDR_ALPHA]
    assert told == [bool(x <= min(passing.max(initial=-1.0), 0.0455)) for x in p] + [None]


def test_stretches_match_plain_regression(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(size=40).cumsum()
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(y)] + [(2, t, float(t) if t != 11 else None) for t in range(40)], "k int, t long, value double")
    cases = [(0, 0, 39, None, None), (1, 5, 20, None, None), (2, 3, 35, 10, 14), (3, 0, 39, 12, 12), (4, 20, 10, None, None), (5, 12, 39, 30, 90)]
    got = {(r["k"], r["s"]): (r["slope"], r["n"]) for r in R.stretch_trends(df, ["k"], "t", spark.createDataFrame(cases, "s int, lo long, hi long, cut_lo long, cut_hi long"), "s").collect()}
    assert set(got) == {(k, s) for k in (1, 2) for s in (0, 1, 2, 3, 5)}
    for s, lo, hi, a, b in cases:
        t = np.array([i for i in range(lo, hi + 1) if a is None or not a <= i <= b])
        if len(t):
            assert got[1, s][1] == len(t) and math.isclose(got[1, s][0], np.polyfit(t, y[t], 1)[0], rel_tol=1e-7)
            assert (got[2, s][0] is None) == (11 in t)


def test_gates_raise(spark):
    from thalweg.operators import checks

    with pytest.raises(ValueError, match="drag law"):
        C.drag_coefficient("x", "none")
    one = spark.range(1)
    for bad in (C.epsilon_slug(F.lit(-1.0)), C.source_suffix(F.lit("X"), F.lit("DUACS"), F.lit("CCMP")), checks.expected_number(F.lit(1000.0), F.lit(1025.0))):
        with pytest.raises(Exception, match="epsilon|no source|expected"):
            one.select(bad).collect()
    assert checks.expected_number(F.lit(1.0), F.lit(1.0)) is not None


def test_partitioning_does_not_matter(spark):
    df = series(spark, range(50))
    want = values(W.centred_smooth(df, ["k"], "t"), "t", "smooth")
    for n in (1, 17):
        assert values(W.centred_smooth(df.repartition(n), ["k"], "t"), "t", "smooth") == want


def greedy_folds(sizes, k):
    load, folds = [0] * k, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0] is None, -(x[0] or 0))):
        folds[name] = min(range(k), key=lambda f: (load[f], f))
        load[folds[name]] += n
    return folds


def test_group_folds_are_greedy(spark):
    from thalweg.plans.queries import QUERIES

    sizes = {1: 40, 2: 9, 3: 9, 4: 8, None: 8, 5: 7, 6: 3, 7: 1}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g long, i int")
    got = M.group_folds(df.repartition(3), "g", 3)
    assert got.dtypes == [("g", "bigint"), ("fold", "int")] and {r["g"]: r["fold"] for r in got.collect()} == greedy_folds(sizes, 3)
    d = "/root/testdata/sf0.001"
    sizes = {r["l_suppkey"]: r["count"] for r in spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey").count().collect()}
    assert {r["l_suppkey"]: r["fold"] for r in QUERIES["group_kfold"](spark, d).collect()} == greedy_folds(sizes, 5)
