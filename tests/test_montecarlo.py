"""Refitted scenarios, noise Monte Carlo, sparse roots and tail probabilities against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions.probability import normal_two_sided, student_two_sided
from thalweg.operators import filters, geometry as G, montecarlo as N, trends as R


def plain_refit(y, times, months, block, draws, seed):
    """One series' slope and serial sigma over the given places of the time axis, draw by draw."""
    t, v = times[months], y[months]
    x = t - t.mean()
    a = x / (x @ x)
    slope = a @ v
    resid = v - v.mean() - slope * x
    rng, n = np.random.default_rng(seed), len(t)
    block = max(1, min(block, n))
    away = []
    for _ in range(draws):
        starts = rng.integers(0, n, -(-n // block))
        index = (starts[:, None] + np.arange(block)).ravel()[:n] % n
        away.append(a @ resid[index])
    return slope, np.std(away, ddof=1)


def test_refits_equal_a_plain_bootstrap(spark):
    rng = np.random.default_rng(3)
    times = np.array([t for t in range(100, 160) if t != 131], float)
    cells = {k: np.cumsum(rng.normal(size=len(times))) + 50 * k for k in range(4)}
    cells[3][5] = np.nan
    rows = [(k, int(t), None if math.isnan(v) else float(v)) for k, y in cells.items() for t, v in zip(times, y)] + [(9, 100, 1.0)]
    df = spark.createDataFrame(rows, "cell int, t long, value double")
    scenarios = [("whole", 12, None, None, None, None), ("cut", 5, 103, 155, 120, 126), ("single", 0, 110, None, None, None), ("long", 500, None, 140, None, None), ("short", 4, 100, 101, None, None)]
    got = {(r["scenario"], r["cell"]): r for r in R.refits(df, ["cell"], "t", spark.createDataFrame(scenarios, R.SCENARIO), draws=200, seed=7).collect()}
    assert {s for s, _ in got} == {"whole", "cut", "single", "long"}
    for name, block, lo, hi, a, b in scenarios[:-1]:
        keep = [(lo is None or t >= lo) and (hi is None or t <= hi) and not (a is not None and a <= t <= b) for t in times]
        own = np.flatnonzero(keep)
        for k, y in cells.items():
            r = got[name, k]
            assert r["n"] == len(own)
            if np.isnan(y[own]).any():
                assert r["slope"] is None and r["sigma_serial"] is None
                continue
            slope, sigma = plain_refit(y, times, own, block, 200, 7)
            assert abs(r["slope"] - slope) < 1e-9 and abs(r["sigma_serial"] - sigma) < 1e-9
        assert got[name, 9]["slope"] is None
    alone = {r["cell"]: r for r in R.bootstrap_sigma(df, ["cell"], "t", block=12, draws=200, seed=7).collect()}
    assert all(alone[k]["sigma_serial"] == got["whole", k]["sigma_serial"] for k in alone)


def test_the_grid_of_scenarios(spark):
    months = spark.range(396, 396 + 260).select(F.col("id").alias("month_ix"))
    grid = R.robustness_grid(months, (570, 580)).collect()
    families = {f: [r for r in grid if r["family"] == f] for f in {r["family"] for r in grid}}
    assert {f: len(x) for f, x in families.items()} == {"baseline": 1, "startend": 24, "gap": 5, "split": 2, "jackknife": 22, "serial": 5}
    assert len({r["scenario"] for r in grid}) == len(grid)
    assert all(r["hi"] - r["lo"] + 1 >= 144 for r in families["startend"])
    last = max(families["jackknife"], key=lambda r: r["scenario"])
    assert (last["scenario"], last["cut_lo"], last["cut_hi"]) == ("drop 2024", 648, 655)


def test_noise_monte_carlo_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    months, samples = np.arange(60), np.array([t for t in range(60) if t % 7 != 4 or t in (0, 59)], float)
    base = rng.normal(size=(60, 5))
    nets = [([rng.normal(size=(5, 4)), rng.normal(size=(4, 3))], [rng.normal(size=4), rng.normal(size=3)], rng.normal(size=(4, 3))) for _ in range(3)]
    noise = N.seeded_noise(np.full((len(samples), 2), 0.1), seed=2)
    chain = N.observation_operator(samples, months, (10, 40))
    respond = N.ensemble_response(nets)
    told = {}
    for parts in (1, 5):
        monthly, cells = N.noise_budget(*N.monte_carlo(spark, base, respond, noise, chain, 3, 37, parts))
        told[parts] = monthly.orderBy("cell", "month").toPandas(), cells.orderBy("cell").toPandas()
    away, trends = [], []
    for draw in range(37):
        x = base.copy()
        own = np.stack([np.interp(months, samples, z) for z in noise(draw).T], axis=1)
        own = own - own[(months >= 10) & (months <= 40)].mean(axis=0)
        own = filters.zero_phase(own - own.mean(axis=1, keepdims=True), 5, 1 / 24, 24)
        x[:, 3:] += own
        pred = respond(x)
        away.append(pred - respond(base))
        trends.append([np.polyfit(months, pred[:, c], 1)[0] for c in range(3)])
    away = np.array(away)
    for monthly, cells in told.values():
        assert np.allclose(monthly["bias"].to_numpy().reshape(3, 60).T, away.mean(axis=0), atol=1e-9)
        assert np.allclose(monthly["sigma"].to_numpy().reshape(3, 60).T, away.std(axis=0, ddof=1), atol=1e-9)
        assert np.allclose(cells["sigma_month"], np.sqrt(away.var(axis=0, ddof=1).mean(axis=0)), atol=1e-9)
        assert np.allclose(cells["sigma_trend"], np.std(trends, axis=0, ddof=1), atol=1e-9) and set(cells["n"]) == {37}


def centres(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.uniform(-60, 60)), float(rng.uniform(-180, 180))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "region long, lat double, lon double").repartition(3)


def distances(rows):
    lat, lon = (np.deg2rad([r[k] for r in rows]) for k in (1, 2))
    cosine = np.sin(lat)[:, None] * np.sin(lat) + np.cos(lat)[:, None] * np.cos(lat) * np.cos(lon[:, None] - lon)
    km = 6371.0 * np.arccos(np.clip(cosine, -1, 1))
    np.fill_diagonal(km, 0.0)
    return km


def test_sparse_root_is_cholesky_with_all_neighbours(spark):
    rows, df = centres(spark, 40, 1)
    root = N.sparse_root(N.neighbour_weights(df, 2000.0, 40))
    want = G.exponential_cholesky(distances(rows), 2000.0)
    assert np.allclose(root.apply(np.eye(40)), want, atol=1e-7)


def test_sparse_root_of_many_regions(spark):
    rows, df = centres(spark, 5000, 2)
    root = N.sparse_root(N.neighbour_weights(df, 1500.0, 20))
    assert root.neighbours.shape == (5000, 20) and len(root.levels) < 2000
    own = np.random.default_rng(0).choice(5000, 150, replace=False)
    z = root.apply(np.random.default_rng(4).standard_normal((5000, 3000)))[own]
    want = np.exp(-distances([rows[i] for i in own]) / 1500.0)
    # The error of a sample covariance of 3,000 draws is about 0.018.
    assert np.abs(np.cov(z) - want).max() < 0.12 and np.abs(np.cov(z) - want).mean() < 0.02
    with pytest.raises(ValueError, match="numbered"):
        N.neighbour_weights(df.where("region != 3"), 1.0, 2)


def test_noise_of_all_modes():
    sigma = np.outer(np.linspace(1, 2, 50), [1.0, 2.0, 0.5])
    root = N.SparseRoot(np.array([[0], [0], [1]]), np.array([[0.0], [0.9], [0.0]]), np.array([1.0, math.sqrt(0.19), 1.0]))
    for mode, r01 in (("independent", 0.0), ("coherent", 1.0), ("correlated", 0.9)):
        draw = N.seeded_noise(sigma, mode, root, 3)
        x = np.array([draw(k) / sigma for k in range(400)]).reshape(-1, 3)
        assert np.abs(x.std(axis=0) - 1).max() < 0.03 and abs(np.corrcoef(x[:, 0], x[:, 1])[0, 1] - r01) < 0.03
        assert (draw(7) == draw(7)).all() and not (draw(7) == draw(8)).all()
    with pytest.raises(ValueError):
        N.seeded_noise(sigma, "correlated")


def test_tail_probabilities_and_their_code(spark):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        df = spark.createDataFrame([(0.0, 1.0), (-0.3, 2.0), (1.4999, 8.2), (1.5, 3.3), (4.2, 25.0), (None, 3.0), (1.0, None), (30.0, 4.0)], "z double, dof double")
        long = sum((F.col("z") * k for k in range(2, 40)), F.col("z")) / sum(range(1, 40)) * 1.0
        rows = df.groupBy("z", "dof").agg(F.count("*").alias("n")).select("z", "dof", normal_two_sided(long).alias("p"), student_two_sided(long, F.col("dof")).alias("s")).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    for r in rows:
        if r["z"] is None:
            assert r["p"] is None and r["s"] is None
            continue
        assert abs(r["p"] - math.erfc(abs(r["z"]) / math.sqrt(2))) < 1e-9
        if r["dof"] is None:
            assert r["s"] is None
        elif r["dof"] == 2.0:
            assert abs(r["s"] - (1 - abs(r["z"]) / math.sqrt(2 + r["z"] ** 2))) < 1e-7


def test_no_code_generation_falls_back(spark):
    from thalweg.plans.queries import QUERIES

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("trend_significance_flagship", "bh_fdr", "trend_p_values"):
            assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
