"""Wide components and training on batches with dropout, against plain matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import learning as M


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample int, x array<double>").repartition(parts)


def rows_of(parts):
    told = parts.toPandas().pivot(index="component", columns="feature", values="weight").to_numpy()
    return told, parts.where("feature = 0").orderBy("component").toPandas()


def test_wide_components_span_the_exact_ones(spark):
    assert M.FEW_FEATURES < 900
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 7)) @ (rng.normal(size=(7, 900)) * np.geomspace(30, 0.5, 7)[:, None]) + 0.05 * rng.normal(size=(60, 900)) + 100.0
    away = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(away, full_matrices=False)
    for parts in (1, 4):
        got, told = rows_of(M.fit_wide_components(frame(spark, x, parts), 5))
        assert got.shape == (5, 900) and np.allclose(told["variance"], s[:5] ** 2 / 59, rtol=1e-9)
        angles = np.linalg.svd(got @ v[:5].T)[1]
        assert np.abs(angles - 1).max() < 1e-9 and np.abs(got @ (np.eye(900) - v[:5].T @ v[:5])).max() < 1e-6
        assert np.allclose(told["total"], (away**2).sum() / 59) and np.allclose(told["mean"], x.mean(axis=0)[0])


@pytest.mark.parametrize("few", [256, 0])
def test_share_of_variance_and_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(M, "FEW_FEATURES", few)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 30)) @ np.diag(np.linspace(1, 3, 30))
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    for share in (0.1, 0.5, 0.9, 0.99):
        _, told = rows_of(M.fit_wide_components(frame(spark, x), share=share))
        assert len(told) == int(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1)
        assert np.allclose(told["variance"], values[: len(told)], rtol=1e-8)
    blocks = M.fit_block_components(frame(spark, x), [(0, 10), (10, 30)], k=3)
    for b, (lo, hi) in enumerate([(0, 10), (10, 30)]):
        own = blocks.where(F.col("block") == b)
        assert np.allclose(own.where("feature = 0").orderBy("component").toPandas()["variance"], np.linalg.eigvalsh(np.cov(x[:, lo:hi].T))[::-1][:3], rtol=1e-8)
    few = M.fit_wide_components(frame(spark, x[:4]), 10)
    assert few.where("feature = 0").count() == 3
    with pytest.raises(ValueError, match="either"):
        M.fit_wide_components(frame(spark, x), 3, 0.5)


def test_sixteen_thousand_features(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 16_000))
    x = rng.normal(size=(24, 4)) * np.array([9.0, 6.0, 4.0, 2.0]) @ base + 0.01 * rng.normal(size=(24, 16_000))
    got, _ = rows_of(M.fit_wide_components(frame(spark, x, 2), 4))
    v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:4]
    assert np.abs(np.linalg.svd(got @ v.T)[1] - 1).max() < 1e-9


def numpy_training(x, y, fold, keys, folds, members, sizes, seed, epochs, patience, rate, l2, batch, dropout):
    """The same steps in one process."""
    shapes, out = M.network_shapes(x.shape[1], y.shape[1], sizes), []
    held = np.bincount(fold, minlength=folds)
    batches = max(1, -(-max(len(x) - held[f] for f in range(folds)) // batch))
    for i, (f, m) in enumerate((f, m) for f in range(folds) for m in range(members)):
        rng = np.random.default_rng(seed + f * members + m)
        flat = np.concatenate([(rng.uniform(-1, 1, s) * math.sqrt(6.0 / sum(s)) if len(s) == 2 else np.zeros(s)).ravel() for s in shapes])
        decay = np.concatenate([np.full(math.prod(s), float(len(s) == 2 and k != len(sizes))) for k, s in enumerate(shapes)])
        first, second, best, best_loss, waited, step = np.zeros_like(flat), np.zeros_like(flat), flat, np.inf, 0, 0
        for epoch in range(1, epochs + 1):
            deal = M.batch_of(keys, seed, epoch, batches)
            for b in range(batches):
                if waited >= patience:
                    break
                net, own = M.unpacked(flat, shapes), (deal == b) & (fold != f)
                if b == 0:
                    loss = ((M.forward(x[fold == f], net, "swish")[0] - y[fold == f]) ** 2).mean()
                    best, best_loss, waited = (flat.copy(), loss, 0) if loss < best_loss else (best, best_loss, waited + 1)
                step += 1
                masks = M.dropout_masks(keys[own], dropout, sizes, seed, i, epoch, b)
                g = 2 * M.gradient_sums(x[own], y[own], net, "swish", masks) / (y.shape[1] * max(1, own.sum())) + 2 * l2 * decay * flat
                first, second = first + 0.1 * (g - first), second + 0.001 * (g * g - second)
                flat = flat - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-7)
        out.append((best_loss, best))
    return out


def test_batches_and_dropout_equal_one_process(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 4))
    y = np.tanh(x @ rng.normal(size=(4, 2))) + 0.1 * rng.normal(size=(150, 2))
    fold = np.arange(150) % 3
    df = spark.createDataFrame([(i, int(fold[i]), [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(150)], "sample int, fold int, x array<double>, y array<double>")
    how = dict(seed=3, epochs=5, patience=2, rate=0.02, l2=1e-3, batch=32, dropout=0.25)
    keys = np.array([r[0] for r in df.select(F.xxhash64("sample")).collect()])
    want = numpy_training(x, y, fold, keys, 3, 2, (6, 5), **how)
    for parts in (1, 5):
        got = M.train_ensemble(df.repartition(parts), 3, 2, (6, 5), **how).orderBy("fold", "member").collect()
        assert np.allclose([r["loss"] for r in got], [w[0] for w in want], atol=1e-8)
        assert np.allclose([r["weights"] for r in got], [w[1] for w in want], atol=1e-8)


def test_masks_and_batches():
    keys = np.arange(20_000)
    hidden, passed = M.dropout_masks(keys, 0.2, (8, 4), 1, 0, 3, 1)
    assert hidden[0].shape == (20_000, 8) and passed.shape == (20_000, 8) and set(np.unique(hidden[1])) == {0.0, 1.25}
    assert all(np.abs(m.mean(axis=0) - 1).max() < 0.02 for m in (*hidden, passed)) and abs(np.corrcoef(hidden[0].T) - np.eye(8)).max() < 0.03
    assert M.dropout_masks(keys, 0.0, (8, 4), 1, 0, 3, 1) is None
    assert np.abs(np.bincount(M.batch_of(keys, 1, 2, 7)) / 20_000 - 1 / 7).max() < 0.01 and (M.batch_of(keys, 1, 2, 7) != M.batch_of(keys, 1, 3, 7)).mean() > 0.8


def test_gradients_with_masks_are_right():
    rng = np.random.default_rng(7)
    x, y, shapes = rng.normal(size=(5, 3)), rng.normal(size=(5, 2)), M.network_shapes(3, 2, (4, 3))
    flat, masks = rng.normal(size=sum(math.prod(s) for s in shapes)), ([rng.integers(0, 2, (5, 4)) / 0.8, rng.integers(0, 2, (5, 3)) / 0.8], rng.integers(0, 2, (5, 4)) / 0.8)

    def loss(p):
        (w1, w2, w3), (b1, b2, b3), skip = M.unpacked(p, shapes)
        z1 = x @ w1 + b1
        h1 = M.activate(z1, "swish")[0] * masks[0][0]
        h2 = M.activate(h1 @ w2 + b2, "swish")[0] * masks[0][1]
        return ((h2 @ w3 + b3 + (z1 * masks[1]) @ skip - y) ** 2).sum() / 2

    numeric = [(loss(flat + e) - loss(flat - e)) / 2e-6 for e in np.eye(len(flat)) * 1e-6]
    assert np.allclose(M.gradient_sums(x, y, M.unpacked(flat, shapes), "swish", masks), numeric, atol=1e-6)


def test_networks_learn_the_truth(spark):
    """Held-out members: the ensemble's error is far below the truth's own variance, and so is each network's loss."""
    from thalweg.plans import queries as Q

    d = "/root/testdata/sf0.01"
    truth = {r["sample"]: r["y"] for r in Q._paired(spark, d).collect()}
    told = Q.ensemble_training(spark, d).collect()
    assert len(told) == 7 * len(truth)
    error = np.mean([(r["value"] - truth[r["sample"]][r["out"]]) ** 2 for r in told])
    assert error < 0.4 * np.var(list(truth.values()))
    losses = Q.QUERIES["stage_train"](spark, d).collect()
    assert sorted((r["fold"], r["member"]) for r in losses) == [(0, 0), (0, 1), (1, 0), (1, 1)] and max(r["loss"] for r in losses) < 0.8
