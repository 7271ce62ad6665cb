"""Scaling, components, folds, small networks and their predictions (M*)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import percentiles
from .iterate import global_rank, materialised

Keys = Sequence[str]


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """M1: a fold for each group: by falling size, each to the lightest fold (ties: the largest group key, the first fold).

    Each step needs the one before, so the sizes, a row for each group, stream through one task that holds k loads.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__n")).repartition(1).sortWithinPartitions(F.col("__n").desc(), F.col(group).desc())

    def deal(batches):
        loads = [(0, fold) for fold in range(k)]
        for batch in batches:
            folds = []
            for n in batch.column("__n").to_pylist():
                load, fold = loads[0]
                heapq.heapreplace(loads, (load + n, fold))
                folds.append(fold)
            yield pa.RecordBatch.from_arrays([batch.column(group), pa.array(folds, pa.int32())], [group, "fold"])

    return sizes.mapInArrow(deal, f"`{group}` {df.schema[group].dataType.simpleString()}, fold int")


def member_seeds(df: DataFrame, fold: str, member: str, base: int, members: int) -> DataFrame:
    """M2: base + (fold - 1) * members + member - 1."""
    return df.withColumn("seed", F.lit(base) + (F.col(fold) - 1) * members + F.col(member) - 1)


def fit_scaler(df: DataFrame, feature: str, value: str = "value", kind: str = "standard") -> DataFrame:
    """M3: (feature, centre, scale) of rows of the training fold; a scale of zero becomes one."""
    if kind == "standard":
        centre, scale = F.avg(value), F.stddev_pop(value)
    elif kind == "minmax":
        centre, scale = F.min(value), F.max(value) - F.min(value)
    elif kind == "robust":
        # Percentiles by ranges: no task holds a feature's values.
        quarters = percentiles(df, [feature], [0.25, 0.75], value)
        out = quarters.select(feature, F.col("median").alias("centre"), (F.col("p75") - F.col("p25")).alias("scale"))
        return out.withColumn("scale", F.when(F.col("scale") == 0.0, 1.0).otherwise(F.col("scale")))
    else:
        raise ValueError(kind)
    out = df.groupBy(feature).agg(centre.alias("centre"), scale.alias("scale"))
    return out.withColumn("scale", F.when(F.col("scale") == 0.0, 1.0).otherwise(F.col("scale")))


def apply_scaler(df: DataFrame, scaler: DataFrame, feature: str, value: str = "value", inverse: bool = False) -> DataFrame:
    v = F.col(value)
    new = v * F.col("scale") + F.col("centre") if inverse else (v - F.col("centre")) / F.col("scale")
    return df.join(scaler, feature).withColumn(value, new).drop("centre", "scale")


def fit_components(df: DataFrame, sample: str, k: int, x: str = "x") -> DataFrame:
    """M4: (component, feature, weight, mean, variance) of the k leading components of arrays; the largest weight is positive.

    Moments are added up in tasks; features x features numbers reach the driver, and no row moves.
    """
    n = df.select(F.size(x).alias("n")).first()["n"]

    def moments(batches):
        total = np.zeros((n + 1, n + 1))
        for batch in batches:
            rows = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, n)
            rows = np.column_stack([np.ones(len(rows)), rows])
            total += rows.T @ rows
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "s"])

    sums = df.select(x).mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros((n + 1, n + 1))
    total[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["s"].to_numpy()
    count, mean = total[0, 0], total[0, 1:] / max(1.0, total[0, 0])
    values, vectors = np.linalg.eigh((total[1:, 1:] - count * np.outer(mean, mean)) / max(1.0, count - 1))
    order = np.argsort(values)[::-1][:k]
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(axis=0), order])
    rows = [(c, f, float(vectors[f, c]), float(mean[f]), float(values[order[c]])) for c in range(len(order)) for f in range(n)]
    return df.sparkSession.createDataFrame(rows, "component int, feature int, weight double, mean double, variance double")


#: Columns that a randomized fit begins with beyond the components asked for; up to how many features the block takes them
#: all, so that one round is exact; and numbers that the driver holds at most.
OVERSAMPLE, FEW_FEATURES, DRIVER_NUMBERS = 10, 256, 1 << 27


def _feature_sums(df: DataFrame, x: str, n: int, width: int, product: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, int, float]:
    """Sums over all rows of ``product`` (features x width) of a batch, the number of rows and the sum of squares.

    Each task adds up its batches; what it gives is added by feature before and after the shuffle.
    """
    names = [f"s{k}" for k in range(width)]

    def sums(batches):
        total, count, squares = np.zeros((n, width)), 0, 0.0
        for batch in batches:
            rows = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, n)
            part, more = product(rows)
            total, count, squares = total + part, count + len(rows), squares + more
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n)), pa.array(np.full(n + 1, count)), *[pa.array(np.concatenate([[squares], c])) for c in total.T]], ["i", "n", *names])

    found = df.select(x).mapInArrow(sums, "i long, n long, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
    at = found["i"].to_numpy()
    out = np.zeros((n + 1, width))
    for k, c in enumerate(names):
        out[at + 1, k] = found[c].to_numpy()
    return out[1:], int(found["n"].to_numpy().max(initial=0)), float(out[0, 0])


def fit_wide_components(df: DataFrame, k: int | None = None, share: float | None = None, x: str = "x", seed: int = 0, tolerance: float = 1e-9, rounds: int = 300) -> DataFrame:
    """M4 for wide rows: the ``k`` leading components, or as many as hold a ``share`` of the variance; columns as fit_components.

    Block power iteration from a seeded start: in each round tasks multiply their rows with a thin matrix and back, features x
    (k + OVERSAMPLE) numbers reach the driver and are made orthogonal there; no features x features matrix exists.  It ends
    when every component asked for is an eigenvector to ``tolerance`` (its residual by its variance), and fails after ``rounds``.
    """
    if (k is None) == (share is None):
        raise ValueError("either a number of components or a share of variance")
    n = df.select(F.size(x).alias("n")).first()["n"]
    sums, count, _ = _feature_sums(df, x, n, 1, lambda rows: (rows.sum(axis=0)[:, None], 0.0))
    mean, most = sums[:, 0] / max(1, count), min(n, max(1, count - 1))
    width, rng, basis = n if n <= FEW_FEATURES else min(most, (k or 8) + OVERSAMPLE), np.random.default_rng(seed), None
    most = max(most, width)
    for _ in range(rounds):
        if n * width > DRIVER_NUMBERS:
            raise ValueError(f"over {DRIVER_NUMBERS} numbers for the driver")
        if basis is None or basis.shape[1] < width:
            fresh = rng.standard_normal((n, width - (0 if basis is None else basis.shape[1])))
            basis = np.linalg.qr(fresh if basis is None else np.concatenate([basis, fresh], axis=1))[0]
        shared = df.sparkSession.sparkContext.broadcast((mean, basis))

        def product(rows, shared=shared):
            mean, basis = shared.value
            away = rows - mean
            return away.T @ (away @ basis), float((away * away).sum())

        image, _, squares = _feature_sums(df, x, n, width, product)
        shared.unpersist()
        image, total = image / max(1, count - 1), squares / max(1, count - 1)
        values, turn = np.linalg.eigh(basis.T @ image)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn, image @ turn
        wanted = k or int(np.searchsorted(np.cumsum(values) / (total or 1.0), share) + 1)
        if wanted > width - min(OVERSAMPLE, most - 1) and width < most:
            width = min(most, 2 * width)  # the share asks for more than the block holds
        else:
            wanted = min(wanted, width, n, max(1, count - 1))
            off = np.linalg.norm(images[:, :wanted] - vectors[:, :wanted] * values[:wanted], axis=0)
            if width >= most or (off <= tolerance * np.maximum(values[:wanted], 1e-300) + 1e-14 * values[0]).all():
                break
        basis = np.linalg.qr(images)[0]
    else:
        raise ValueError(f"components do not settle in {rounds} rounds")
    vectors, values = vectors[:, :wanted], values[:wanted]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    told = pa.table({
        "component": np.repeat(np.arange(wanted, dtype=np.int32), n), "feature": np.tile(np.arange(n, dtype=np.int32), wanted), "weight": vectors.T.ravel(), "mean": np.tile(mean, wanted), "variance": np.repeat(values, n),
        "total": np.full(n * wanted, total),
    })
    return df.sparkSession.createDataFrame(told)


def fit_block_components(df: DataFrame, blocks: Sequence[tuple[int, int]], k: int | None = None, share: float | None = None, x: str = "x", base_seed: int = 0, fold: int = 0) -> DataFrame:
    """M2, M4: components of each block of features by itself, with a seed of its own: adds ``block``; features count from its start."""
    parts = [fit_wide_components(df.select(F.slice(x, lo + 1, hi - lo).alias("x")), k, share, "x", pca_seed(base_seed, "x", fold, b)).withColumn("block", F.lit(b)) for b, (lo, hi) in enumerate(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def project(df: DataFrame, components: DataFrame, sample: str, x: str = "x") -> DataFrame:
    """(sample, score): an array of scores, one for each component: sums of (value - mean) * weight inside the row."""
    packed = components.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("feature", "weight", "mean"))).alias("f"))
    packed = packed.agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "f"))), lambda c: c["f"]).alias("__c"))  # settings-sized
    score = F.transform("__c", lambda f: F.aggregate(F.zip_with(x, f, lambda v, w: (v - w["mean"]) * w["weight"]), F.lit(0.0), lambda a, v: a + v))
    return df.crossJoin(F.broadcast(packed)).select(sample, score.alias("score"))


def unproject(scores: DataFrame, components: DataFrame, sample: str, feature: str) -> DataFrame:
    return scores.join(components, "component").groupBy(sample, feature).agg((F.sum(F.col("score") * F.col("weight")) + F.max("mean")).alias("value"))


def activation(x: Column, kind: str, slope: float = 0.2) -> Column:
    """M8 as a column."""
    sigmoid = F.when(x >= 0, 1.0 / (1.0 + F.exp(-F.abs(x)))).otherwise(F.exp(-F.abs(x)) / (1.0 + F.exp(-F.abs(x))))
    if kind == "gelu":
        t = 1.0 / (1.0 + 0.3275911 * F.abs(x) / math.sqrt(2.0))
        tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x / 2.0)
        return x * (1.0 + F.signum(x) * (1.0 - tail)) / 2.0
    return {
        "linear": x, "relu": F.greatest(x, F.lit(0.0)), "sigmoid": sigmoid, "tanh": F.tanh(x), "elu": F.when(x > 0, x).otherwise(F.exp(F.least(x, F.lit(0.0))) - 1.0),
        "swish": x * sigmoid, "leaky_relu": F.when(x > 0, x).otherwise(slope * x), "prelu": F.when(x > 0, x).otherwise(slope * x),
    }[kind]


def activation_of(kind: str) -> Callable[[Column], Column]:
    """The activation as a function of one column, for use inside arrays."""

    def f(x: Column) -> Column:
        return activation(x, kind)

    return f


def dense_layer(df: DataFrame, weights: DataFrame, bias: DataFrame, sample: str, kind: str = "relu") -> DataFrame:
    """M7 for one layer on arrays: (sample, x, z, value) from (sample, x), (unit, out, w) and (out, b), all inside the row."""
    columns = weights.groupBy("out").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "w"))), lambda u: u["w"]).alias("w")).join(bias, "out")
    packed = columns.agg(F.array_sort(F.collect_list(F.struct("out", "w", "b"))).alias("__l"))  # settings-sized
    z = F.transform("__l", lambda o: F.aggregate(F.zip_with("x", o["w"], lambda v, w: v * w), o["b"], lambda a, v: a + v))
    out = df.crossJoin(F.broadcast(packed)).select(sample, "x", z.alias("z"))
    return out.withColumn("value", F.transform("z", activation_of(kind)))


def activate(z: np.ndarray, kind: str, slope: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Values and slopes of an activation (M8) on arrays."""
    if kind == "linear":
        return z, np.ones_like(z)
    if kind in ("relu", "leaky_relu", "prelu"):
        low = 0.0 if kind == "relu" else slope
        return np.where(z > 0, z, low * z), np.where(z > 0, 1.0, low)
    if kind == "tanh":
        return np.tanh(z), 1.0 - np.tanh(z) ** 2
    if kind == "elu":
        low = np.exp(np.minimum(z, 0.0))
        return np.where(z > 0, z, low - 1.0), np.where(z > 0, 1.0, low)
    if kind not in ("sigmoid", "swish"):
        raise ValueError(kind)
    small = np.exp(-np.abs(z))
    s = np.where(z >= 0, 1.0, small) / (1.0 + small)
    return (s, s * (1.0 - s)) if kind == "sigmoid" else (z * s, s + z * s * (1.0 - s))


def network_shapes(n_in: int, n_out: int, sizes: Sequence[int]) -> list[tuple[int, ...]]:
    """M5: weights of each layer, biases of each layer, and the linear skip from the first pre-activation to the output."""
    widths = [n_in, *sizes, n_out]
    return [*zip(widths[:-1], widths[1:], strict=True), *[(w,) for w in widths[1:]], (sizes[0], n_out)]


def unpacked(flat: np.ndarray, shapes: Sequence[tuple[int, ...]]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(weights, biases, skip) of a network from its flat parameters."""
    ends = np.cumsum([math.prod(s) for s in shapes])
    parts = [flat[e - math.prod(s) : e].reshape(s) for e, s in zip(ends, shapes, strict=True)]
    k = len(shapes) // 2
    return parts[:k], parts[k : 2 * k], parts[-1]


def forward(x: np.ndarray, net: tuple, kind: str) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Output, pre-activations and inputs of each layer of a dense stack, a row each."""
    ws, bs, skip = net
    zs, hs = [], [x]
    for w, b in zip(ws, bs, strict=True):
        zs.append(hs[-1] @ w + b)
        hs.append(activate(zs[-1], kind)[0])
    return zs[-1] + zs[0] @ skip, zs, hs[:-1]


def gradient_sums(x: np.ndarray, y: np.ndarray, net: tuple, kind: str, masks: tuple | None = None) -> np.ndarray:
    """Sum over rows of the gradients of half the squared error, flat.

    ``masks``: what dropout multiplies, of each hidden layer's values and of the skip's input.
    """
    ws, bs, skip = net
    hidden, passed = masks or ([1.0] * (len(ws) - 1), 1.0)
    zs, hs = [], [x]
    for k, (w, b) in enumerate(zip(ws, bs, strict=True)):
        zs.append(hs[-1] @ w + b)
        if k < len(ws) - 1:
            hs.append(activate(zs[-1], kind)[0] * hidden[k])
    error = zs[-1] + (zs[0] * passed) @ skip - y
    gw, gb, back = [None] * len(ws), [None] * len(ws), error
    for k in range(len(ws) - 1, -1, -1):
        if k < len(ws) - 1:
            back = back * hidden[k] * activate(zs[k], kind)[1]
        if k == 0:
            back = back + (error @ skip.T) * passed
        gw[k], gb[k] = hs[k].T @ back, back.sum(axis=0)
        back = back @ ws[k].T
    return np.concatenate([g.ravel() for g in [*gw, *gb, (zs[0] * passed).T @ error]])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, as splittable random generators use."""
    u = np.uint64
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))


def _stream(keys: np.ndarray, *of: int) -> np.ndarray:
    """Numbers of 64 random bits for each key, and for nothing but the key and ``of``."""
    state = _mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in of:
        state = _mixed(state ^ _mixed(np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return state


def batch_of(keys: np.ndarray, seed: int, epoch: int, batches: int) -> np.ndarray:
    """The batch of each row in an epoch: rows are dealt anew in each, and stay where they are."""
    return (_stream(keys, seed, epoch) % np.uint64(batches)).astype(np.int64)


def dropout_masks(keys: np.ndarray, rate: float, widths: Sequence[int], seed: int, net: int, epoch: int, batch: int) -> tuple | None:
    """Masks for each hidden layer and for the skip's input: 0 for dropped units, 1 / (1 - rate) for the others."""
    if not rate:
        return None

    def mask(layer: int, width: int) -> np.ndarray:
        unit = _mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        bits = _mixed(_stream(keys, seed, net, epoch, batch, layer)[:, None] ^ unit[None, :])
        return ((bits >> np.uint64(11)) * 2.0**-53 >= rate) / (1.0 - rate)

    return [mask(k, w) for k, w in enumerate(widths)], mask(len(widths), widths[0])


#: Parameters of a network that are added up in one task.
PARAMETERS = 1 << 14


def train_ensemble(
    rows: DataFrame, folds: int, members: int, sizes: Sequence[int] = (192, 96, 48), kind: str = "swish", seed: int = 0, epochs: int = 2000, patience: int = 30, rate: float = 1e-3, l2: float = 0.01,
    batch: int | None = None, dropout: float = 0.0, key: str = "sample",
) -> DataFrame:
    """M5, M6: trains folds x members networks side by side: (fold, member, loss, weights), the loss being that of its own fold.

    ``rows`` has fold, x (array), y (array) and, for batches or dropout, a ``key``; it stays where it is.  A step (Adam) takes
    the whole training set, or the rows of a batch of about ``batch`` of them, which a hash of epoch and key deals: in each
    step every partition adds up the gradients of all networks over its rows of the batch, sums are added by network and
    piece of its parameters, and only those (as many numbers as the networks have) reach the driver.  Masks of dropout are a
    hash of network, epoch, batch, key, layer and unit, so that steps are the same at any partitioning and when tasks are
    repeated.  Before each epoch the validation loss is taken; a network stops when it has not fallen for ``patience`` epochs
    and goes back to its best parameters.
    """
    keyed = rows.withColumn("key", F.xxhash64(key) if batch or dropout else F.lit(0).cast("long"))
    rows = materialised(keyed.select("fold", "x", "y", "key"), "training")
    width = rows.select(F.size("x").alias("x"), F.size("y").alias("y")).first()
    shapes = network_shapes(width["x"], width["y"], sizes)
    of = lambda fold, member: np.random.default_rng(seed + fold * members + member)
    glorot = lambda rng, s: rng.uniform(-1, 1, s) * math.sqrt(6.0 / sum(s)) if len(s) == 2 else np.zeros(s)
    nets = [(f, m) for f in range(folds) for m in range(members)]
    flat = np.stack([np.concatenate([glorot(rng, s).ravel() for s in shapes]) for rng in (of(f, m) for f, m in nets)])
    first, second, best = np.zeros_like(flat), np.zeros_like(flat), flat.copy()
    best_loss, waited, context = np.full(len(nets), np.inf), np.zeros(len(nets), int), rows.sparkSession.sparkContext
    # Hidden layers and the skip are held down, the output layer and biases are not.
    decay = np.concatenate([np.full(math.prod(s), float(len(s) == 2 and k != len(sizes))) for k, s in enumerate(shapes)])
    schema = pa.schema([("net", pa.int32()), ("piece", pa.int32()), ("sums", pa.list_(pa.float64()))])
    batches = 1
    if batch:
        held = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}  # a row a fold
        batches = max(1, -(-max(sum(held.values()) - held.get(f, 0) for f in range(folds)) // batch))
    step = 0
    for epoch in range(1, epochs + 1):
        for b in range(batches):
            step += 1
            shared = context.broadcast((flat, [i for i in range(len(nets)) if waited[i] < patience]))

            def partial(record_batches, shared=shared, epoch=epoch, b=b):
                flat, live = shared.value
                total = {i: np.zeros(flat.shape[1] + 4) for i in live}
                for record in record_batches:
                    x, y = (np.array(record.column(c).to_pylist(), float).reshape(record.num_rows, -1) for c in ("x", "y"))
                    fold, keys = record.column("fold").to_numpy(), record.column("key").to_numpy()
                    now = batch_of(keys, seed, epoch, batches) == b if batches > 1 else np.ones(len(keys), bool)
                    for i in live if record.num_rows else ():
                        net, held = unpacked(flat[i], shapes), fold == nets[i][0]
                        own = now & ~held
                        total[i][:-4] += gradient_sums(x[own], y[own], net, kind, dropout_masks(keys[own], dropout, sizes, seed, i, epoch, b))
                        total[i][-4] += own.sum()
                        if b == 0:
                            total[i][-2:] += [held.sum() * y.shape[1], ((forward(x[held], net, kind)[0] - y[held]) ** 2).sum()]
                for i, sums in total.items():
                    pieces = [sums[k : k + PARAMETERS] for k in range(0, len(sums), PARAMETERS)]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.list_(pa.float64()))], schema=schema)

            def added(table):
                whole = np.array(table.column("sums").to_pylist(), float).sum(axis=0)
                return pa.Table.from_arrays([table.column("net")[:1], table.column("piece")[:1], pa.array([whole], pa.list_(pa.float64()))], schema=schema)

            told = rows.mapInArrow(partial, "net int, piece int, sums array<double>").groupBy("net", "piece").applyInArrow(added, "net int, piece int, sums array<double>").toArrow()
            pieces = {(n, p): v for n, p, v in zip(told["net"].to_pylist(), told["piece"].to_pylist(), told["sums"].to_pylist(), strict=True)}
            for i in sorted({n for n, _ in pieces}):
                sums = np.concatenate([pieces[i, p] for p in sorted(p for n, p in pieces if n == i)])
                if b == 0:
                    loss = sums[-1] / max(1.0, sums[-2])
                    if loss < best_loss[i]:
                        best[i], best_loss[i], waited[i] = flat[i], loss, 0
                    else:
                        waited[i] += 1
                grads = 2.0 * sums[:-4] / (width["y"] * max(1.0, sums[-4])) + 2.0 * l2 * decay * flat[i]
                first[i] += 0.1 * (grads - first[i])
                second[i] += 0.001 * (grads * grads - second[i])
                flat[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-7)
            shared.unpersist()
        if (waited >= patience).all():
            break
    made = [(f, m, float(best_loss[i]), best[i].tolist()) for i, (f, m) in enumerate(nets)]
    return rows.sparkSession.createDataFrame(made, "fold int, member int, loss double, weights array<double>")


def predict(rows: DataFrame, nets: Sequence[tuple], key: str, kind: str = "swish", heads: dict | None = None) -> DataFrame:
    """M7: (key, fold, prediction) of folds: the mean of its members' outputs, brought back to physical values.

    ``nets``: (fold, member, (weights, biases, skip)), settings-sized.  ``heads``: for each fold (components, mean,
    scale, centre): components are undone before members are averaged, scales after.
    """
    shared = rows.sparkSession.sparkContext.broadcast((list(nets), heads or {}))

    def run(batches):
        nets, heads = shared.value
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
            for fold in sorted({f for f, _, _ in nets}):
                outs = [forward(x, net, kind)[0] for f, _, net in nets if f == fold] if batch.num_rows else []
                if not outs:
                    continue
                if fold in heads:
                    components, mean, scale, centre = (np.asarray(v, float) for v in heads[fold])
                    value = np.mean([out @ components + mean for out in outs], axis=0) * scale + centre
                else:
                    value = np.mean(outs, axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([fold] * len(x), pa.int32()), pa.array(list(value), pa.list_(pa.float64()))], [key, "fold", "prediction"])

    kind_of = rows.schema[key].dataType.simpleString()
    return rows.select(key, "x").mapInArrow(run, f"`{key}` {kind_of}, fold int, prediction array<double>")


def ensemble_mean(predictions: DataFrame, key: str) -> DataFrame:
    """Mean of the folds by output: (key, out, value)."""
    return predictions.select(key, F.posexplode("prediction").alias("out", "value")).groupBy(key, "out").agg(F.avg("value").alias("value"))


def pca_seed(base: int, kind: str, fold: int, block: int = 0) -> int:
    """M2: the seed of one component fit, apart for inputs (``x``) and targets (``y``), folds and blocks."""
    return int(np.random.SeedSequence([base, {"x": 1, "y": 2}[kind], fold, block]).generate_state(1, dtype=np.uint32)[0])


def shuffle_split(df: DataFrame, group: str, share: float = 1 / 3, seed: int = 0) -> DataFrame:
    """M1 with one fold: (group, held): a seeded third of the groups (of the rows' keys, where they are groups) is held out.

    The groups with the smallest seeded hashes are held: as many as the share, rounded up.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    n = sizes.count()
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"))).asc(), F.col(group).asc()]
    return global_rank(sizes, order, "__k").select(group, (F.col("__k") < math.ceil(n * share)).alias("held"))
