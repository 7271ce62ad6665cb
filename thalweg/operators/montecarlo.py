"""Observation noise through a trained ensemble (F5, F6, A18, Q14), and its correlation over many regions.

Draws are dealt over tasks.  Each task takes its draws through the observation chain and the networks and adds up what they
depart from the unperturbed run, so that what leaves it does not grow with its draws; the states of tasks add up.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import EARTH_RADIUS_KM
from .filters import zero_phase
from .iterate import materialised
from .learning import forward

#: Numbers of an input panel that are broadcast at most.
NUMBERS = 1 << 27
#: Regions that are held against each other in full, and regions in a cube of the later ones, about.
FIRST, IN_CUBE = 4096, 32


class SparseRoot:
    """A root of a covariance of regions: each is a weighted sum of some earlier ones and noise of its own.

    ``neighbours`` (regions x k, padded by the region itself with weight 0), ``weights`` and ``sd``.  Regions are drawn level
    by level: one is a level above the highest of its neighbours.
    """

    def __init__(self, neighbours: np.ndarray, weights: np.ndarray, sd: np.ndarray):
        self.neighbours, self.weights, self.sd = neighbours, weights, sd
        level = np.zeros(len(sd), int)
        for i in range(len(sd)):
            own = neighbours[i][neighbours[i] < i]
            level[i] = level[own].max() + 1 if len(own) else 0
        order = np.argsort(level, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(level[order])) + 1)

    def apply(self, e: np.ndarray) -> np.ndarray:
        """Correlated numbers (regions on the first axis) from independent ones."""
        z = np.zeros_like(e)
        for own in self.levels:
            z[own] = self.sd[own].reshape(-1, *[1] * (e.ndim - 1)) * e[own] + np.einsum("ij,ij...->i...", self.weights[own], z[self.neighbours[own]])
        return z


def _on_sphere(batches):
    for batch in batches:
        lat, lon = ([math.radians(v) for v in batch.column(c).to_pylist()] for c in (1, 2))
        x = [math.cos(a) * math.cos(o) for a, o in zip(lat, lon, strict=True)]
        y = [math.cos(a) * math.sin(o) for a, o in zip(lat, lon, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (x, y, [math.sin(a) for a in lat]))], ["i", "x", "y", "z"])


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and places (three rows) of an array of structs, by number."""
    i, *places = (f.to_numpy(zero_copy_only=False) for f in column.flatten())
    order = np.argsort(i, kind="stable")
    return i[order], np.stack(places)[:, order]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[0][..., :, None] * b[0][..., None, :] + a[1][..., :, None] * b[1][..., None, :] + a[2][..., :, None] * b[2][..., None, :]


def _nearest(dots: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest in each row, the first of equal ones first."""
    if k > 16:
        return np.argsort(-dots, axis=1, kind="stable")[:, :k]
    out, rows = np.zeros((len(dots), k), int), np.arange(len(dots))
    for n in range(k):
        out[:, n] = dots.argmax(axis=1)
        dots[rows, out[:, n]] = -np.inf
    return out


def neighbour_weights(centres: DataFrame, length_km: float, k: int, region: str = "region", jitter: float = 1e-8) -> DataFrame:
    """(region, neighbours, weights, sd) of an exponential covariance, each region given its k nearest earlier ones.

    ``centres``: region (0, 1, ... without a hole), lat, lon.  The first FIRST regions are a generation, and each later one
    goes as far again as all before it.  A generation's regions meet those of no later one in cubes about as wide as these
    lie apart, with the cubes around; a region whose k-th may lie farther is tried again with cubes twice as wide.  Tasks
    solve k x k systems; no table or matrix of regions x regions is made anywhere.  Of regions at one place only the first
    k can be neighbours.  With k as large as the number of regions this is the Cholesky root.
    """
    told = centres.agg(F.count(F.lit(1)).alias("n"), F.min(region).alias("lo"), F.max(region).alias("hi"), F.count_distinct(region).alias("d")).first()
    n = told["n"]
    if n and (told["lo"], told["hi"], told["d"]) != (0, n - 1, n):
        raise ValueError("regions have to be numbered from 0")
    last = (max(n - 1, 0) // FIRST).bit_length()
    age = F.floor(F.col("i") / FIRST).cast("long")
    unit = centres.select(F.col(region).cast("long"), F.col("lat").cast("double"), F.col("lon").cast("double")).mapInArrow(_on_sphere, "i long, x double, y double, z double")
    unit = materialised(unit.withColumn("g", F.when(age < 1, 0).otherwise(F.length(F.bin(age)))), "centres")
    copy = F.row_number().over(W.partitionBy("x", "y", "z").orderBy("i"))
    firsts = materialised(unit.withColumn("copy", copy).where(F.col("copy") <= k).drop("copy"), "firsts")
    cov = lambda dots: np.exp(-EARTH_RADIUS_KM * np.arccos(np.clip(dots, -1.0, 1.0)) / length_km)

    def weights_of(dots, own):
        """Weights and standard deviations from the neighbours' dots (m x k) and places (3 x m x k)."""
        c, gram = cov(dots), cov(_dots(own, own))
        gram[:, np.arange(gram.shape[1]), np.arange(gram.shape[1])] = 1.0 + jitter
        w = np.linalg.solve(gram, c[..., None])[..., 0]
        return w, np.sqrt(np.maximum(1.0 + jitter - (c * w).sum(axis=1), 0.0))

    def solve(batches, widths):
        for batch in batches:
            for r in range(batch.num_rows):
                width = widths[batch.column("g")[r].as_py()]
                (i, at), (j, known) = _points(batch.column("asked")[r].values), _points(batch.column("known")[r].values)
                step = max(1, (1 << 20) // max(1, len(j)))
                for a in range(0, len(i), step):
                    own, here = i[a : a + step], at[:, a : a + step]
                    dots = _dots(here, known)
                    dots[j[None, :] >= own[:, None]] = -np.inf
                    take = min(k, len(j))
                    count = np.minimum(np.isfinite(dots).sum(axis=1), k)
                    near = _nearest(dots.copy(), min(k, len(j)))
                    sure, out, w, sd = np.full(len(own), width >= 2.0), [None] * len(own), [None] * len(own), np.zeros(len(own))
                    for m in np.unique(count).tolist():
                        rows = np.flatnonzero(count == m)
                        places = np.sort(near[rows, :m], axis=1)
                        best = np.take_along_axis(dots[rows], places, axis=1)
                        if m == k:
                            sure[rows] |= (best >= 1.0 - width * width / 2.0 + 1e-12).all(axis=1)
                        w_m, sd[rows] = weights_of(best, known[:, places])
                        for row, x, y in zip(rows.tolist(), j[places].tolist(), w_m.tolist(), strict=True):
                            out[row], w[row] = x, y
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own), pa.array(out, pa.list_(pa.int64())), pa.array(w, pa.list_(pa.float64())), pa.array(sd), pa.array(sure)], ["i", "neighbours", "weights", "sd", "sure"]
                    )

    rest, found, widen, point = unit, None, 1.0, F.struct("i", "x", "y", "z")
    while True:
        widths = [4.0] + [min(4.0, widen * math.sqrt(4.0 * math.pi * max(IN_CUBE, 4 * k) / (FIRST << g))) for g in range(1, last + 1)]
        cube = F.array(*[F.floor(F.col(c) / F.element_at(F.array(*map(F.lit, widths)), F.col("g") + 1)).cast("int") for c in "xyz"])
        asked = materialised(rest.groupBy("g", cube.alias("own")).agg(F.collect_list(point).alias("asked")), "asked")
        steps = F.array(*[F.array(*map(F.lit, d)) for d in itertools.product((-1, 0, 1), repeat=3)])
        around = asked.select("g", "own", F.explode(F.transform(steps, lambda d: F.zip_with("own", d, lambda x, y: x + y))).alias("cube"))
        known = firsts.withColumn("g", F.explode(F.sequence("g", F.lit(last)))).groupBy("g", cube.alias("cube")).agg(F.collect_list(point).alias("known"))
        halo = around.join(known, ["g", "cube"]).groupBy("g", "own").agg(F.flatten(F.collect_list("known")).alias("known"))
        rows = _dealt(halo.join(asked, ["g", "own"]).select("g", "asked", "known"))
        done = materialised(rows.mapInArrow(lambda b, w=widths: solve(b, w), "i long, neighbours array<bigint>, weights array<double>, sd double, sure boolean"), "weights")
        sure = done.where("sure").drop("sure")
        found = sure if found is None else found.unionByName(sure)
        left = done.where("NOT sure").select("i")
        if left.isEmpty():
            return found.withColumnRenamed("i", region).withColumn(region, F.col(region).cast(centres.schema[region].dataType))
        rest, widen = materialised(unit.join(left, "i"), "rest"), 2.0 * widen


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def sparse_root(weights: DataFrame, region: str = "region") -> SparseRoot:
    """The root of neighbour_weights: k numbers a region reach the driver."""
    rows = weights.orderBy(region).toArrow()
    sd = rows["sd"].to_numpy().astype(float)
    near, w = rows["neighbours"].to_pylist(), rows["weights"].to_pylist()
    k = max(1, max(map(len, near), default=0))
    neighbours, full = np.repeat(np.arange(len(sd))[:, None], k, axis=1), np.zeros((len(sd), k))
    for i, (own, x) in enumerate(zip(near, w, strict=True)):
        neighbours[i, : len(own)], full[i, : len(own)] = own, x
    return SparseRoot(neighbours, full, sd)


def seeded_noise(sigma: np.ndarray, mode: str = "independent", root: SparseRoot | None = None, seed: int = 0) -> Callable[[int], np.ndarray]:
    """a draw's noise (samples x regions) of standard deviation ``sigma``; each draw has a stream of its own."""
    if mode not in ("independent", "coherent", "correlated") or (mode == "correlated" and root is None):
        raise ValueError(mode)

    def draw(number: int) -> np.ndarray:
        rng = np.random.default_rng([seed, number])
        if mode == "coherent":
            return rng.standard_normal((len(sigma), 1)) * sigma
        z = rng.standard_normal(sigma.shape)
        return (root.apply(z.T).T if mode == "correlated" else z) * sigma

    return draw


def observation_operator(samples: Sequence[float], months: Sequence[float], baseline: tuple[float, float], cutoff: float = 1 / 24, order: int = 5, pad: int = 24) -> np.ndarray:
    """F6 in time as months x samples: interpolation to the months, the baseline's mean taken off, the low-pass.

    The mean over regions, which is taken off each month, is the chain's only other step, and goes before or after alike.
    """
    samples, months = np.asarray(samples, float), np.asarray(months, float)
    if months.min() < samples.min() or months.max() > samples.max():
        raise ValueError("months have to lie between the samples")
    at = np.clip(np.searchsorted(samples, months, "right") - 1, 0, max(0, len(samples) - 2))
    share = (months - samples[at]) / (samples[at + 1] - samples[at]) if len(samples) > 1 else np.zeros(len(months))
    out = np.zeros((len(months), len(samples)))
    np.add.at(out, (np.arange(len(months)), at), 1.0 - share)
    if len(samples) > 1:
        np.add.at(out, (np.arange(len(months)), at + 1), share)
    based = (months >= baseline[0]) & (months <= baseline[1])
    return zero_phase(out - out[based].mean(axis=0), order, cutoff, pad)


def ensemble_response(nets: Sequence[tuple], kind: str = "swish") -> Callable[[np.ndarray], np.ndarray]:
    """The mean of the members' outputs for rows of inputs."""
    return lambda x: np.mean([forward(x, net, kind)[0] for net in nets], axis=0)


def monte_carlo(spark: SparkSession, base: np.ndarray, respond: Callable[[np.ndarray], np.ndarray], noise: Callable[[int], np.ndarray], chain: np.ndarray, first: int, draws: int, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Noise through the chain and the networks: (moments, trends).

    ``base`` (months x features) is the unperturbed input; a draw's noise, after the chain, is added to the features from
    ``first`` on.  moments: (cell, month, n, s1, s2), sums over draws of the departures from the base run and of their
    squares; trends: (draw, cell, trend), slopes a month of each draw's run.
    """
    if base.size > NUMBERS:
        raise ValueError(f"over {NUMBERS} inputs")
    t = np.arange(len(base)) - (len(base) - 1) / 2.0
    shared = spark.sparkContext.broadcast((base, respond(base), chain, t / (t @ t)))
    schema = "draw long, cell long, n long, s1 array<double>, s2 array<double>, trend double"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
    names = ["draw", "cell", "n", "s1", "s2", "trend"]

    def run(batches):
        base, calm, chain, slope = shared.value
        cells = calm.shape[1]
        s1, s2, n = np.zeros_like(calm), np.zeros_like(calm), 0
        for batch in batches:
            for draw in batch.column(0).to_pylist():
                own = chain @ noise(draw)
                own -= own.mean(axis=1, keepdims=True)
                x = base.copy()
                x[:, first : first + own.shape[1]] += own
                away = respond(x) - calm
                s1, s2, n = s1 + away, s2 + away * away, n + 1
                trend = slope @ (calm + away)
                yield pa.RecordBatch.from_arrays([pa.array([draw] * cells, kinds[0]), pa.array(np.arange(cells)), *[pa.nulls(cells, k) for k in kinds[2:5]], pa.array(trend)], names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(cells, kinds[0]), pa.array(np.arange(cells)), pa.array([n] * cells, kinds[2]), pa.array(list(s1.T), kinds[3]), pa.array(list(s2.T), kinds[4]), pa.nulls(cells, kinds[5])], names)

    found = materialised(spark.range(0, draws, 1, parts or min(draws, spark.sparkContext.defaultParallelism)).mapInArrow(run, schema), "draws")
    states = found.where("draw IS NULL").select("cell", "n", F.posexplode(F.arrays_zip("s1", "s2")).alias("month", "s"))
    moments = states.groupBy("cell", "month").agg(F.sum("n").alias("n"), F.sum("s.s1").alias("s1"), F.sum("s.s2").alias("s2"))
    return moments, found.where("draw IS NOT NULL").select("draw", "cell", "trend")


def noise_budget(moments: DataFrame, trends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q14: (cell, month, bias, sigma) and (cell, sigma_month, sigma_trend, bias, n): variances by n - 1, RMS over months."""
    bias = F.col("s1") / F.col("n")
    var = F.greatest(F.col("s2") - F.col("n") * bias * bias, F.lit(0.0)) / (F.col("n") - 1)
    monthly = moments.select("cell", "month", bias.alias("bias"), F.sqrt(var).alias("sigma"), "n")
    cells = monthly.groupBy("cell").agg(F.sqrt(F.avg(F.col("sigma") * F.col("sigma"))).alias("sigma_month"), F.avg(F.abs("bias")).alias("bias"), F.max("n").alias("n"))
    return monthly.drop("n"), cells.join(trends.groupBy("cell").agg(F.stddev_samp("trend").alias("sigma_trend")), "cell")
