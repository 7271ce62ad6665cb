"""Zero-phase low-pass filters (F1, F2) and observation noise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import anomaly, demean
from .iterate import materialised
from .windows import interpolate

if TYPE_CHECKING:
    from .montecarlo import SparseRoot

Keys = Sequence[str]


def butterworth(order: int, cutoff: float, rate: float = 1.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections (numerator, denominator) of a digital Butterworth low-pass: conjugate poles in pairs, a real one alone.

    By the bilinear transform.  Every section has a gain of one at rest, which keeps high orders at low cutoffs exact.
    """
    warped = 4.0 * np.tan(np.pi * cutoff / rate)
    k = np.arange(1, order // 2 + 1)
    upper = warped * np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    denominators = [np.array([1.0, -2.0 * z.real, abs(z) ** 2]) for z in (4.0 + upper) / (4.0 - upper)]
    if order % 2:
        denominators.append(np.array([1.0, -(4.0 - warped) / (4.0 + warped)]))
    return [(np.array([1.0, 2.0, 1.0] if len(a) == 3 else [1.0, 1.0]) * a.sum() / 2.0 ** (len(a) - 1), a) for a in denominators]


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A section along axis 0 of all columns, from the state of rest at the first sample."""
    out, n = np.empty_like(x), len(a) - 1
    first = x[:1]
    state = [(b[k + 1 :].sum() - a[k + 1 :].sum()) * first[0] for k in range(n)]
    for i, row in enumerate(x):
        y = b[0] * row + state[0]
        for k in range(n - 1):
            state[k] = b[k + 1] * row + state[k + 1] - a[k + 1] * y
        state[n - 1] = b[n] * row - a[n] * y
        out[i] = y
    return out


def zero_phase(x: np.ndarray, order: int, cutoff: float, pad: int) -> np.ndarray:
    """Reflects ``pad`` samples at both ends of axis 0, filters forwards and backwards from states of rest, cuts the pad.

    Inside, the usual odd extension by three filter lengths (of order + 1 samples) keeps the ends from ringing.
    """
    n = len(x)
    pad = min(pad, n - 1)
    full = np.concatenate([x[pad:0:-1], x, x[-2 : -pad - 2 : -1]]) if pad else x
    odd = min(3 * (order + 1), len(full) - 1)
    ext = np.concatenate([2 * full[:1] - full[odd:0:-1], full, 2 * full[-1:] - full[-2 : -odd - 2 : -1]])
    for _ in range(2):
        for b, a in butterworth(order, cutoff):
            ext = _run(b, a, ext)
        ext = ext[::-1]
    return ext[odd : odd + len(full)][pad : pad + n]


def _steps(sections: list, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sections one after the other along axis 0 of all columns, from ``state`` (a row for each unit of delay): values, state."""
    out, state = np.empty_like(x), state.copy()
    for i, v in enumerate(x):
        at = 0
        for b, a in sections:
            n = len(a) - 1
            y = b[0] * v + state[at]
            for k in range(n - 1):
                state[at + k] = b[k + 1] * v + state[at + k + 1] - a[k + 1] * y
            state[at + n - 1] = b[n] * v - a[n] * y
            v, at = y, at + n
        out[i] = v
    return out, state


def _rest(sections: list, first: float) -> np.ndarray:
    """The state in which all sections give out what comes in, for a constant ``first``."""
    return np.array([(b[k + 1 :].sum() - a[k + 1 :].sum()) * first for b, a in sections for k in range(len(a) - 1)])


def _transition(sections: list, steps: int) -> np.ndarray:
    """What ``steps`` samples of nothing make of a state, as a matrix."""
    n = sum(len(a) - 1 for _, a in sections)
    return np.linalg.matrix_power(_steps(sections, np.zeros((1, n)), np.eye(n))[1], steps)


def run_from(sections: list, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A long series through the sections from a state: values and state behind the last.

    The series is cut into columns that are run side by side from nothing; their states add up by the transition of a column.
    """
    rows = max(1, int(len(x) ** 0.5))
    columns = len(x) // rows
    block = x[: rows * columns].reshape(columns, rows).T
    _, ends = _steps(sections, block, np.zeros((len(state), columns)))
    whole, states = _transition(sections, rows), np.empty((len(state), columns))
    for j in range(columns):
        states[:, j] = state
        state = whole @ state + ends[:, j]
    done = _steps(sections, block, states)[0].T.ravel()
    rest, end = _steps(sections, x[rows * columns :, None], state[:, None])
    return np.concatenate([done, rest[:, 0]]), end[:, 0]


@lru_cache(maxsize=16)
def filter_matrix(n: int, order: int, cutoff: float, pad: int) -> np.ndarray:
    """The filter as an n x n matrix: everything in it is linear in the series."""
    return zero_phase(np.eye(n), order, cutoff, pad)


def lowpass(df: DataFrame, keys: Keys, t: str, value: str = "value", cutoff: float = 1 / 24, order: int = 5, pad: int = 48) -> DataFrame:
    """low-passed series in (keys..., t, value), whole batches of series at a time.

    Members are filtered apart when the member is among the keys.  A series without any value stays missing; one with
    some missing is an error.
    """
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).alias("v")))).alias("s"), F.count(value).alias("n"), F.count(F.lit(1)).alias("m"))
    packed = packed.withColumn("s", F.when((F.col("n") > 0) & (F.col("n") < F.col("m")), F.raise_error(F.lit("a series has missing values"))).otherwise(F.col("s")))
    packed = packed.select(*keys, F.transform("s", lambda s: s.t).alias("ts"), F.transform("s", lambda s: s.v).alias("vs"), "n")

    def run(batches):
        for pdf in batches:
            done: list = [None] * len(pdf)
            by: dict[int, list[int]] = {}
            for i, (n, vs) in enumerate(zip(pdf["n"], pdf["vs"], strict=True)):
                by.setdefault(len(vs) if n else 0, []).append(i)
            for n, rows in by.items():
                if n > 1:
                    y = np.stack([np.array(pdf["vs"].iloc[i], float) for i in rows]) @ filter_matrix(n, order, cutoff, pad).T
                    for i, v in zip(rows, y, strict=True):
                        done[i] = v
                else:
                    for i in rows:
                        done[i] = np.array(pdf["vs"].iloc[i], float) if n else np.full(len(pdf["vs"].iloc[i]), np.nan)
            out = pdf.drop(columns=["vs", "n"])
            out["vs"] = done
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
    made = packed.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "ts"]) + ", vs array<double>")
    return made.select(*keys, F.explode(F.arrays_zip("ts", "vs")).alias("z")).select(*keys, F.col("z.ts").alias(t), F.nanvl(F.col("z.vs"), F.lit(None)).alias(value))


def _swept(chunks: DataFrame, keys: Keys, sections: list, back: bool) -> DataFrame:
    """One direction of the filter over chunks (keys, c, last, v): the same with filtered values.

    Each chunk is run from nothing, the states behind them are composed chunk by chunk (as many numbers as the filter has
    delays, for each chunk), and each chunk is run again from its state.
    """
    order = sum(len(a) - 1 for _, a in sections)
    start = F.col("c") == (F.col("last") if back else F.lit(0))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name in keys)

    def turned(v):
        x = np.asarray(v, float)
        return x[::-1] if back else x

    def ends(batches):
        for pdf in batches:
            out = pdf[[*keys, "c", "last"]].copy()
            states = []
            for v, first in zip(pdf["v"], pdf["start"], strict=True):
                x = turned(v)
                states.append(run_from(sections, x, _rest(sections, x[0]) if first else np.zeros(order))[1].tolist())
            out["n"], out["end"] = [len(v) for v in pdf["v"]], states
            yield out

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c", ascending=not back)
        state, states = None, []
        for n, end in zip(pdf["n"], pdf["end"], strict=True):
            states.append(None if state is None else state.tolist())
            state = np.asarray(end, float) if state is None else _transition(sections, int(n)) @ state + np.asarray(end, float)
        out = pdf[[*keys, "c"]].copy()
        out["state"] = states
        return out

    told = chunks.withColumn("start", start).mapInPandas(ends, f"{kinds}, c long, last long, n long, end array<double>")
    states = told.groupBy(*keys).applyInPandas(composed, f"{kinds}, c long, state array<double>")

    def again(batches):
        for pdf in batches:
            values = []
            for v, state in zip(pdf["v"], pdf["state"], strict=True):
                x = turned(v)
                y = run_from(sections, x, _rest(sections, x[0]) if state is None else np.asarray(state, float))[0]
                values.append((y[::-1] if back else y).tolist())
            out = pdf.drop(columns=["state"])
            out["v"] = values
            yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    joined = chunks.join(states, [*keys, "c"]).select(*chunks.columns, "state")
    return materialised(joined.mapInPandas(again, kinds), "swept")


def lowpass_long(df: DataFrame, keys: Keys, t: str, value: str = "value", cutoff: float = 1 / 24, order: int = 5, pad: int = 48, chunk: int = 1 << 16) -> DataFrame:
    """F1, F2 for series of any length: (keys..., t, value) as ``lowpass`` gives, with chunks of a series in several tasks.

    ``t`` is whole and counts steps without a hole.  No task holds more than two chunks of a series, and no matrix of its
    length is made.  A series without any value stays missing; a hole or some missing values are an error.
    """
    sections = butterworth(order, cutoff)
    least = pad + 3 * (order + 1) + 1
    chunk = max(chunk, least)
    rows = df.select(*keys, F.col(t).cast("long").alias("__t"), F.col(value).cast("double").alias("__v"))
    spans = rows.groupBy(*keys).agg(F.min("__t").alias("__t0"), F.max("__t").alias("__t1"), F.count("__v").alias("__n"), F.count(F.lit(1)).alias("__m"))
    spans = spans.withColumn("__m", F.when((F.col("__t1") - F.col("__t0") + 1 != F.col("__m")) | ((F.col("__n") > 0) & (F.col("__n") < F.col("__m"))), F.raise_error(F.lit("a series has missing values")).cast("long")).otherwise(F.col("__m")))
    last = F.greatest(F.expr(f"__m div {chunk}") - 1, F.lit(0)).cast("long")
    placed = rows.join(spans.select(*keys, "__t0", "__n", last.alias("last")), list(keys))
    empty = placed.where("__n = 0").select(*keys, F.col("__t").alias(t), F.lit(None).cast("double").alias(value))
    c = F.least(F.expr(f"(__t - __t0) div {chunk}"), F.col("last"))
    packed = placed.where("__n > 0").groupBy(*keys, c.cast("long").alias("c"), "last").agg(F.array_sort(F.collect_list(F.struct("__t", "__v"))).alias("s"))
    packed = packed.select(*keys, "c", "last", F.col("s")[0]["__t"].alias("t0"), F.transform("s", lambda x: x["__v"]).alias("v"))

    def extended(batches):
        for pdf in batches:
            values, heads, tails = [], [], []
            for v, c, last in zip(pdf["v"], pdf["c"], pdf["last"], strict=True):
                x = np.asarray(v, float)
                p = min(pad, len(x) - 1)
                head, tail = (x[p:0:-1] if p and c == 0 else x[:0]), (x[-2 : -p - 2 : -1] if p and c == last else x[:0])
                full = np.concatenate([head, x, tail])
                odd = min(3 * (order + 1), len(full) - 1)
                left, right = (2 * full[:1] - full[odd:0:-1] if c == 0 else x[:0]), (2 * full[-1:] - full[-2 : -odd - 2 : -1] if c == last else x[:0])
                values.append(np.concatenate([left, full, right]).tolist())
                heads.append(len(left) + len(head))
                tails.append(len(right) + len(tail))
            out = pdf.copy()
            out["v"], out["head"], out["tail"] = values, heads, tails
            yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema) + ", head long, tail long"
    swept = materialised(packed.mapInPandas(extended, kinds), "chunks")
    for back in (False, True):
        swept = _swept(swept, keys, sections, back)
    cut = F.slice("v", F.col("head").cast("int") + 1, (F.size("v") - F.col("head") - F.col("tail")).cast("int"))
    out = swept.select(*keys, "t0", F.posexplode(cut).alias("i", "y")).select(*keys, (F.col("t0") + F.col("i")).alias(t), F.col("y").alias(value))
    return out.unionByName(empty)


def lowpass_by_matrix(df: DataFrame, keys: Keys, t: str, n: int, value: str = "value", cutoff: float = 1 / 24, order: int = 5, pad: int = 48) -> DataFrame:
    """F1 as a join with the n x n filter matrix (``t`` from 0), for complete series of n samples."""
    m = filter_matrix(n, order, cutoff, pad)
    i, j = np.nonzero(np.ones_like(m))
    table = df.sparkSession.createDataFrame(pd.DataFrame({"__o": i.astype("int64"), "__i": j.astype("int64"), "__m": m.ravel()}))
    rows = df.join(F.broadcast(table), F.col(t) == F.col("__i"))  # n * n rows: a setting, not data
    return rows.groupBy(*keys, F.col("__o").alias(t)).agg(F.when(F.count(value) == n, F.sum(F.col("__m") * F.col(value))).alias(value))


def noise_draws(errors: DataFrame, region: str, t: str, sigma: str, draws: int, mode: str = "independent", root: SparseRoot | np.ndarray | None = None, seed: int = 0) -> DataFrame:
    """(draw, region, t, noise) with standard deviation ``sigma``.

    ``independent``: each region and time by itself.  ``coherent``: one number for all regions of a time.
    ``correlated``: regions (numbered from 0) by a root of their covariance, sparse or full.  Each (draw, time) has a random stream
    of its own, so that tasks can be run again.
    """
    if mode not in ("independent", "coherent", "correlated"):
        raise ValueError(mode)
    grouped = errors.groupBy(t).agg(F.array_sort(F.collect_list(F.struct(F.col(region).alias("r"), F.col(sigma).alias("s")))).alias("rows"))
    grouped = grouped.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    shared = errors.sparkSession.sparkContext.broadcast(root)

    def drawn(draw: int, time: int, rows: list) -> tuple[np.ndarray, np.ndarray]:
        rng, ids = np.random.default_rng([seed, draw, time]), np.array([r["r"] for r in rows])
        sigma = np.array([np.nan if r["s"] is None else r["s"] for r in rows])
        if mode == "coherent":
            return ids, rng.standard_normal() * sigma
        if mode == "correlated":
            root = shared.value
            z = root @ rng.standard_normal(len(root)) if isinstance(root, np.ndarray) else root.apply(rng.standard_normal(len(root.sd)))
            return ids, z[ids] * sigma
        return ids, rng.standard_normal(len(rows)) * sigma

    def run(batches):
        for pdf in batches:
            made = [drawn(int(draw), int(time), rows) for draw, time, rows in zip(pdf["draw"], pdf[t], pdf["rows"], strict=True)]
            if made:
                n = [len(ids) for ids, _ in made]
                yield pd.DataFrame({"draw": np.repeat(pdf["draw"].to_numpy(), n), region: np.concatenate([x for x, _ in made]), t: np.repeat(pdf[t].to_numpy(), n), "noise": np.concatenate([x for _, x in made])})

    kinds = {f.name: f.dataType.simpleString() for f in errors.schema}
    return grouped.mapInPandas(run, f"draw int, `{region}` {kinds[region]}, `{t}` {kinds[t]}, noise double")


def noise_chain(draws: DataFrame, keys: Keys, region: str, t: str, baseline: tuple[int, int], observed: DataFrame | None = None, noise: str = "noise", cutoff: float = 1 / 24, pad: int = 24) -> DataFrame:
    """noise taken through all that is done to observations: (keys, region, t, noise).

    Times that were not observed (absent from ``observed``) are interpolated, each series is referred to its mean over
    the baseline, each time step to the mean of its regions, and series are low-passed.
    """
    own = [*keys, region]
    rows = draws.select(*own, F.col(t).cast("double").alias(t), F.col(noise).alias("value"))
    if observed is not None:
        seen = rows.join(F.broadcast(observed.select(F.col(t).cast("double").alias(t)).distinct()), t)  # a row per time step
        rows = interpolate(seen, rows, own, t).where("value IS NOT NULL")
    based = anomaly(rows, own, F.col(t).between(*baseline)).select(*own, t, F.col("anomaly").alias("value"))
    out = lowpass(demean(based, [*keys, t]), own, t, cutoff=cutoff, pad=pad)
    return out.select(*own, F.col(t).cast("long").alias(t), F.col("value").alias(noise))
