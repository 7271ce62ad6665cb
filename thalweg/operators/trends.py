"""Regression, trends, uncertainty and significance (R*)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.probability import normal_two_sided, student_two_sided
from .aggregates import when_complete
from .iterate import materialised, running_total

Keys = Sequence[str]
#: Twice the two-sided probability of two standard deviations.
FDR_ALPHA = 2 * 0.0455


def ols(df: DataFrame, keys: Keys, t: str, value: str = "value") -> DataFrame:
    """Slope and intercept per cell; a missing value spoils the cell."""
    return df.groupBy(*keys).agg(
        when_complete(F.regr_slope(value, t), value).alias("slope"), when_complete(F.regr_intercept(value, t), value).alias("intercept"), F.count(value).alias("n")
    )


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's r over present pairs from moments; null without variance."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def pair_skill(df: DataFrame, keys: Keys, x: str = "truth", y: str = "pred") -> DataFrame:
    """R, R2, RMSE and bias per cell over present pairs."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    e, r = F.col(y) - F.col(x), correlation(x, y)
    return both.groupBy(*keys).agg(r.alias("r"), (r * r).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.count("*").alias("n"))


def trend_test(df: DataFrame, keys: Keys, t: str, value: str = "value", dof: float | None = None) -> DataFrame:
    """R2: slope, r and the two-sided p of Student's t (n / 10 degrees of freedom unless given)."""
    r = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("r")))
    out = df.groupBy(*keys).agg(when_complete(F.regr_slope(value, t), value).alias("slope"), when_complete(correlation(t, value), value).alias("r"), F.count(value).alias("n"))
    free = F.lit(float(dof)) if dof is not None else F.col("n") / 10.0
    stat = r * F.sqrt(free / (1.0 - r * r))
    return out.withColumn("p", student_two_sided(stat, free))


def member_mean_trend(df: DataFrame, keys: Keys, member: str, t: str, value: str = "value", per_year: float = 12.0) -> DataFrame:
    """Mean over members of their slopes per year, ``t`` in samples."""
    own = ols(df, [*keys, member], t, value)
    return own.groupBy(*keys).agg(F.avg(F.col("slope") * per_year).alias("slope"), F.count("slope").alias("n_members"))


def detrend(df: DataFrame, keys: Keys, t: str, value: str = "value") -> DataFrame:
    """Value less its straight line."""
    w = W.partitionBy(*keys)
    line = F.regr_intercept(value, t).over(w) + F.regr_slope(value, t).over(w) * F.col(t)
    return df.withColumn("detrended", F.when(F.count(value).over(w) == F.count(F.lit(1)).over(w), F.col(value) - line))


def detrended_skill(df: DataFrame, keys: Keys, t: str, x: str = "truth", y: str = "pred") -> DataFrame:
    """R and R2 of detrended pairs."""
    a = detrend(df, keys, t, x).withColumnRenamed("detrended", "__x")
    b = detrend(a, keys, t, y).withColumnRenamed("detrended", "__y")
    r = correlation("__x", "__y")
    return b.groupBy(*keys).agg(r.alias("r"), (r * r).alias("r2"))


def attenuation(df: DataFrame, keys: Keys, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Covariance with the truth over the truth's variance, present pairs."""
    both = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    return both.groupBy(*keys).agg(F.try_divide(F.covar_pop(truth, pred), F.nullif(F.var_pop(truth), F.lit(0.0))).alias("gamma"), F.count("*").alias("n"))


def windows_of(df: DataFrame, t: str, length: int, stride: int) -> DataFrame:
    """(start) of the windows of ``length`` steps that fit between the first and last t."""
    ends = df.agg(F.min(t).alias("a"), F.max(t).alias("b"))
    return ends.where(F.col("b") - F.col("a") + 1 >= length).select(F.explode(F.sequence(F.col("a"), F.col("b") - length + 1, F.lit(stride).cast("long"))).alias("start"))


def _sums(df: DataFrame, keys: Keys, t: str, value: str) -> DataFrame:
    """Running n, missing, sums of t, v, t * t and t * v of each series, t from its first: what slopes of stretches differ in."""
    base = df.agg(F.min(t).alias("__t0"))
    x, v = (F.col(t) - F.col("__t0")).cast("double"), F.col(value).cast("double")
    run = W.partitionBy(*keys).orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    present = F.when(v.isNotNull(), x)
    parts = {"n": F.count(v), "m": F.count(F.lit(1)), "x": F.sum(present), "v": F.sum(v), "xx": F.sum(present * present), "xv": F.sum(x * v)}
    return df.crossJoin(F.broadcast(base)).select(*keys, t, F.struct(*[F.coalesce(s.over(run), F.lit(0)).cast("double").alias(k) for k, s in parts.items()]).alias("__s"))


def _slope(s: dict[str, Column]) -> Column:
    return F.try_divide(s["n"] * s["xv"] - s["x"] * s["v"], F.nullif(s["n"] * s["xx"] - s["x"] * s["x"], F.lit(0.0)))


_SUMS = ("n", "m", "x", "v", "xx", "xv")


def stretch_trends(df: DataFrame, keys: Keys, t: str, stretches: DataFrame, name: str, value: str = "value") -> DataFrame:
    """(keys, name, slope, n) of stretches (name, lo, hi and, if there are, cut_lo, cut_hi, which are left out).

    Slopes come from differences of running sums: of each series, only its sums at the ends of stretches are looked up,
    however long these are.  A missing value in a stretch gives no slope.  ``t`` is whole and counts steps.  Names of one
    stretch are fitted as one.
    """
    cut = "cut_lo" in stretches.columns
    span = F.struct("lo", "hi", *(["cut_lo", "cut_hi"] if cut else [])).alias("__span")
    named = stretches.where("lo <= hi").select(name, span)
    stretches, of = named.select("__span").distinct().select("__span", "__span.*"), name
    name = "__span"
    edges = [F.struct(F.lit(1.0).alias("sign"), F.col("hi").alias("at")), F.struct(F.lit(-1.0).alias("sign"), (F.col("lo") - 1).alias("at"))]
    if cut:
        a, b = F.greatest("lo", "cut_lo"), F.least("hi", "cut_hi")
        some = F.col("cut_lo").isNotNull() & F.col("cut_hi").isNotNull() & (a <= b)
        edges += [F.when(some, F.struct(F.lit(-1.0).alias("sign"), b.alias("at"))), F.when(some, F.struct(F.lit(1.0).alias("sign"), (a - 1).alias("at")))]
    ends = stretches.select(name, F.explode(F.filter(F.array(*edges), lambda e: e.isNotNull())).alias("e")).select(name, "e.sign", F.col("e.at").cast("long").alias("at"))
    points = ends.groupBy("at").agg(F.count("*").alias("n")).select("at")
    # Sums at the asked times: the last row up to each, by one sort of a series' rows and the asked times together.
    rows = _sums(df, keys, t, value).withColumn("__q", F.lit(0))
    asked = df.select(*keys).distinct().crossJoin(F.broadcast(points)).select(*keys, F.col("at").alias(t), F.lit(None).cast(rows.schema["__s"].dataType).alias("__s"), F.lit(1).alias("__q"))
    upto = F.last("__s", True).over(W.partitionBy(*keys).orderBy(t, "__q").rowsBetween(W.unboundedPreceding, 0))
    known = rows.withColumn(t, F.col(t).cast("long")).unionByName(asked).withColumn("__s", upto).where("__q = 1").select(*keys, F.col(t).alias("at"), "__s")
    sums = known.join(ends, "at").groupBy(*keys, name).agg(*[F.sum(F.col("sign") * F.coalesce(F.col(f"__s.{k}"), F.lit(0.0))).alias(f"__{k}") for k in _SUMS])
    s = {k: F.col(f"__{k}") for k in _SUMS}
    fits = sums.where("__m > 0").select(*keys, name, F.when(s["n"] == s["m"], _slope(s)).alias("slope"), s["n"].cast("long").alias("n"))
    return named.join(fits, name).select(*keys, of, "slope", "n")


def sliding_trends(df: DataFrame, keys: Keys, t: str, length: int, stride: int, value: str = "value") -> DataFrame:
    """Slopes in sliding windows that fit between the first and last t, from running sums; short ones have none."""
    windows = windows_of(df, t, length, stride).select("start", F.col("start").alias("lo"), (F.col("start") + length - 1).alias("hi"))
    out = stretch_trends(df, keys, t, windows, "start", value)
    return out.withColumn("slope", F.when(F.col("n") == length, F.col("slope")))


def leave_out_trends(df: DataFrame, keys: Keys, t: str, part: Column, name: str, value: str = "value") -> DataFrame:
    """Slopes without each part (a year, say): sums of the whole series less those of the part."""
    base = df.agg(F.min(t).alias("__t0"))
    x, v = (F.col(t) - F.col("__t0")).cast("double"), F.col(value).cast("double")
    present = F.when(v.isNotNull(), x)
    parts = {"n": F.count(v), "m": F.count(F.lit(1)), "x": F.sum(present), "v": F.sum(v), "xx": F.sum(present * present), "xv": F.sum(x * v)}
    own = df.crossJoin(F.broadcast(base)).groupBy(*keys, part.alias(name)).agg(*[F.coalesce(s, F.lit(0)).cast("double").alias(k) for k, s in parts.items()])
    whole = own.groupBy(*keys).agg(*[F.sum(k).alias(f"__{k}") for k in _SUMS])
    names = own.select(name).distinct()
    rest = whole.crossJoin(F.broadcast(names)).join(own, [*keys, name], "left")
    s = {k: F.col(f"__{k}") - F.coalesce(F.col(k), F.lit(0.0)) for k in _SUMS}
    return rest.select(*keys, name, F.when(s["n"] == s["m"], _slope(s)).alias("slope"), s["n"].cast("long").alias("n")).where("n > 0")


#: (months, blocks, draws) -> the first month of each block of each draw.
Starts = Callable[[int, int, int], np.ndarray]


def seeded_starts(seed: int = 0) -> Starts:
    """Starts from a seeded stream, draw by draw."""

    def starts(n_time: int, blocks: int, draws: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.stack([rng.integers(0, n_time, blocks) for _ in range(draws)]) if draws else np.zeros((0, blocks), int)

    return starts


def integer_starts(n_time: int, blocks: int, draws: int) -> np.ndarray:
    """Starts by integer arithmetic, which any SQL engine can follow."""
    d, b = np.arange(draws)[:, None], np.arange(blocks)[None, :]
    return (d * 7919 + b * 104729 + d * b * 31) % n_time


def block_starts(n_time: int, block: int, draws: int, seed: int = 0, starts: Starts | None = None) -> np.ndarray:
    """Months (draws x n_time) of a circular moving-block bootstrap; a block of 0 or 1 draws single months."""
    block = max(1, min(block, n_time))
    first = (starts or seeded_starts(seed))(n_time, -(-n_time // block), draws)
    return ((first[:, :, None] + np.arange(block)) % n_time).reshape(draws, -1)[:, :n_time]


def slope_weights(index: np.ndarray, t: np.ndarray) -> np.ndarray:
    """W[draw, month]: what each month's residual adds to the slope of a draw."""
    x = t - t.mean()
    a = x / (x @ x)
    out = np.zeros(index.shape)
    np.add.at(out, (np.arange(len(index))[:, None], index), a[None, :])
    return out


def bootstrap_sigma(df: DataFrame, keys: Keys, t: str, value: str = "value", block: int = 48, draws: int = 1000, seed: int = 0, starts: Starts | None = None) -> DataFrame:
    """Slope, intercept and its standard deviation (n - 1) over bootstrap draws of the residuals.

    All cells share the months drawn, so that a batch of cells is one matrix product.  Cells with a missing month have nulls.
    """
    whole = df.sparkSession.createDataFrame([("whole", block, None, None, None, None)], SCENARIO)
    out = refits(df, keys, t, whole, value, draws, seed, starts)
    return out.select(*keys, "slope", "intercept", "sigma_serial")


def bootstrap_sigma_plain(df: DataFrame, keys: Keys, t: str, n_time: int, block: int, draws: int, value: str = "value") -> DataFrame:
    """R5, W8 in plain columns, with block starts from integer arithmetic: the form that SQL can follow.

    ``t`` counts from 0.  The draws are folded into draws x months weights before they meet the data.
    """
    spark = df.sparkSession
    n_blocks = -(-n_time // block)
    mean = (n_time - 1) / 2.0
    norm = sum((i - mean) ** 2 for i in range(n_time))
    place = spark.range(draws).withColumnRenamed("id", "draw").select("draw", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"))
    place = place.withColumn("first", F.pmod(F.col("draw") * 7919 + F.col("b") * 104729 + F.col("draw") * F.col("b") * 31, F.lit(n_time)))
    place = place.select("draw", "b", "first", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k")).withColumn("pos", F.col("b") * block + F.col("k")).where(F.col("pos") < n_time)
    weights = place.groupBy("draw", F.pmod(F.col("first") + F.col("k"), F.lit(n_time)).alias("__t")).agg(F.sum((F.col("pos") - mean) / norm).alias("w"))
    resid = detrend(df, keys, t, value).where("detrended IS NOT NULL")
    # draws x months rows, both settings of the test: small whatever the data.
    change = resid.join(F.broadcast(weights), F.col(t) == F.col("__t")).groupBy(*keys, "draw").agg(F.sum(F.col("w") * F.col("detrended")).alias("d"))
    return change.groupBy(*keys).agg(F.stddev_samp("d").alias("sigma_serial"))


def quadrature(df: DataFrame, slope: str, sigmas: Sequence[str], n_sigma: float = 2.0) -> DataFrame:
    """Total sigma, z, two-sided normal p, interval and significance of a slope."""
    total = F.sqrt(sum((F.col(s) * F.col(s) for s in sigmas[1:]), F.col(sigmas[0]) * F.col(sigmas[0])))
    out = df.withColumn("sigma_total", total).withColumn("z", F.try_divide(F.abs(slope), F.nullif(F.col("sigma_total"), F.lit(0.0))))
    return out.withColumns({
        "p": normal_two_sided(F.col("z")), "low": F.col(slope) - n_sigma * F.col("sigma_total"), "high": F.col(slope) + n_sigma * F.col("sigma_total"),
        "significant": F.abs(slope) > n_sigma * F.col("sigma_total"),
    })


def false_discovery(df: DataFrame, keys: Keys, p: str = "p", alpha: float = FDR_ALPHA, local: float = 0.0455, tested: Column | None = None) -> DataFrame:
    """Benjamini-Hochberg within each group of ``keys``, and the local threshold; untested rows are null.

    A group is a map of any size: its p-values are ranked by ranges, and only its limit goes back to the rows.
    """
    usable = F.col(p).isNotNull() & (tested if tested is not None else F.lit(True))
    rows = df.withColumn("__q", F.when(usable, F.col(p)))
    counts = rows.where("__q IS NOT NULL").groupBy(*keys, "__q").agg(F.count("*").alias("__c"))
    ranked = running_total(counts, [*[F.col(k).asc() for k in keys], F.col("__q").asc()], "__c", "__upto")
    groups = ranked.groupBy(*keys).agg(F.sum("__c").alias("__m"), F.min(F.col("__upto") - F.col("__c")).alias("__first"))
    placed = ranked.join(groups, list(keys)) if keys else ranked.crossJoin(F.broadcast(groups))
    passes = F.col("__q") <= (F.col("__upto") - F.col("__first")) / F.col("__m") * F.lit(alpha)
    limits = placed.groupBy(*keys).agg(F.max(F.when(passes, F.col("__q"))).alias("__limit"))
    out = rows.join(limits, list(keys), "left") if keys else rows.crossJoin(F.broadcast(limits))
    told = F.coalesce(F.col("__q") <= F.least(F.col("__limit"), F.lit(local)), F.lit(False)) & F.col("__limit").isNotNull()
    return out.withColumn("fdr_significant", F.when(F.col("__q").isNotNull(), told)).drop("__q", "__limit")


def testable(df: DataFrame, keys: Keys, t_values: DataFrame, p: str = "p", value: str = "value") -> DataFrame:
    """(keys..., testable): a present p, and a series that varies at all."""
    varies = t_values.groupBy(*keys).agg((F.stddev_pop(value) > 0).alias("__v"))
    return df.join(varies, list(keys), "left").withColumn("testable", F.col(p).isNotNull() & ~F.isnan(p) & F.coalesce("__v", F.lit(False))).drop("__v")


def propagated_sigma(df: DataFrame, keys: Keys, weight: str, sigma: str) -> DataFrame:
    """Root of the sum of squared weighted sigmas."""
    return df.groupBy(*keys).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight) * F.col(sigma) * F.col(sigma))).alias("sigma"))


def matched_series(a: DataFrame, b: DataFrame, on: str = "month", x: str = "truth", y: str = "pred") -> DataFrame:
    """Months that both have, each series less its mean there."""
    both = a.join(b, on).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    means = both.agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    return both.crossJoin(F.broadcast(means)).withColumns({x: F.col(x) - F.col("__mx"), y: F.col(y) - F.col("__my")}).drop("__mx", "__my")


SCENARIO = "scenario string, block int, lo long, hi long, cut_lo long, cut_hi long"
#: Steps in a time axis, and scenarios, that the driver takes at most.
AXIS, SCENARIOS = 100_000, 10_000


def _axis(df: DataFrame, t: str) -> np.ndarray:
    """The distinct steps of time, sorted; there are AXIS at most."""
    times = [r[0] for r in df.select(t).distinct().orderBy(t).limit(AXIS + 1).collect()]
    if len(times) > AXIS:
        raise ValueError(f"over {AXIS} steps of time")
    return np.array(times)


def _months_of(scenario, times: np.ndarray) -> np.ndarray:
    """The places of a scenario's steps in the time axis."""
    keep = np.ones(len(times), bool)
    if scenario["lo"] is not None:
        keep &= times >= scenario["lo"]
    if scenario["hi"] is not None:
        keep &= times <= scenario["hi"]
    if scenario["cut_lo"] is not None and scenario["cut_hi"] is not None:
        keep &= (times < scenario["cut_lo"]) | (times > scenario["cut_hi"])
    return np.flatnonzero(keep)


def refits(df: DataFrame, keys: Keys, t: str, scenarios: DataFrame, value: str = "value", draws: int = 1000, seed: int = 0, starts: Starts | None = None) -> DataFrame:
    """Every scenario's trend with the bootstrap of its own months: (keys, scenario, slope, intercept, sigma_serial, n).

    ``scenarios`` are stretches of time with a block length (SCENARIO); nulls of lo and hi mean the whole record.  Blocks are
    circular over a scenario's own steps.  The draws of a scenario are linear in its residuals, so that their variance is a
    quadratic form with one matrix of months x months, computed in each worker from the settings; a batch of cells is two
    matrix products a scenario, and no row is made for a scenario's months.  A cell without a value in every one of a
    scenario's steps has nulls there; scenarios of under three steps are left out.
    """
    df = materialised(df.select(*keys, t, value), "series")
    times = _axis(df, t)
    rows = scenarios.select("scenario", "block", "lo", "hi", "cut_lo", "cut_hi").limit(SCENARIOS + 1).collect()
    if len(rows) > SCENARIOS:
        raise ValueError(f"over {SCENARIOS} scenarios")
    plans = [(r["scenario"], r["block"], _months_of(r, times)) for r in rows]
    plans = [p for p in plans if len(p[2]) > 2]
    shared = df.sparkSession.sparkContext.broadcast((times.astype(float), plans))
    packed = df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).alias("v"))).alias("series"))

    def spreads(kept: dict):
        """Of each scenario: the slope's weights and the covariance of what months' residuals add to the draws."""
        if not kept:
            times, plans = shared.value
            for name, block, own in plans:
                x = times[own] - times[own].mean()
                w = slope_weights(block_starts(len(own), block, draws, seed, starts), times[own])
                kept[name] = own, x / (x @ x), np.atleast_2d(np.cov(w, rowvar=False)) if draws > 1 else np.full((len(own), len(own)), np.nan)
        return kept

    def fit(batches):
        kept: dict = {}
        for pdf in batches:
            times = shared.value[0]
            y = np.full((len(pdf), len(times)), np.nan)
            for i, s in enumerate(pdf["series"]):
                at = np.searchsorted(times, [p["t"] for p in s])
                y[i, at] = [np.nan if p["v"] is None else p["v"] for p in s]
            for name, (own, a, spread) in spreads(kept).items():
                v = y[:, own]
                slope = v @ a
                resid = v - v.mean(axis=1, keepdims=True) - slope[:, None] * (times[own] - times[own].mean())
                out = pdf.drop(columns="series")
                out["scenario"] = name
                found = {"slope": slope, "intercept": v.mean(axis=1) - slope * times[own].mean(), "sigma_serial": np.sqrt(np.maximum(((resid @ spread) * resid).sum(axis=1), 0.0))}
                for k, x in found.items():
                    out[k] = pd.Series(x, index=out.index).astype(object).where(np.isfinite(x), None)
                out["n"] = len(own)
                yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name != "series")
    return packed.mapInPandas(fit, f"{kinds}, scenario string, slope double, intercept double, sigma_serial double, n long")


def robustness_grid(months: DataFrame, gap: tuple[int, int], trims: Sequence[int] = (0, 1, 2, 3, 4), buffers: Sequence[int] = (0, 6, 12, 18, 24), blocks: Sequence[int] = (0, 6, 12, 24, 48, 72), block: int = 48, least: int = 144, least_part: int = 24, ix: str = "month_ix") -> DataFrame:
    """The grid of scenarios of a monthly record (month_ix from January 1970): SCENARIO and family.

    The whole record; trimmed by whole years at both ends and without each year, where ``least`` months stay; without a gap
    and buffers around it; before and behind the gap, where there are ``least_part`` months; and other block lengths.
    """
    base = gap_scenarios(months, gap, buffers, trims, least_part, ix)
    base = base.select("scenario", F.col("kind").alias("family"), F.lit(block).alias("block"), "lo", "hi", "cut_lo", "cut_hi").where(f"family != 'startend' OR hi - lo + 1 >= {least}")
    ends = months.agg(F.min(ix).alias("lo"), F.max(ix).alias("hi"))
    year = F.explode(F.sequence(F.floor(F.col("lo") / 12), F.floor(F.col("hi") / 12)))
    years = ends.select("lo", "hi", year.alias("y")).select(
        F.concat(F.lit("drop "), (F.col("y") + 1970).cast("string")).alias("scenario"), F.lit("jackknife").alias("family"), F.lit(block).alias("block"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"),
        F.greatest("lo", F.col("y") * 12).cast("long").alias("cut_lo"), F.least("hi", F.col("y") * 12 + 11).cast("long").alias("cut_hi"),
    ).where(f"hi - lo - (cut_hi - cut_lo) >= {least}")
    other = F.explode(F.array(*[F.lit(b) for b in blocks if b != block]))
    serial = ends.select("lo", "hi", other.alias("block")).select(
        F.concat(F.lit("blocks of "), F.col("block").cast("string")).alias("scenario"), F.lit("serial").alias("family"), "block", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"),
        F.lit(None).cast("long").alias("cut_lo"), F.lit(None).cast("long").alias("cut_hi"),
    )
    return base.unionByName(years).unionByName(serial)


def robustness(fits: DataFrame, scenarios: DataFrame, keys: Keys, fixed: DataFrame, sigmas: Sequence[str], n_sigma: float = 2.0) -> DataFrame:
    """Q17: each refit with its whole uncertainty, beside the baseline's: the rows that summaries are made of.

    ``fixed`` has, for each cell, the terms ``sigmas`` that stay what they are for the whole record.  A cell is tested where
    its baseline has a p and a series that varies at all, which a serial sigma above zero tells.
    """
    total = quadrature(fits.join(fixed, list(keys)), "slope", ["sigma_serial", *sigmas], n_sigma)
    total = total.join(F.broadcast(scenarios.select("scenario", "family")), "scenario")  # SCENARIOS rows at most
    base = total.where("family = 'baseline'").where("p IS NOT NULL AND sigma_serial > 0").select(
        *keys, F.col("slope").alias("base"), F.col("sigma_serial").alias("base_serial"), F.col("sigma_total").alias("base_total"), F.col("significant").alias("base_significant"), F.col("n").alias("base_n")
    )
    return total.select(*keys, "scenario", "family", "slope", "sigma_serial", F.col("sigma_total").alias("sigma"), "significant", "n").join(base, list(keys))


def robustness_summary(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """One row a scenario: shares of cells significant, retained, flipped and moved; correlation with the baseline's
    map; medians and largest changes, raw and in baseline sigmas; the ratio of median serial sigmas; if enough is left."""
    from .aggregates import percentiles, significance_summary

    told = rows.withColumn("moved", F.abs(F.col("slope") - F.col("base"))).withColumn("in_sigma", F.try_divide(F.col("moved"), F.nullif(F.col("base_total"), F.lit(0.0))))
    out = significance_summary(told.withColumn("sigma", F.col("base_total")), ["scenario", "family"])
    more = told.groupBy("scenario").agg(
        correlation("base", "slope").alias("map_r"), F.max("moved").alias("most_moved"), F.max("in_sigma").alias("most_in_sigma"), F.max("n").alias("n"), (F.max("n") >= share * F.max("base_n")).alias("enough"), F.count(F.lit(1)).alias("cells")
    )
    for column, name in (("moved", "median_moved"), ("in_sigma", "median_in_sigma"), ("sigma_serial", "__s"), ("base_serial", "__b")):
        more = more.join(percentiles(told, ["scenario"], [], column).withColumnRenamed("median", name), "scenario", "left")
    more = more.withColumn("serial_ratio", F.try_divide(F.col("__s"), F.nullif(F.col("__b"), F.lit(0.0)))).drop("__s", "__b")
    return out.join(more, "scenario")


def scenario_months(months: DataFrame, scenarios: DataFrame, ix: str = "month_ix") -> DataFrame:
    """(scenario, month) for windows with an optional excised stretch: lo <= month <= hi outside [cut_lo, cut_hi]."""
    inside = F.col(ix).between(F.col("lo"), F.col("hi")) & ~F.coalesce(F.col(ix).between(F.col("cut_lo"), F.col("cut_hi")), F.lit(False))
    # The time axis is the small side: a row per month, however many scenarios.
    return scenarios.join(F.broadcast(months.select(ix).distinct()), inside).select("scenario", ix)


def gap_scenarios(months: DataFrame, gap: tuple[int, int], buffers: Sequence[int], trims: Sequence[int] = (), least: int = 24, ix: str = "month_ix") -> DataFrame:
    """Stretches of a record around a gap in it: (scenario, kind, lo, hi, cut_lo, cut_hi).

    Trimmed at the start and end by whole years, the gap cut out with a buffer on both sides, and what is before and
    behind the gap alone, where that has ``least`` months or more.
    """
    ends = months.agg(F.min(ix).alias("a"), F.max(ix).alias("b"), F.min(F.when(F.col(ix).between(*gap), F.col(ix))).alias("g0"), F.max(F.when(F.col(ix).between(*gap), F.col(ix))).alias("g1"))
    none = F.lit(None).cast("long")
    row = lambda name, kind, lo, hi, a=none, b=none: F.struct(F.lit(name).alias("scenario"), F.lit(kind).alias("kind"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), a.cast("long").alias("cut_lo"), b.cast("long").alias("cut_hi"))
    a, b, g0, g1 = (F.col(c) for c in ("a", "b", "g0", "g1"))
    rows = [row("whole", "baseline", a, b)]
    rows += [row(f"start +{x}y, end -{y}y", "startend", a + 12 * x, b - 12 * y) for x in trims for y in trims if x or y]
    rows += [F.when(g0.isNotNull(), row(f"gap +-{k}", "gap", a, b, F.greatest(a, g0 - k), F.least(b, g1 + k))) for k in buffers]
    rows += [F.when(g0 - a >= least, row("before the gap", "split", a, g0 - 1)), F.when(b - g1 >= least, row("behind the gap", "split", g1 + 1, b))]
    return ends.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*").where("lo <= hi")
