"""Missing-aware aggregates over long tables (A*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import col, days_in_month, month_of
from .iterate import running_total

Keys = Sequence[str]


def positive_weight(w: Column | str) -> Column:
    """Missing and non-positive weights weigh nothing."""
    return F.when(col(w) > 0, col(w)).otherwise(0.0)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Sum of w * v over the sum of the w of present v; null if nothing weighs."""
    v, w = col(value), positive_weight(weight)
    total = F.sum(F.when(v.isNotNull(), w))
    return F.try_divide(F.sum(v * w), F.nullif(total, F.lit(0.0)))


def complete(value: Column | str) -> Column:
    """True in groups without missing values."""
    return F.count(col(value)) == F.count(F.lit(1))


def when_complete(result: Column, value: Column | str) -> Column:
    """``result`` in groups without missing values, else null: one missing value spoils the group."""
    return F.when(complete(value), result)


def area_mean(field: DataFrame, membership: DataFrame, cell: Keys, region: Keys, time: str, value: str = "value", weight: str = "w") -> DataFrame:
    """A1: region means per time step; cells may belong to several regions."""
    return field.join(membership, list(cell)).groupBy(*region, time).agg(weighted_mean(value, weight).alias(value))


def cosine_weight(lat: Column | str) -> Column:
    """A3."""
    return F.cos(F.radians(col(lat)))


def period_mean(df: DataFrame, keys: Keys, inside: Column, value: str = "value") -> DataFrame:
    """A4: mean of the values inside the period."""
    return df.groupBy(*keys).agg(F.avg(F.when(inside, F.col(value))).alias("mean"))


def ensemble_baseline(df: DataFrame, keys: Keys, member: str, value: str = "value") -> DataFrame:
    """A5: mean over members of the members' means; members count alike, however long."""
    return df.groupBy(*keys, member).agg(F.avg(value).alias("m")).groupBy(*keys).agg(F.avg("m").alias("mean"), F.count("m").alias("n_members"))


def complete_month_means(df: DataFrame, keys: Keys, ts: str, value: str = "value") -> DataFrame:
    """Monthly means of months whose every calendar day has a row."""
    rows = df.withColumn("month", month_of(ts))
    out = rows.groupBy(*keys, "month").agg(F.avg(value).alias(value), F.countDistinct(F.to_date(ts)).alias("days"))
    return out.where(F.col("days") >= days_in_month("month"))


def count_weighted_month(df: DataFrame, keys: Keys, ts: str, granule: str, n: str, value: str = "value", least: int = 3) -> DataFrame:
    """Means weighted by counts, of months with ``least`` granules or more."""
    rows = df.withColumn("month", month_of(ts))
    used = F.when(F.col(n) > 0, F.col(n))
    mean = F.try_divide(F.sum(F.col(value) * used), F.sum(F.when(F.col(value).isNotNull(), used)))
    out = rows.groupBy(*keys, "month").agg(mean.alias(value), F.countDistinct(granule).alias("granules"))
    return out.where(F.col("granules") >= least)


def resample_months(df: DataFrame, keys: Keys, ts: str, value: str = "value") -> DataFrame:
    """Calendar means from the first to the last month of each series; months without rows are null."""
    means = df.groupBy(*keys, month_of(ts).alias("month")).agg(F.avg(value).alias(value))
    span = means.groupBy(*keys).agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return span.join(means, [*keys, "month"], "left")


def demean(df: DataFrame, by: Keys, value: str = "value") -> DataFrame:
    """Value less the mean of its group (of a month, say)."""
    return df.withColumn(value, F.col(value) - F.avg(value).over(W.partitionBy(*by)))


def anomaly(df: DataFrame, keys: Keys, inside: Column, value: str = "value") -> DataFrame:
    """A10: value less the series' mean inside the baseline period."""
    return df.withColumn("anomaly", F.col(value) - F.avg(F.when(inside, F.col(value))).over(W.partitionBy(*keys)))


def within_member_std(df: DataFrame, keys: Keys, member: str, value: str = "value") -> DataFrame:
    """Mean over members of the standard deviation (n) within each; a missing value spoils its member."""
    own = df.groupBy(*keys, member).agg(when_complete(F.stddev_pop(value), value).alias("s"))
    return own.groupBy(*keys).agg(when_complete(F.avg("s"), "s").alias("std"))


def member_spread(df: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Mean and standard deviation (n) over members."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))


def product_spread(df: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Standard deviation (n - 1) over product choices."""
    return df.groupBy(*keys).agg(F.stddev_samp(value).alias("spread"), F.count(value).alias("n"))


def trend_spread(df: DataFrame, keys: Keys, choice: str, t: str, value: str = "value") -> DataFrame:
    """Standard deviation (n - 1) over choices of each choice's trend."""
    slopes = df.groupBy(*keys, choice).agg(when_complete(F.regr_slope(value, t), value).alias("slope"))
    return slopes.groupBy(*keys).agg(F.stddev_samp("slope").alias("spread"), F.count("slope").alias("n"))


def grand_spread(df: DataFrame, keys: Keys, expected: int, value: str = "value") -> DataFrame:
    """Mean, spread about the grand mean (n - 1) and count; both null unless ``expected`` values are there."""
    n = F.count(value)
    return df.groupBy(*keys).agg(
        F.when(n == expected, F.avg(value)).alias("mean"), F.when(n == expected, F.stddev_samp(value)).alias("spread"), n.alias("nobs"), (n != expected).alias("unpriced")
    )


def branch_spread(df: DataFrame, keys: Keys, branch: str, expected: int, value: str = "value") -> DataFrame:
    """Spread about the branch means, n - branches in the denominator; null unless ``expected`` values are there."""
    rows = df.withColumn("__d", F.col(value) - F.avg(value).over(W.partitionBy(*keys, branch)))
    n, branches = F.count(value), F.countDistinct(F.when(F.col(value).isNotNull(), F.col(branch)))
    spread = F.sqrt(F.try_divide(F.sum(F.col("__d") * F.col("__d")), (n - branches).cast("double")))
    return rows.groupBy(*keys).agg(F.when(n == expected, F.avg(value)).alias("mean"), F.when(n == expected, spread).alias("spread"), n.alias("nobs"))


def scenario_rmse(df: DataFrame, keys: Keys, member: str, truth: str = "truth", pred: str = "pred", down: str | None = None) -> DataFrame:
    """Pooled RMSE, and with each member's mean error taken out.

    ``down`` names one of the keys, a level: cells without a value take that of the level above them.
    """
    e = F.col(pred) - F.col(truth)
    rows = df.withColumn("__e", e).withColumn("__d", F.col("__e") - F.avg("__e").over(W.partitionBy(*keys, member)))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    out = rows.groupBy(*keys).agg(rms("__e").alias("rmse"), rms("__d").alias("rmse_debiased"))
    if down is None:
        return out
    above = W.partitionBy(*[k for k in keys if k != down]).orderBy(down).rowsBetween(W.unboundedPreceding, 0)
    return out.select(*keys, *[F.last(c, ignorenulls=True).over(above).alias(c) for c in ("rmse", "rmse_debiased")])


def moments_about(df: DataFrame, keys: Keys, value: str, origin: str) -> DataFrame:
    """Bias and variance (n - 1, not below 0) of differences to a base run, from two running sums."""
    d = F.col(value) - F.col(origin)
    n, s, q = F.count(d), F.sum(d), F.sum(d * d)
    return df.groupBy(*keys).agg(F.try_divide(s, n).alias("bias"), F.greatest(F.lit(0.0), F.try_divide(q - F.try_divide(s * s, n), F.nullif(n - 1, F.lit(0)))).alias("variance"))


def member_moments(df: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Mean, standard deviation (n) and mean magnitude over members."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.avg(F.abs(value)).alias("mean_abs"))


def relevance_by_block(df: DataFrame, keys: Keys, feature: str, size: int, value: str = "value") -> DataFrame:
    """Sum and sum of magnitudes of each block of ``size`` features."""
    return df.groupBy(*keys, F.floor(F.col(feature) / size).cast("int").alias("block")).agg(F.sum(value).alias("total"), F.sum(F.abs(value)).alias("magnitude"))


def contiguous_groups(df: DataFrame, by: Keys, order: str, label: str) -> DataFrame:
    """Numbers the runs of equal labels in each series."""
    w = W.partitionBy(*by).orderBy(order)
    changed = F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(0))
    return df.withColumn("__c", changed).withColumn("group", F.sum("__c").over(w)).drop("__c")


def realization_means(df: DataFrame, realization: str, keys: Keys, value: str = "value") -> DataFrame:
    """Means over each realization's rows of relevance and of its size, and each realization's share of the whole size."""
    own = df.groupBy(realization, *keys).agg(F.avg(value).alias("mean"), F.avg(F.abs(value)).alias("mean_abs"), F.count(value).alias("n"))
    whole = F.sum("mean_abs").over(W.partitionBy(realization))
    return own.withColumn("share", F.try_divide(F.col("mean_abs"), F.nullif(whole, F.lit(0.0))))


def percentiles(df: DataFrame, keys: Keys, points: Sequence[float], value: str = "value") -> DataFrame:
    """Exact percentiles with linear interpolation, and the median.

    A group may hold any share of the rows: values are counted by (keys, value), ranked by ranges over all groups, and
    only the rows around each percentile are looked at.
    """
    wanted = [*points, 0.5]
    names = [*[f"p{round(100 * p)}" for p in points], "median"]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    upto = running_total(counts, [*[F.col(k).asc() for k in keys], F.col("__v").asc()], "__c", "__upto")
    groups = upto.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.min(F.col("__upto") - F.col("__c")).alias("__first"))
    placed = upto.join(groups, list(keys)) if keys else upto.crossJoin(F.broadcast(groups))
    high, low = F.col("__upto") - F.col("__first"), F.col("__upto") - F.col("__first") - F.col("__c")
    out = []
    for p, name in zip(wanted, names, strict=True):
        at = F.lit(float(p)) * (F.col("__n") - 1)
        one = lambda place: F.max(F.when((low <= place) & (place < high), F.col("__v")))
        below, above = one(F.floor(at)), one(F.ceil(at))
        out.append((below + (above - below) * F.max(at - F.floor(at))).alias(name))
    return placed.groupBy(*keys).agg(*out)


def rms(df: DataFrame, keys: Keys, variance: str) -> DataFrame:
    """Root of the mean variance."""
    return df.groupBy(*keys).agg(F.sqrt(F.avg(variance)).alias("rms"))


def significance_summary(df: DataFrame, keys: Keys, base: str = "base", slope: str = "slope", sigma: str = "sigma", significant: str = "significant", base_significant: str = "base_significant") -> DataFrame:
    """Shares of cells that are significant and that move by over one and two sigma; of those that were significant
    before, the shares that still are and that change sign."""
    share = lambda c: F.avg(c.cast("double"))
    was = lambda c: F.when(F.col(base_significant), c)
    moved = F.abs(F.col(slope) - F.col(base))
    return df.groupBy(*keys).agg(
        share(F.col(significant)).alias("significant"), share(was(F.col(significant))).alias("retained"), share(was(F.signum(slope) != F.signum(base))).alias("sign_flipped"),
        share(moved > F.col(sigma)).alias("over_1_sigma"), share(moved > 2 * F.col(sigma)).alias("over_2_sigma"),
    )


def worst_case(df: DataFrame, keys: Keys, cell: Keys, base: str = "base", slope: str = "slope", sigma: str = "sigma") -> DataFrame:
    """Each cell's largest change over the tests of a family, in sigmas, and how that is spread over the cells."""
    moved = F.try_divide(F.abs(F.col(slope) - F.col(base)), F.nullif(F.col(sigma), F.lit(0.0)))
    worst = df.groupBy(*keys, *cell).agg(F.max(moved).alias("worst"))
    counts = worst.groupBy(*keys).agg(F.max("worst").alias("worst"), F.avg((F.col("worst") > 1).cast("double")).alias("over_1_sigma"), F.count("worst").alias("cells"))
    return percentiles(worst, keys, [0.95], "worst").join(counts, list(keys))


def skill_summary(df: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Median, minimum, standard deviation (n) and spread in per cent of the median."""
    rest = df.groupBy(*keys).agg(F.min(value).alias("least"), F.stddev_pop(value).alias("std"))
    both = rest.join(percentiles(df, keys, [], value), list(keys), "left")
    return both.select(*keys, "median", "least", "std", F.try_divide(100.0 * F.col("std"), F.col("median")).alias("spread_percent"))


def identical_series(df: DataFrame, series: str, t: str, value: str = "value") -> DataFrame:
    """A number for each distinct series of values; equal series share it (the smallest series' key)."""
    packed = df.groupBy(series).agg(F.array_sort(F.collect_list(F.struct(t, value))).alias("__v"))
    return packed.withColumn("pattern", F.min(series).over(W.partitionBy("__v"))).drop("__v")


def region_boxes(cells: DataFrame, region: str, half: float, lat_min: float = -75.0, lat_max: float = 65.0) -> DataFrame:
    """Bounding boxes of regions without land in the latitude band; boxes that span over 180 degrees cross 180."""
    band = F.col("lat").between(lat_min, lat_max)
    out = cells.groupBy(region).agg(
        F.max(F.when(band, F.col("land"))).alias("__land"), F.min("lon").alias("__w"), F.max("lon").alias("__e"), F.min("lat").alias("lat_b1"), F.max("lat").alias("lat_b2"),
        F.min(F.when(F.col("lon") > 0, F.col("lon"))).alias("__we"), F.max(F.when(F.col("lon") <= 0, F.col("lon"))).alias("__ew"),
    )
    across = F.col("__e") - F.col("__w") > 180.0
    west, east = F.when(across, F.col("__we")).otherwise(F.col("__w")), F.when(across, F.col("__ew")).otherwise(F.col("__e"))
    return out.where(F.col("__land") == F.lit(False)).select(
        region, (west - half).alias("lon_b1"), (east + half).alias("lon_b2"),
        (F.col("lat_b1") - half).alias("lat_b1"), (F.col("lat_b2") + half).alias("lat_b2"), across.alias("across_180"),
    )


def dip(df: DataFrame, keys: Keys, inside: Column, value: str = "value") -> DataFrame:
    """The smallest value in a window."""
    return df.groupBy(*keys).agg(F.min(F.when(inside, F.col(value))).alias("dip"))
