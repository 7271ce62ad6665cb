"""Row-relative operators on series and planes (W*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import month_from_index, month_index

Keys = Sequence[str]


def centred_smooth(df: DataFrame, keys: Keys, order: str, value: str = "value", window: int = 5) -> DataFrame:
    """Centred mean over present values; near an end the window shrinks on both sides alike."""
    half = window // 2
    w = W.partitionBy(*keys).orderBy(order)
    edge = F.least(F.row_number().over(w) - 1, F.count(F.lit(1)).over(W.partitionBy(*keys)) - F.row_number().over(w), F.lit(half))
    out = None
    for k in range(half + 1):
        mean = F.avg(value).over(w.rowsBetween(-k, k))
        out = F.when(edge == k, mean) if out is None else out.when(edge == k, mean)
    return df.withColumn("smooth", out)


def month_steps(df: DataFrame, keys: Keys, month: str = "month") -> DataFrame:
    """Months since the row before in each series (1: contiguous, 0: a duplicate, null: the first or no date)."""
    ix = month_index(month)
    return df.withColumn("step", ix - F.lag(ix).over(W.partitionBy(*keys).orderBy(month)))


def missing_months(df: DataFrame, keys: Keys, month: str = "month") -> DataFrame:
    """The months between the first and the last of each series that have no row."""
    span = df.groupBy(*keys).agg(F.explode(F.sequence(F.min(month), F.max(month), F.expr("interval 1 month"))).alias(month))
    return span.join(df.select(*keys, month), [*keys, month], "left_anti")


def concatenate(parts: Sequence[DataFrame], keys: Keys, month: str = "month") -> DataFrame:
    """Appends time blocks; ``in_order`` tells if months of a series only grow."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ix = month_index(month)
    return out.withColumn("in_order", F.coalesce(ix > F.lag(ix).over(W.partitionBy(*keys).orderBy(month)), F.lit(True)))


def fill_down(df: DataFrame, keys: Keys, order: str, value: str = "value") -> DataFrame:
    """Missing values take the nearest present one before them."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("filled", F.last(value, ignorenulls=True).over(w))


def extreme_level(df: DataFrame, keys: Keys, level: str, value: str = "value", smallest: bool = False) -> DataFrame:
    """The level of the largest (smallest) value, the first of equal ones; the first level if none is present."""
    v = F.col(value)
    rank = F.struct(v.isNotNull().alias("a"), (-v if smallest else v).alias("b"), (-F.col(level)).alias("c"))
    return df.groupBy(*keys).agg(F.max_by(level, rank).alias("level"), F.max_by(value, rank).alias("extreme"))


def core_levels(df: DataFrame, lat: str, level: str, value: str = "value", window: int = 5) -> DataFrame:
    """Level of the maximum per latitude, smoothed along latitude, rounded half to even and kept in range."""
    span = df.agg(F.min(level).alias("lo"), F.max(level).alias("hi"))
    core = centred_smooth(extreme_level(df, [lat], level, value).withColumn("__all", F.lit(1)), ["__all"], lat, "level", window)
    rounded = F.bround("smooth").cast("int")
    return core.crossJoin(F.broadcast(span)).select(lat, "level", F.greatest("lo", F.least("hi", rounded)).cast("int").alias("core"))


def gradient(df: DataFrame, keys: Keys, order: str, value: str = "value", periodic: bool = False) -> DataFrame:
    """Central differences, one-sided at the ends, or periodic."""
    w = W.partitionBy(*keys).orderBy(order)
    before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    if periodic:
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        first, last = F.first(value).over(whole), F.last(value).over(whole)
        n, r = F.count(F.lit(1)).over(W.partitionBy(*keys)), F.row_number().over(w)
        return df.withColumn("gradient", (F.when(r == n, first).otherwise(after) - F.when(r == 1, last).otherwise(before)) / 2.0)
    r, n = F.row_number().over(w), F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn("gradient", F.when(r == 1, after - v).when(r == n, v - before).otherwise((after - before) / 2.0))


def rank_within(df: DataFrame, keys: Keys, order: Sequence, name: str = "rank") -> DataFrame:
    """1, 2, ... in the given order."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def trim_edges(df: DataFrame, keys: Keys, order: str, n: int = 12) -> DataFrame:
    """Drops the first and last n rows of each series."""
    out = rank_within(df, keys, [order], "__r").withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return out.where(F.col("__r").between(n + 1, F.col("__n") - n)).drop("__r", "__n")


def month_axis(df: DataFrame, start: str, stop: str, day: int = 1) -> DataFrame:
    """T5: the months from start to stop, on a given day of the month; ``df`` is a single row."""
    months = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(stop).cast("date"), F.expr("interval 1 month")))
    return df.select(months.alias("month")).withColumn("at", F.date_add("month", day - 1))


def interpolate(df: DataFrame, at: DataFrame, keys: Keys, x: str, y: str = "value", clamp: bool = False) -> DataFrame:
    """Values at the points of ``at`` (keys and ``x``) on straight lines between the series' points.

    Outside the series: null, or its end value if ``clamp``.  One sort by (keys, x) finds both neighbours.
    """
    known = df.where(F.col(y).isNotNull()).groupBy(*keys, x).agg(F.avg(y).alias("__y")).withColumn("__q", F.lit(0))
    asked = at.select(*keys, x).distinct().withColumn("__y", F.lit(None).cast("double")).withColumn("__q", F.lit(1))
    p = F.struct(F.col(x).alias("x"), F.col("__y").alias("y"))
    point = F.when(F.col("__q") == 0, p)
    w = W.partitionBy(*keys).orderBy(x, "__q")
    down = W.partitionBy(*keys).orderBy(F.col(x).desc(), F.col("__q"))
    both = known.unionByName(asked).withColumn("a", F.last(point, True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    both = both.withColumn("b", F.last(point, True).over(down.rowsBetween(W.unboundedPreceding, 0)))
    a, b = F.col("a"), F.col("b")
    line = F.when(a.x == b.x, a.y).otherwise(a.y + (b.y - a.y) * (F.col(x) - a.x) / F.nullif(b.x - a.x, F.lit(0)))
    value = F.when(a.isNotNull() & b.isNotNull(), line)
    if clamp:
        value = F.coalesce(value, a.y, b.y)
    return both.where("__q = 1").select(*keys, x, value.alias(y))


def reflect_pad(df: DataFrame, keys: Keys, ix: str, n: int, value: str = "value") -> DataFrame:
    """n mirrored samples before and after each series; the end samples are not repeated."""
    w = W.partitionBy(*keys)
    ends = df.select(*keys, ix, value, F.min(ix).over(w).alias("lo"), F.max(ix).over(w).alias("hi"))
    before = ends.where(F.col(ix).between(F.col("lo") + 1, F.col("lo") + n)).select(*keys, (2 * F.col("lo") - F.col(ix)).alias(ix), value)
    after = ends.where(F.col(ix).between(F.col("hi") - n, F.col("hi") - 1)).select(*keys, (2 * F.col("hi") - F.col(ix)).alias(ix), value)
    return df.select(*keys, ix, value).unionByName(before).unionByName(after)


def mask_incomplete(df: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """series with a missing value are missing throughout."""
    w = W.partitionBy(*keys)
    return df.withColumn(value, F.when(F.count(value).over(w) == F.count(F.lit(1)).over(w), F.col(value)))


def flatten_valid(df: DataFrame, t: str, cell: Keys, value: str = "value") -> DataFrame:
    """P10: cells without missing values, numbered in order from 0 (``out_ix``)."""
    valid = df.groupBy(*cell).agg((F.count(value) == F.count(F.lit(1))).alias("ok")).where("ok").select(*cell)
    # A plane has as many cells as its axes allow, not as many as rows.
    numbered = valid.withColumn("out_ix", (F.row_number().over(W.orderBy(*cell)) - 1).cast("long"))
    return df.join(numbered, list(cell)).select(t, *cell, "out_ix", value)


def unflatten(flat: DataFrame, plane: DataFrame, t: str, cell: Keys, value: str = "value") -> DataFrame:
    """P10: values back on the whole plane; cells that were left out are null."""
    return plane.select(t, *cell).join(flat.select(t, *cell, value), [t, *cell], "left")


def cell_edges(axis: DataFrame, x: str) -> DataFrame:
    """Lower and upper edges of axis cells, halfway to the neighbours."""
    w = W.orderBy(x)
    a, b, v = F.lag(x).over(w), F.lead(x).over(w), F.col(x)
    return axis.select(x, F.coalesce((a + v) / 2.0, v - (b - v) / 2.0).alias("low"), F.coalesce((v + b) / 2.0, v + (v - a) / 2.0).alias("high"))


def rebuild_month(df: DataFrame, ix: str = "month_ix") -> DataFrame:
    return df.withColumn("month", month_from_index(ix))
