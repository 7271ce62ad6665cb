"""Joins on keys, set operations and validators (J5, J9-J12, U*, V*, P11, P13, P20)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import month_index
from .iterate import global_rank

Keys = Sequence[str]


def common_months(series: Sequence[DataFrame], month: str = "month") -> DataFrame:
    """The months that all have, and if they are without a gap."""
    both = reduce(lambda a, b: a.join(b, month, "left_semi"), [s.select(month).distinct() for s in series])
    ix = month_index(month)
    return both.select(month, (F.max(ix).over(W.partitionBy()) - F.min(ix).over(W.partitionBy()) + 1 == F.count(F.lit(1)).over(W.partitionBy())).alias("contiguous"))


def common_rows(series: Sequence[DataFrame], month: str = "month") -> DataFrame:
    """The months that all have, and of each input the number of the month's row in it, from 0 in order of months."""
    ranked = [global_rank(s.select(month).distinct(), [F.col(month).asc()], f"row_{k}") for k, s in enumerate(series)]
    return reduce(lambda a, b: a.join(b, month), ranked)


def time_axes(files: DataFrame, keys: Keys, units: str = "units", calendar: str = "calendar") -> DataFrame:
    """If the files of each series state one unit of time and one calendar, and which; nulls are a statement of their own."""
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    return files.groupBy(*keys).agg(
        F.min(said(units)).alias(units), F.min(said(calendar)).alias(calendar), F.count(F.lit(1)).alias("files"),
        ((F.min(said(units)) == F.max(said(units))) & (F.min(said(calendar)) == F.max(said(calendar)))).alias("one_axis"),
    )


def unmatched(a: DataFrame, b: DataFrame, keys: Keys) -> DataFrame:
    """Keys that one side has and the other lacks; none if the rows align."""
    left = a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("left"))
    right = b.select(*keys).distinct().join(a.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def common_members(df: DataFrame, member: str, var: str, n_vars: int) -> DataFrame:
    """Members that have every variable."""
    return df.groupBy(member).agg(F.countDistinct(var).alias("n")).where(F.col("n") == n_vars).select(member)


def product_registry(choices: dict[str, Sequence[str]], df: DataFrame) -> DataFrame:
    """Every combination of choices with its index (the last choice varies fastest); ``df`` is a single row."""
    out = df.select(F.lit(0).alias("combo"))
    for name, values in choices.items():
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)]))
        out = out.select("*", each.alias("c")).select((F.col("combo") * len(values) + F.col("c.i")).alias("combo"), *[c for c in out.columns if c != "combo"], F.col("c.v").alias(name))
    return out


def subtract_reference(df: DataFrame, reference: DataFrame, keys: Keys, value: str = "value", ref: str = "reference") -> DataFrame:
    """Value less the reference of its key; null where there is none."""
    return df.join(reference.select(*keys, ref), list(keys), "left").withColumn(value, F.col(value) - F.col(ref)).drop(ref)


def value_at_level(plane: DataFrame, cores: DataFrame, lat: str, level: str, core: str = "core", value: str = "value") -> DataFrame:
    """The value at each latitude's level."""
    return plane.join(cores.select(lat, F.col(core).cast("int").alias(level)), [lat, level]).withColumnRenamed(value, "strength")


def stack_features(blocks: Sequence[DataFrame], keys: Keys, ix: str, size: int, value: str = "value") -> DataFrame:
    """Blocks of features one after the other: feature = block * size + index."""
    parts = [b.select(*keys, (F.lit(k * size) + F.col(ix)).cast("long").alias("feature"), value) for k, b in enumerate(blocks)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def ablate(df: DataFrame, feature: str, inside: Column, value: str = "value") -> DataFrame:
    """P20: features of a block take their mean over time."""
    return df.withColumn(value, F.when(inside, F.avg(value).over(W.partitionBy(feature))).otherwise(F.col(value)))


def union_labelled(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Rows of all parts with their label."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(label, F.lit(k)) for k, df in parts.items()])


def set_difference(expected: DataFrame, found: DataFrame, keys: Keys) -> DataFrame:
    """U4, M9: missing and extra artifacts."""
    return unmatched(expected, found, keys).withColumn("state", F.when(F.col("side") == "left", "missing").otherwise("extra")).drop("side")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct values by their first row."""
    return df.groupBy(key).agg(F.min(order).alias("first"))


def top_variance(df: DataFrame, key: str, value: str = "value") -> DataFrame:
    """The key with the largest variance, the smallest of ties."""
    return df.groupBy(key).agg(F.var_pop(value).alias("variance")).orderBy(F.col("variance").desc_nulls_last(), key).limit(1)


def even_sample(df: DataFrame, order: Keys, m: int) -> DataFrame:
    """U8: m rows spread evenly from the first to the last (half-even rounding, repeats once)."""
    n = df.count()
    places = sorted({round(k * (n - 1) / max(1, m - 1)) for k in range(min(m, n))}) if n else []
    ranked = global_rank(df, [F.col(c).asc() for c in order], "__rank")
    return ranked.where(F.col("__rank").isin(places)).drop("__rank")


def emptier_side(df: DataFrame, x: str, y: str, x_mid: float, y_mid: float) -> DataFrame:
    """Counts of points in the upper left and upper right, and the side with fewer."""
    up = F.col(y) > y_mid
    out = df.agg(F.count_if(up & (F.col(x) < x_mid)).alias("left"), F.count_if(up & (F.col(x) >= x_mid)).alias("right"))
    return out.withColumn("side", F.when(F.col("left") <= F.col("right"), "left").otherwise("right"))


def single_valued(df: DataFrame, keys: Keys, columns: Keys) -> DataFrame:
    """V1: for each group, if each of the columns has one value."""
    return df.groupBy(*keys).agg(*[(F.countDistinct(c) == 1).alias(c) for c in columns])


def divisible(df: DataFrame, keys: Keys, n: int) -> DataFrame:
    """V4: groups whose number of rows is not a multiple of n."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") % n != 0)


def reproduces(df: DataFrame, keys: Keys, value: str, saved: str, tolerance: float) -> DataFrame:
    """V5: the largest difference between members' means and saved means, and if it is within tolerance."""
    own = df.groupBy(*keys).agg(F.abs(F.avg(value) - F.max(saved)).alias("d"))
    return own.agg(F.max("d").alias("largest"), (F.max("d") <= tolerance).alias("ok"))


def require(df: DataFrame, message: str) -> DataFrame:
    """Raises when a frame of offences has a row: the driver-side gate before a stage."""
    if not df.isEmpty():
        raise ValueError(message)
    return df


def sigma_axis(axis: DataFrame, keys: Keys, x: str, absolute: bool = False) -> DataFrame:
    """Density axes less a thousand where they are over it throughout, or (``absolute``) with it where they are below."""
    w = W.partitionBy(*keys)
    if absolute:
        return axis.withColumn(x, F.when(F.max(x).over(w) < 1000, F.col(x) + 1000).otherwise(F.col(x)))
    return axis.withColumn(x, F.when(F.min(x).over(w) > 1000, F.col(x) - 1000).otherwise(F.col(x)))


def negative_cells(df: DataFrame, keys: Keys, least: float = 0.5, value: str = "value") -> DataFrame:
    """Cells with a negative mean, those that vary by over ``least`` too, and the mean, hidden below ``least``."""
    mean, std = F.avg(value), F.stddev_pop(value)
    return df.groupBy(*keys).agg((mean < 0).alias("negative"), ((mean < 0) & (std > least)).alias("variable"), F.when(std >= least, mean).alias("shown"))


def union_experiments(parts: dict[str, DataFrame], label: str, keys: Keys, same: Keys) -> tuple[DataFrame, DataFrame]:
    """Rows of all experiments, and the rows' keys where the columns ``same`` are not alike in all of them."""
    out = union_labelled(parts, label)
    differ = out.groupBy(*keys).agg(*[F.countDistinct(c).alias(c) for c in same], F.countDistinct(label).alias("__n"))
    wrong = F.lit(False)
    for c in same:
        wrong = wrong | (F.col(c) > 1)
    return out, differ.where(wrong | (F.col("__n") < len(parts))).select(*keys)
