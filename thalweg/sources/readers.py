"""Sources and sinks (S*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import realization_of, source_of
from .npz import register_sources as register_sources


def null_for_nan(df: DataFrame) -> DataFrame:
    """Missing values are nulls from the source on."""
    floating = [f for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name, metadata=f.metadata) for f in floating})


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """A Parquet scan; column list and predicate reach the files."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return null_for_nan(df.select(*columns) if columns else df)


def named_columns(df: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Renames the first present of several names (``{"lat": ("latitude", "lat")}``)."""
    for new, names in wanted.items():
        found = next((n for n in names if n in df.columns), None)
        if found is None:
            raise ValueError(f"none of {', '.join(names)}")
        df = df.withColumnRenamed(found, new)
    return df


def realization_files(names: DataFrame, name: str = "name") -> DataFrame:
    """The files of each member, in order."""
    rows = names.select(realization_of(name).alias("realization"), F.col(name).alias("n")).where("realization IS NOT NULL")
    return rows.groupBy("realization").agg(F.array_join(F.array_sort(F.collect_list("n")), ",").alias("files"), F.count("*").alias("n_files"))


def detect_source(names: DataFrame, name: str = "name") -> DataFrame:
    """The models that file names state, and if there is only one."""
    found = names.select(source_of(name).alias("source")).where("source IS NOT NULL")
    return found.agg(F.min("source").alias("source"), F.countDistinct("source").alias("n_sources"), (F.countDistinct("source") == 1).alias("ok"))


def companion(names: DataFrame, var: str, other: str, name: str = "name") -> DataFrame:
    """For each file of one variable that of another with the rest of the name alike (null: none)."""
    rest = F.expr(f"substring(`{name}`, instr(`{name}`, '_'))")
    split = names.select(F.col(name).alias("file"), F.split(name, "_")[0].alias("v"), rest.alias("rest"))
    return split.where(F.col("v") == var).join(split.where(F.col("v") == other).select("rest", F.col("file").alias("companion")), "rest", "left").select("file", "companion")


def attribute_number(text: Column, name: str) -> Column:
    """A number that a free-text attribute states for a name (``density: 1025``), in any case."""
    return F.nullif(F.regexp_extract(text, rf"(?i){name}\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def masked(df: DataFrame, mask: Column, value: str = "value") -> DataFrame:
    """Values where the mask is false."""
    return df.withColumn(value, F.when(~mask, F.col(value)))


def write_product(df: DataFrame, path: str, partitions: Sequence[str] = (), units: dict[str, str] | None = None, names: dict[str, str] | None = None, provenance: dict[str, str] | None = None) -> None:
    """Partitioned Parquet with units and long names in the columns' metadata; the committer makes it all or
    nothing.  What the product comes from stands in a table of its own beside it."""
    for c in {*(units or {}), *(names or {})}:
        df = df.withMetadata(c, {k: v[c] for k, v in (("units", units or {}), ("long_name", names or {})) if c in v})
    df.write.partitionBy(*partitions).parquet(path)
    if provenance:
        df.sparkSession.createDataFrame(sorted(provenance.items()), "name string, value string").coalesce(1).write.parquet(f"{path.rstrip('/')}.provenance")


def provenance_of(spark: SparkSession, path: str) -> DataFrame:
    """(name, value): what a product comes from."""
    return spark.read.parquet(f"{path.rstrip('/')}.provenance")


def read_pairs(spark: SparkSession, path: str, where: Column) -> DataFrame:
    """Truth and prediction of members, a partition each, with the member's name; the predicate reaches the files."""
    rows = read_table(spark, path, where=where)
    return rows.withColumn("parts", F.concat(F.lit("r"), F.col("realization").cast("string")))
