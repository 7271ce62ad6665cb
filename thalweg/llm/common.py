"""Pieces shared by the corpus operators: table access, shared-folder tables, distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as a Java character class body; words are runs of anything else.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; unset, one of our own on a local master only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="thalweg-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/thalweg/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """If ``df`` has no more rows than that: the check before a broadcast."""
    return rows >= 0 and df.limit(rows + 1).count() <= rows


def joined(rows: DataFrame, side: DataFrame, key: str, most: int, how: str = "inner", parts: int = 32) -> DataFrame:
    """``rows`` with the columns of ``side`` (one row a key): by a broadcast of up to ``most`` rows, else by a shuffle.

    In the shuffle every key is dealt over ``parts``, so that a key with very many rows is not one task.
    """
    if at_most(side, most):
        return rows.join(F.broadcast(side), key, how)
    dealt = side.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    own = rows.withColumn("__part", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(parts)).cast("int"))
    return own.join(dealt, [key, "__part"], how).drop("__part")


def with_prefix(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str = "prefix") -> DataFrame:
    """Adds the global rank and running totals of ``df`` in the given order, without a single-task sort.

    Rows are range-partitioned by ``order`` (a last, unique key splits any group of equal keys), each partition is
    summed, the partition totals are accumulated (one row per partition) and added to the sums inside partitions.
    Adds ``row`` (from 0) and for each ``sums`` entry ``<key>_before`` (exclusive running total) and ``<key>_all``.
    """
    uid, pid = "__uid", "__pid"
    ranged = df.select("*", F.monotonically_increasing_id().alias(uid), *[v.cast("long").alias(f"__s_{k}") for k, v in sums.items()])
    ranged = ranged.repartitionByRange(*order, F.col(uid)).withColumn(pid, F.spark_partition_id())
    kept = saved(ranged, name)
    names = [f"__s_{k}" for k in sums]
    totals = kept.groupBy(pid).agg(F.count("*").alias("__n"), *[F.sum(n).alias(n + "_t") for n in names])
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        pid,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
        *[F.coalesce(F.sum(n + "_t").over(before), F.lit(0)).alias(n + "_0") for n in names],
        *[F.sum(n + "_t").over(whole).alias(n + "_all") for n in names],
    )
    inside = Window.partitionBy(pid).orderBy(*order, F.col(uid))
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = kept.select("*", F.row_number().over(inside).alias("__r"), *[F.coalesce(F.sum(n).over(run), F.lit(0)).alias(n + "_b") for n in names])
    # One row per shuffle partition: small at every input size.
    out = ranked.join(F.broadcast(offsets), pid)
    return out.select(
        *[F.col(c) for c in df.columns],
        (F.col("__n0") + F.col("__r") - 1).alias("row"),
        *[x for k in sums for x in ((F.col(f"__s_{k}_0") + F.col(f"__s_{k}_b")).alias(f"{k}_before"), F.col(f"__s_{k}_all").alias(f"{k}_all"))],
    )
