"""Tables in the shared folder, for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on a local master, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="thalweg-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialised(df: DataFrame, name: str = "step") -> DataFrame:
    """Cuts the lineage by a table in the shared folder, which survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/thalweg/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Numbers all rows from 0 in the given order: ranges are sorted apart and shifted by the counts before them."""
    ranged = df.withColumn("__uid", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("__uid"))
    kept = materialised(ranged.withColumn("__pid", F.spark_partition_id()), "ranked")
    before = W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    counts = kept.groupBy("__pid").agg(F.count("*").alias("__n"))  # a row per partition
    shift = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy("__pid").orderBy(*order, F.col("__uid"))
    out = kept.withColumn("__r", F.row_number().over(inside) - 1).join(F.broadcast(shift), "__pid")
    return out.withColumn(name, F.col("__before") + F.col("__r")).drop("__pid", "__uid", "__r", "__before")


def running_total(df: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """Adds the total of ``amount`` up to and with each row, in the given order over all rows, by ranges as in global_rank."""
    ranged = df.withColumn("__uid", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("__uid"))
    kept = materialised(ranged.withColumn("__pid", F.spark_partition_id()), "totals")
    before = W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    sums = kept.groupBy("__pid").agg(F.sum(amount).alias("__s"))  # a row per partition
    shift = sums.select("__pid", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy("__pid").orderBy(*order, F.col("__uid")).rowsBetween(W.unboundedPreceding, 0)
    out = kept.withColumn("__r", F.sum(amount).over(inside)).join(F.broadcast(shift), "__pid")
    return out.withColumn(name, F.col("__before") + F.col("__r")).drop("__pid", "__uid", "__r", "__before")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex (column v): the smallest vertex of its component, over edges (a, b) in both directions.

    Each round takes the smallest label around and then the label of that label, so that rounds grow with the logarithm of
    a component's width; minima are taken before the shuffle.
    """
    both = materialised(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialised(vertices.select("v", F.col("v").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v", "left").select("v", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        top = labels.select(F.col("v").alias("low"), F.col("label").alias("top"))
        new = materialised(lower.join(top, "low").select("v", "label", F.least("low", "top").alias("new")), "labels")
        labels = new.select("v", F.col("new").alias("label"))
        if new.where("new != label").isEmpty():
            return labels
