"""Byte-balanced sharding by global prefix sums of sizes.

Law ``bytes``: documents in order of doc_id (nulls first) form one long line of bytes; the line is cut at equal
targets, so shards are contiguous and their sizes differ by no more than about one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

SHARDS = 24
#: Bytes that a record takes besides its text.
OVERHEAD = 8


def assign_shards(docs: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Puts every document into one of ``shards`` contiguous shards of nearly equal bytes.

    Args: docs with ``doc_id`` and ``text``; ``carry`` names further columns to keep, which move with the rows: the text too.
    Returns: doc_id, size, text_crc32, shard, slot and the carried columns, one row per input row.

    Defined cases: a null text has no bytes (size 8, CRC 0 as for an empty text); null doc_ids come first; repeated rows
    are rows of their own with slots of their own; ties in doc_id are ordered by size, then CRC; an empty table gives no
    rows; further input columns are left out unless carried.  A document is placed by the middle of its bytes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        *[F.col(c) for c in carry if c not in ("doc_id", "size", "text_crc32", "shard", "slot")],
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()]
    # Rows are moved and written once, in order: a row's number in its partition is its place, and a last, unique key splits
    # any group of equal ones.  Everything after is worked out from places and sizes.
    line = narrow.withColumn("__uid", F.monotonically_increasing_id()).repartitionByRange(*order, "__uid").sortWithinPartitions(*order, "__uid")
    line = saved(line.drop("__uid").withColumn("__at", F.monotonically_increasing_id()), "shards")
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = line.select("__at", "size", part.alias("__part"))
    before, whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = sizes.groupBy("__part").agg(F.count("*").alias("n"), F.sum("size").alias("s"))  # a row per partition
    totals = totals.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__rows"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__bytes"), F.sum("s").over(whole).alias("__all"))
    run = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("__run", F.coalesce(F.sum("size").over(run), F.lit(0))).join(F.broadcast(totals), "__part")
    placed = placed.withColumn("shard", F.expr(f"cast((2 * (__bytes + __run) + size) * {shards} div (2 * __all) as int)"))
    first = placed.groupBy("shard").agg(F.min("__at").alias("at"), F.min(F.col("__rows") + inside).alias("row"))  # as many rows as shards
    first = first.agg(F.array_sort(F.collect_list(F.struct("at", "row", "shard"))).alias("__first"))
    told = line.withColumn("__part", part).join(F.broadcast(totals.select("__part", "__rows")), "__part").crossJoin(F.broadcast(first))
    told = told.withColumn("__own", F.element_at(F.filter("__first", lambda f: f["at"] <= F.col("__at")), -1))
    return told.select(*narrow.columns, F.col("__own.shard").alias("shard"), (F.col("__rows") + inside - F.col("__own.row")).cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op4_sharding": op4_sharding}
#: CRC-32 is not in DuckDB; the tests hold the query against a brute-force version.
ORACLES: dict[str, str] = {}
