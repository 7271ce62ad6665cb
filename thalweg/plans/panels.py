"""Panels that the queries run on, derived from the star-schema tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import month_index, month_of
from ..operators.aggregates import weighted_mean

TABLES = "region nation customer supplier part orders lineitem events".split()


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lat() -> F.Column:
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return (flag * 2 + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)).cast("int")


def plane(spark: SparkSession, d: str) -> DataFrame:
    """(lat_ix, lev, month, month_ix, value, w): a plane of 6 x 7 cells by month."""
    rows = load(spark, d, "lineitem").select(_lat().alias("lat_ix"), F.col("l_linenumber").alias("lev"), month_of("l_shipdate").alias("month"), "l_discount", "l_extendedprice")
    out = rows.groupBy("lat_ix", "lev", "month").agg(weighted_mean("l_extendedprice", "l_discount").alias("value"))
    return out.withColumn("month_ix", month_index("month"))


_MIX = "((year(month) - 1970) * 12 + month(month) - 1)"
PLANE = f"""p0 AS (SELECT CAST((CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 2 + (CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) AS INTEGER) AS lat_ix,
  l_linenumber AS lev, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_discount * l_extendedprice) / nullif(sum(l_discount), 0) AS value FROM lineitem GROUP BY 1, 2, 3),
plane AS (SELECT *, CAST({_MIX} AS BIGINT) AS month_ix FROM p0)"""


def holed(df: DataFrame) -> DataFrame:
    """The plane with every eleventh value missing, by a rule."""
    return df.withColumn("value", F.when((F.col("month_ix") * 7 + F.col("lev") * 3 + F.col("lat_ix")) % 11 != 0, F.col("value")))


HOLED = PLANE + ", holed AS (SELECT lat_ix, lev, month, month_ix, CASE WHEN (month_ix * 7 + lev * 3 + lat_ix) % 11 <> 0 THEN value END AS value FROM plane)"


def levels(spark: SparkSession, d: str) -> DataFrame:
    """(lev, month, month_ix, value): the coarse plane, complete at every size; partial last month cut."""
    rows = load(spark, d, "lineitem").select(F.col("l_linenumber").alias("lev"), month_of("l_shipdate").alias("month"), "l_discount", "l_extendedprice")
    out = rows.groupBy("lev", "month").agg(F.try_divide(F.sum(F.col("l_discount") * F.col("l_extendedprice")), F.sum("l_discount")).alias("value"))
    out = out.where(F.col("month") < F.lit("2001-11-01").cast("date"))
    return out.withColumn("month_ix", month_index("month"))


LEVELS = f"""l0 AS (SELECT l_linenumber AS lev, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_discount * l_extendedprice) / nullif(sum(l_discount), 0) AS value FROM lineitem GROUP BY 1, 2),
levels AS (SELECT *, CAST({_MIX} AS BIGINT) AS month_ix FROM l0 WHERE month < DATE '2001-11-01')"""


def series(spark: SparkSession, d: str) -> DataFrame:
    """(series, month, month_ix, value): monthly turnover of suppliers, with gaps."""
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("series"), month_of("l_shipdate").alias("month"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return rows.groupBy("series", "month").agg(F.sum("v").alias("value")).withColumn("month_ix", month_index("month"))


SERIES = f"""s0 AS (SELECT l_suppkey AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem GROUP BY 1, 2),
series AS (SELECT *, CAST({_MIX} AS BIGINT) AS month_ix FROM s0)"""


def members(spark: SparkSession, d: str) -> DataFrame:
    """(lev, realization, month, month_ix, truth, pred, value): an ensemble of five members, truth and prediction."""
    rows = load(spark, d, "lineitem").select(F.col("l_linenumber").alias("lev"), (F.col("l_suppkey") % 5).alias("realization"), month_of("l_shipdate").alias("month"), "l_extendedprice", "l_discount", "l_quantity")
    out = rows.groupBy("lev", "realization", "month").agg(F.avg("l_extendedprice").alias("truth"), (F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + F.avg("l_quantity")).alias("pred"))
    return out.withColumn("month_ix", month_index("month")).withColumn("value", F.col("pred"))


MEMBERS = f"""m0 AS (SELECT l_linenumber AS lev, l_suppkey % 5 AS realization, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
  avg(l_extendedprice) AS truth, avg(l_extendedprice * (1 - l_discount)) + avg(l_quantity) AS pred FROM lineitem GROUP BY 1, 2, 3),
members AS (SELECT *, pred AS value, CAST({_MIX} AS BIGINT) AS month_ix FROM m0)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(cell, i, j, lon, lat, w, land, v): parts as grid cells."""
    k = F.col("p_partkey")
    lon, lat = (k * 37 % 360) - 180 + 0.5, (k * 53 % 150) - 75 + 0.5
    return load(spark, d, "part").select(
        k.alias("cell"), (k * 37 % 360).cast("int").alias("i"), (k * 53 % 150).cast("int").alias("j"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat"),
        F.col("p_retailprice").alias("w"), (F.col("p_size") < 3).alias("land"), F.col("p_size").cast("double").alias("v"),
    )


CELLS = """cells AS (SELECT p_partkey AS cell, CAST(p_partkey * 37 % 360 AS INTEGER) AS i, CAST(p_partkey * 53 % 150 AS INTEGER) AS j,
  CAST((p_partkey * 37 % 360) - 180 + 0.5e0 AS DOUBLE) AS lon, CAST((p_partkey * 53 % 150) - 75 + 0.5e0 AS DOUBLE) AS lat, p_retailprice AS w, p_size < 3 AS land, CAST(p_size AS DOUBLE) AS v FROM part)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(box, bounds): a 12 x 10 degree box around each customer's place, some across 180 degrees."""
    k = F.col("c_custkey")
    west, south = ((k * 41 % 360) - 180).cast("double"), ((k * 29 % 130) - 70).cast("double")
    return load(spark, d, "customer").select(
        k.alias("box"), west.alias("lon_b1"), F.when(west + 12 > 180, west - 348).otherwise(west + 12).alias("lon_b2"), south.alias("lat_b1"), (south + 10).alias("lat_b2"), (west + 12 > 180).alias("across_180")
    )


BOXES = """b0 AS (SELECT c_custkey AS box, CAST((c_custkey * 41 % 360) - 180 AS DOUBLE) AS lon_b1, CAST((c_custkey * 29 % 130) - 70 AS DOUBLE) AS lat_b1 FROM customer),
boxes AS (SELECT box, lon_b1, CASE WHEN lon_b1 + 12 > 180 THEN lon_b1 - 348 ELSE lon_b1 + 12 END AS lon_b2, lat_b1, lat_b1 + 10 AS lat_b2, lon_b1 + 12 > 180 AS across_180 FROM b0),
member AS (SELECT box, cells.* FROM cells JOIN boxes ON lat >= lat_b1 AND lat < lat_b2 AND (CASE WHEN across_180 THEN lon >= lon_b1 OR lon < lon_b2 ELSE lon >= lon_b1 AND lon < lon_b2 END))"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """(name): file names in the usual fields, from supplier keys."""
    s = F.col("s_suppkey")
    var = F.explode(F.array(F.lit("tauu"), F.lit("tauv")))
    rows = load(spark, d, "supplier").select(s, var.alias("var")).where((F.col("var") == "tauu") | (s % 3 != 0))
    return rows.select(F.concat("var", F.lit("_Amon_MODEL-"), (s % 2).cast("string"), F.lit("_historical_r"), s.cast("string"), F.lit("i1p1f1_gn_185001-201412.nc")).alias("name"))


FILES = """f0 AS (SELECT s_suppkey AS s, unnest(['tauu', 'tauv']) AS v FROM supplier),
files AS (SELECT v || '_Amon_MODEL-' || CAST(s % 2 AS VARCHAR) || '_historical_r' || CAST(s AS VARCHAR) || 'i1p1f1_gn_185001-201412.nc' AS name FROM f0 WHERE v = 'tauu' OR s % 3 <> 0)"""


def regular(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, lat, lon, tauu, tauv): a regular 15 x 36 grid with order totals on it."""
    k = F.col("o_custkey")
    rows = load(spark, d, "orders").select((k % 15).cast("int").alias("i"), (F.floor(k / 15) % 36).cast("int").alias("j"), "o_totalprice", k)
    out = rows.groupBy("i", "j").agg(F.avg("o_totalprice").alias("t"), F.avg("o_custkey").alias("c"))
    return out.select("i", "j", (F.col("i") * 10.0 - 70.0).alias("lat"), (F.col("j") * 10.0 - 180.0).alias("lon"), (F.col("t") / 1e6).alias("tauu"), (F.col("c") / 1e4).alias("tauv"))


REGULAR = """g0 AS (SELECT CAST(o_custkey % 15 AS INTEGER) AS i, CAST((o_custkey // 15) % 36 AS INTEGER) AS j, avg(o_totalprice) AS t, avg(o_custkey) AS c FROM orders GROUP BY 1, 2),
regular AS (SELECT i, j, i * 10.0e0 - 70.0e0 AS lat, j * 10.0e0 - 180.0e0 AS lon, t / 1e6 AS tauu, c / 1e4 AS tauv FROM g0)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    """(sample, feature, value): embeddings in long form."""
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("feature", "v")).select("sample", "feature", F.col("v").cast("double").alias("value"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(sample, x): embeddings as arrays of doubles."""
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


FEATURES = "features AS (SELECT vec_id AS sample, CAST(unnest(generate_series(0, 63)) AS INTEGER) AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


def irregular(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, event_id, ts, day_no, value): irregular samples with every seventh value missing."""
    e = load(spark, d, "events")
    return e.select("user_id", "event_id", "event_type", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("day_no"))


EVENTS = "ev AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day_no FROM events)"


def flags(spark: SparkSession, d: str) -> DataFrame:
    """(flag, month, month_ix, value): monthly prices by return flag, three series."""
    rows = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), month_of("l_shipdate").alias("month"), "l_extendedprice")
    return rows.groupBy("flag", "month").agg(F.avg("l_extendedprice").alias("value")).withColumn("month_ix", month_index("month"))


FLAGS = f"""fl0 AS (SELECT l_returnflag AS flag, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2),
flags AS (SELECT *, CAST({_MIX} AS BIGINT) AS month_ix FROM fl0)"""
