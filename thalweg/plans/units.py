"""Queries of single operators: sources and sinks, filters and masks, axes, validators."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import checks as K
from ..operators import geometry as G
from ..operators import relevance as L
from ..operators import tables as U
from ..operators import trends as R
from ..operators import windows as W
from ..operators.iterate import materialised, shared_folder
from ..operators.learning import network_shapes, unpacked, predict, ensemble_mean
from ..sources import readers as S
from . import panels as P
from .register import query, rd, rounded

# -- aggregates and windows --------------------------------------------------------------------------------------------


@query(
    ", mb AS (SELECT DISTINCT lat_ix, lev, unnest([lev % 3, 3 + lat_ix % 2]) AS region, lat_ix + 0.5e0 * lev AS w FROM plane) SELECT region, month, round(sum(value * w) / nullif(sum(CASE WHEN value IS NOT NULL THEN w END), 0), 4) AS value FROM holed JOIN mb USING (lat_ix, lev) GROUP BY 1, 2",
    P.HOLED,
)
def area_mean(spark, d):
    """Regions that share cells: weighted means over the cells that have a value."""
    plane = P.holed(P.plane(spark, d))
    member = plane.select("lat_ix", "lev", F.explode(F.array(F.col("lev") % 3, F.lit(3) + F.col("lat_ix") % 2)).alias("region"), (F.col("lat_ix") + 0.5 * F.col("lev")).alias("w")).distinct()
    return rounded(A.area_mean(plane, member, ["lat_ix", "lev"], ["region"], "month"), "value")


@query("SELECT j, round(sum(CASE WHEN NOT land THEN v * cos(radians(lat)) END) / sum(CASE WHEN NOT land THEN cos(radians(lat)) END), 6) AS value FROM cells GROUP BY 1", P.CELLS)
def cosine_mean(spark, d):
    cells = S.masked(P.cells(spark, d), F.col("land"), "v")
    return cells.groupBy("j").agg(rd(A.weighted_mean("v", A.cosine_weight("lat")), 6).alias("value"))


@query("SELECT lat_ix, lev, round(avg(CASE WHEN month BETWEEN DATE '1996-01-01' AND DATE '1997-12-01' THEN value END), 4) AS mean FROM plane GROUP BY 1, 2", P.PLANE)
def period_mean(spark, d):
    return rounded(A.period_mean(P.plane(spark, d), ["lat_ix", "lev"], F.col("month").between("1996-01-01", "1997-12-01")), "mean")


@query(
    ", m AS (SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS month, avg(value) AS value FROM ev WHERE event_id % 3 = 0 GROUP BY 1, 2), s AS (SELECT user_id, CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM m GROUP BY 1)"
    " SELECT s.user_id, s.month, round(m.value, 4) AS value FROM s LEFT JOIN m ON m.user_id = s.user_id AND m.month = s.month",
    P.EVENTS,
)
def resample_months(spark, d):
    return rounded(A.resample_months(P.irregular(spark, d).where("event_id % 3 = 0"), ["user_id"], "ts"), "value")


@query(", v AS (SELECT lev, realization, var_pop(value) AS v FROM members GROUP BY 1, 2) SELECT lev, round(sqrt(avg(v)), 4) AS rms FROM v GROUP BY 1", P.MEMBERS)
def rms_spread(spark, d):
    rows = P.members(spark, d).groupBy("lev", "realization").agg(F.var_pop("value").alias("v"))
    return rounded(A.rms(rows, ["lev"], "v"), "rms")


@query("SELECT series, min(series) OVER (PARTITION BY v) AS pattern FROM (SELECT s_suppkey AS series, list(m ORDER BY m) AS v FROM (SELECT s_suppkey, unnest([s_nationkey % 4, 10 + s_suppkey % 3]) AS m FROM supplier) GROUP BY 1)")
def identical_series(spark, d):
    s = P.load(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").alias("series"), F.posexplode(F.array(F.col("s_nationkey") % 4, 10 + F.col("s_suppkey") % 3)).alias("t", "value"))
    return A.identical_series(rows, "series", "t")


_EDGES = "lag(value) OVER w AS a, lead(value) OVER w AS b, first_value(value) OVER o AS f, last_value(value) OVER o AS l"


@query(
    f", x AS (SELECT *, {_EDGES} FROM levels WINDOW w AS (PARTITION BY lev ORDER BY month_ix), o AS (PARTITION BY lev ORDER BY month_ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    " SELECT lev, month_ix, round(CASE WHEN a IS NULL THEN b - value WHEN b IS NULL THEN value - a ELSE (b - a) / 2 END, 4) AS gradient, round((coalesce(b, f) - coalesce(a, l)) / 2, 4) AS around FROM x",
    P.LEVELS,
)
def finite_differences(spark, d):
    rows = W.gradient(P.levels(spark, d), ["lev"], "month_ix")
    around = W.gradient(P.levels(spark, d), ["lev"], "month_ix", periodic=True).select("lev", "month_ix", F.col("gradient").alias("around"))
    return rounded(rows.select("lev", "month_ix", "gradient").join(around, ["lev", "month_ix"]), "gradient", "around")


@query(", a AS (SELECT series, month, true AS ok FROM series WHERE month_ix < 330 UNION ALL SELECT series, month, true FROM series WHERE month_ix >= 325) SELECT series, month, coalesce(month > lag(month) OVER (PARTITION BY series ORDER BY month), true) AS in_order FROM a", P.SERIES)
def concatenated(spark, d):
    """Two blocks that overlap: months that come twice are told."""
    s = P.series(spark, d).select("series", "month", "month_ix")
    return W.concatenate([s.where("month_ix < 330"), s.where("month_ix >= 325")], ["series"]).select("series", "month", "in_order")


@query("SELECT s.month, CAST(s.month + 15 AS DATE) AS at, count(l.series) AS n FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1998-12-01', INTERVAL 1 MONTH)) AS DATE) AS month) s LEFT JOIN series l ON l.month = s.month GROUP BY 1, 2", P.SERIES)
def month_axis(spark, d):
    """The 16th of every month, and how many series have that month."""
    axis = W.month_axis(spark.range(1), "1996-01-01", "1998-12-01", 16)
    return axis.join(P.series(spark, d).select("month", "series"), "month", "left").groupBy("month", "at").agg(F.count("series").alias("n"))


@query("SELECT x, coalesce((a + x) / 2e0, x - (b - x) / 2e0) AS low, coalesce((x + b) / 2e0, x + (x - a) / 2e0) AS high FROM (SELECT x, lag(x) OVER (ORDER BY x) AS a, lead(x) OVER (ORDER BY x) AS b FROM (SELECT DISTINCT lat AS x FROM cells))", P.CELLS)
def cell_edges(spark, d):
    return W.cell_edges(P.cells(spark, d).select(F.col("lat").alias("x")).distinct(), "x")


# -- masks and filters of rows -----------------------------------------------------------------------------------------


@query("SELECT cell, CASE WHEN lat >= -75 AND lat <= 64.5e0 THEN v END AS banded, CASE WHEN land THEN NULL ELSE v END AS wet FROM cells", P.CELLS)
def band_mask(spark, d):
    """Values outside the band of latitudes are missing; so are those of land."""
    cells = P.cells(spark, d)
    return S.masked(cells, (F.col("lat") < -75) | (F.col("lat") > 64.5), "v").select("cell", F.col("v").alias("banded")).join(S.masked(cells, F.col("land"), "v").select("cell", F.col("v").alias("wet")), "cell")


@query("SELECT lat_ix, lev, month FROM plane WHERE (lat_ix, lev) IN (SELECT DISTINCT l_linenumber % 6, 1 + l_suppkey % 4 FROM lineitem WHERE l_quantity > 45) AND month >= DATE '1997-04-01'", P.PLANE)
def domain_and_start(spark, d):
    """Cells of a domain (a dimension) from a first month on."""
    dim = P.load(spark, d, "lineitem").where("l_quantity > 45").select((F.col("l_linenumber") % 6).alias("lat_ix"), (1 + F.col("l_suppkey") % 4).alias("lev")).distinct()
    return P.plane(spark, d).where(F.col("month") >= "1997-04-01").join(dim, ["lat_ix", "lev"], "left_semi").select("lat_ix", "lev", "month")


@query("SELECT series, count(DISTINCT month) AS months, count(DISTINCT month) = 72 AS complete FROM series WHERE month BETWEEN DATE '1995-01-01' AND DATE '2000-12-01' GROUP BY 1", P.SERIES)
def complete_period(spark, d):
    """January of the first to December of the last year of a baseline: all 72 months have to be there."""
    rows = P.series(spark, d).where(F.col("month").between("1995-01-01", "2000-12-01"))
    return rows.groupBy("series").agg(F.countDistinct("month").alias("months")).withColumn("complete", F.col("months") == 72)


@query("SELECT p_partkey AS k, p_size * 10e0 AS level, CASE WHEN p_partkey % 3 = 0 THEN 'Pa' WHEN p_partkey % 3 = 1 THEN 'hPa' ELSE 'MBAR' END AS unit, CASE WHEN p_partkey % 3 = 0 THEN p_size * 10e0 ELSE p_size * 1000e0 END AS pascal FROM part")
def pressure_levels(spark, d):
    k = F.col("p_partkey")
    rows = P.load(spark, d, "part").select(k.alias("k"), (F.col("p_size") * 10.0).alias("level"), F.when(k % 3 == 0, "Pa").when(k % 3 == 1, "hPa").otherwise("MBAR").alias("unit"))
    return rows.withColumn("pascal", C.pressure_in_pascal("level", "unit"))


@query("SELECT g, lev, CASE WHEN min(x) OVER (PARTITION BY g) > 1000 THEN x - 1000 ELSE x END AS sigma, CASE WHEN max(x) OVER (PARTITION BY g) < 1000 THEN x + 1000 ELSE x END AS density FROM (SELECT DISTINCT l_suppkey % 2 AS g, l_linenumber AS lev, l_linenumber * 5e0 + CASE WHEN l_suppkey % 2 = 0 THEN 1000.5e0 ELSE 0.5e0 END AS x FROM lineitem)")
def density_axis(spark, d):
    """Density axes with and without their thousand, as either."""
    k = F.col("l_suppkey") % 2
    axis = P.load(spark, d, "lineitem").select(k.alias("g"), F.col("l_linenumber").alias("lev"), (F.col("l_linenumber") * 5.0 + F.when(k == 0, 1000.5).otherwise(0.5)).alias("x")).distinct()
    sigma = U.sigma_axis(axis, ["g"], "x").select("g", "lev", F.col("x").alias("sigma"))
    return sigma.join(U.sigma_axis(axis, ["g"], "x", absolute=True).select("g", "lev", F.col("x").alias("density")), ["g", "lev"])


@query("SELECT lat_ix, lev, avg(value - 38000) < 0 AS negative, avg(value - 38000) < 0 AND stddev_pop(value) > 6000 AS variable, CASE WHEN stddev_pop(value) >= 6000 THEN round(avg(value), 3) END AS shown FROM plane GROUP BY 1, 2", P.PLANE)
def negative_cells(spark, d):
    """Cells with a negative mean, those of them that vary, and means that are hidden where nothing varies."""
    rows = P.plane(spark, d).withColumn("value", F.col("value") - 38000)
    out = U.negative_cells(rows, ["lat_ix", "lev"], 6000.0)
    return out.select("lat_ix", "lev", "negative", "variable", rd(F.col("shown") + 38000, 3).alias("shown"))


@query(", s AS (SELECT lev, realization, count(value) = count(*) AS ok, stddev_pop(CASE WHEN lev = 2 THEN 5e0 ELSE value END) > 0 AS varies FROM members GROUP BY 1, 2) SELECT lev, realization, ok AND realization <> 3 AND varies AS testable FROM s", P.MEMBERS)
def testable_cells(spark, d):
    rows = P.members(spark, d).withColumn("value", F.when(F.col("lev") == 2, 5.0).otherwise(F.col("value")))
    p = rows.groupBy("lev", "realization").agg(F.avg("value").alias("m")).select("lev", "realization", F.when(F.col("realization") != 3, F.lit(0.01)).alias("p"))
    return R.testable(p, ["lev", "realization"], rows).select("lev", "realization", "testable")


_GAP = "e AS (SELECT min(month_ix) AS a, max(month_ix) AS b FROM levels), sc AS (SELECT unnest(['whole', 'start +0y, end -1y', 'start +1y, end -0y', 'start +1y, end -1y', 'gap +-0', 'gap +-6', 'before the gap', 'behind the gap']) AS scenario, unnest([a, a, a + 12, a + 12, a, a, a, 335]) AS lo, unnest([b, b - 12, b, b - 12, b, b, 329, b]) AS hi, unnest([NULL, NULL, NULL, NULL, 330, 324, NULL, NULL]) AS cl, unnest([NULL, NULL, NULL, NULL, 334, 340, NULL, NULL]) AS ch FROM e)"


@query("SELECT scenario, lev, round(regr_slope(value, month_ix), 5) AS slope, count(*) AS n FROM sc JOIN levels ON month_ix BETWEEN lo AND hi AND NOT coalesce(month_ix BETWEEN cl AND ch, false) GROUP BY 1, 2", P.LEVELS, _GAP)
def gap_robustness(spark, d):
    """Trends of a record trimmed at its ends, with a gap cut out and buffers around it, before and behind the gap."""
    rows = P.levels(spark, d)
    scenarios = materialised(R.gap_scenarios(rows, (330, 334), (0, 6), (0, 1)), "scenarios")
    return R.stretch_trends(rows, ["lev"], "month_ix", scenarios, "scenario").select("scenario", "lev", rd("slope", 5).alias("slope"), "n")


# -- geometry ----------------------------------------------------------------------------------------------------------


@query(
    ", q AS (SELECT i, lat, lon + 5e0 AS lon, tauu + (lead(tauu, 1, f) OVER w - tauu) * 5 / (lead(lon, 1, f_lon + 360) OVER w - lon) AS x FROM (SELECT *, first_value(tauu) OVER o AS f, first_value(lon) OVER o AS f_lon FROM regular WINDOW o AS (PARTITION BY i ORDER BY j)) WINDOW w AS (PARTITION BY i ORDER BY j)),"
    " p AS (SELECT lon, lat + 5e0 AS lat, x + (lead(x) OVER w - x) * 5 / (lead(lat) OVER w - lat) AS value FROM q WINDOW w AS (PARTITION BY lon ORDER BY lat)) SELECT lon, lat, round(value, 6) AS value FROM p WHERE lat < 70",
    P.REGULAR,
)
def colocated(spark, d):
    """A staggered grid: halfway between columns, round the globe, then halfway between rows."""
    grid = P.regular(spark, d)
    lons, lats = grid.select((F.col("lon") + 5.0).alias("lon")).distinct(), grid.where("lat < 70").select((F.col("lat") + 5.0).alias("lat")).distinct()
    out = G.colocate(grid.withColumn("value", F.col("tauu")), lons, lats, [])
    return rounded(out.select("lon", "lat", "value"), "value", places=6)


@query(
    ", o AS (SELECT DISTINCT i, j FROM cells WHERE NOT land), u AS (SELECT i, j, min(lon) AS lon, min(lat) AS lat FROM cells GROUP BY 1, 2), pt AS (SELECT c_custkey AS k, CAST(-60 + c_custkey % 40 AS DOUBLE) AS plon, CAST(c_custkey % 7 * 9 AS DOUBLE) AS plat FROM customer WHERE c_custkey % 5 = 0),"
    " n AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY k ORDER BY (plon - lon) * (plon - lon) + (plat - lat) * (plat - lat), i, j) AS r FROM pt, u) WHERE r = 1) SELECT i, j FROM o EXCEPT SELECT i, j FROM n",
    P.CELLS,
)
def block_line(spark, d):
    """Open cells less those along a barrier."""
    cells, k = P.cells(spark, d), F.col("c_custkey")
    grid = cells.groupBy("i", "j").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    barrier = P.load(spark, d, "customer").where("c_custkey % 5 = 0").select(k.alias("k"), (-60 + k % 40).cast("double").alias("plon"), (k % 7 * 9).cast("double").alias("plat"))
    return G.block_line(cells.where("NOT land").select("i", "j").distinct(), grid, barrier, "k")


@query(
    ", o AS (SELECT i, j, max(c) AS told FROM (SELECT CAST(c_custkey * 37 % 360 AS INTEGER) AS i, CAST(c_custkey * 53 % 150 AS INTEGER) AS j, CAST(3 + c_nationkey % 2 AS INTEGER) AS c FROM customer WHERE c_custkey % 4 = 0) GROUP BY 1, 2)"
    " SELECT cell, coalesce(told, CASE WHEN lat < -35 THEN 3 WHEN CAST(a AS INTEGER) + CAST(p AS INTEGER) = 1 THEN CASE WHEN p THEN 2 ELSE 1 END ELSE 0 END) AS basin_id FROM (SELECT cell, i, j, lat, lon < 20 AND lon > -100 AS a, lon < -70 OR lon > 120 AS p FROM cells) LEFT JOIN o USING (i, j)",
    P.CELLS,
)
def basin_overrides(spark, d):
    """Basins of cells, where a list of cells along the sectors' borders has the last word."""
    lon, k = F.col("lon"), F.col("c_custkey")
    cells = P.cells(spark, d).select("cell", "i", "j", "lat", ((lon < 20) & (lon > -100)).alias("atlantic"), ((lon < -70) | (lon > 120)).alias("pacific"))
    told = P.load(spark, d, "customer").where("c_custkey % 4 = 0").select((k * 37 % 360).cast("int").alias("i"), (k * 53 % 150).cast("int").alias("j"), (3 + F.col("c_nationkey") % 2).cast("int").alias("basin_id"))
    return G.basin_label(cells, {"atlantic": 1, "pacific": 2}, overrides=told).withColumn("basin_id", F.when((F.col("lat") < -35) & (F.col("basin_id") == 0), 3).otherwise(F.col("basin_id"))).select("cell", "basin_id")


# -- sources and sinks -------------------------------------------------------------------------------------------------


@query("SELECT vec_id % 4 AS part, vec_id, CAST(i AS INTEGER) AS i, CASE WHEN i % 9 <> 4 THEN CAST(v AS DOUBLE) END AS value FROM (SELECT vec_id, unnest(generate_series(0, 63)) AS i, unnest(embedding) AS v FROM embeddings)")
def npz_round_trip(spark, d):
    """Embeddings in NPZ files, one for each part, an array a vector, by the sink and read back by the source; NaN is null."""
    S.register_sources(spark)
    folder = f"{shared_folder(spark)}/thalweg/npz-{np.random.default_rng().integers(1 << 62)}"
    part = F.concat(F.lit("p"), (F.col("vec_id") % 4).cast("string"))
    holes = F.transform("embedding", lambda v, i: F.when(i % 9 != 4, v.cast("double")).otherwise(float("nan")))
    rows = P.load(spark, d, "embeddings").select(part.alias("file"), F.col("vec_id").cast("string").alias("key"), F.array(F.size("embedding")).alias("shape"), holes.alias("values"))
    rows.repartition("file").sortWithinPartitions("file", "key").write.format("npz").mode("append").option("path", folder).option("provenance", '{"source": "embeddings"}').save()
    read = spark.read.format("npz").option("path", f"{folder}/*.npz").load()
    part = F.regexp_extract("file", r"/p(\d+)\.npz$", 1).cast("long")
    return read.select(part.alias("part"), F.col("key").cast("long").alias("vec_id"), F.col("index")[0].alias("i"), "value")


@query(
    ", g AS (SELECT lev, realization, month_ix - 300 AS t, truth, pred FROM members WHERE month_ix BETWEEN 300 AND 381)"
    " SELECT CAST(t AS INTEGER) AS t, CAST(realization AS INTEGER) AS realization, round(sum(truth), 4) AS truth, round(sum(truth + pred), 4) AS both FROM g WHERE t >= 12 AND t < 60 AND lev = 3 GROUP BY 1, 2",
    P.MEMBERS,
)
def npz_slabs(spark, d):
    """Months x levels x members in an NPZ file, two arrays of it added while they are read; the filter on array, month and
    level reads the bytes of that slab alone."""
    S.register_sources(spark)
    folder = f"{shared_folder(spark)}/thalweg/npz-{np.random.default_rng().integers(1 << 62)}"
    m = P.members(spark, d).where(F.col("month_ix").between(300, 381)).select((F.col("month_ix") - 300).alias("t"), (F.col("lev") - 1).alias("l"), "realization", "truth", "pred")
    grid = spark.range(82).withColumnRenamed("id", "t").crossJoin(spark.range(7).withColumnRenamed("id", "l")).crossJoin(spark.range(5).withColumnRenamed("id", "realization"))
    whole = grid.join(m, ["t", "l", "realization"], "left").select("t", "l", "realization", F.explode(F.create_map(F.lit("truth"), F.col("truth"), F.lit("pred"), F.col("pred"))).alias("key", "value"))
    packed = whole.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "l", "realization", F.coalesce("value", F.lit(float("nan"))).alias("v")))), lambda x: x["v"]).alias("values"))
    rows = packed.select(F.lit("members").alias("file"), "key", F.array(F.lit(82), F.lit(7), F.lit(5)).alias("shape"), "values")
    rows.coalesce(1).write.format("npz").mode("append").option("path", folder).save()
    read = spark.read.format("npz_slabs").option("path", f"{folder}/*.npz").option("sums", "both=truth+pred").option("chunk", 20).load()
    slab = read.where(F.col("key").isin("truth", "both") & (F.col("i0") >= 12) & (F.col("i0") < 60) & (F.col("i1") == 2))
    out = slab.groupBy(F.col("i0").alias("t"), F.col("i2").alias("realization")).agg(*[F.sum(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("truth", "both")])
    return rounded(out.where("truth IS NOT NULL"), "truth", "both")


@query("SELECT lev, month, round(value, 4) AS value, 'cm' AS unit, 'turnover' AS long_name, 'orders' AS source FROM levels WHERE lev IN (2, 3) AND month >= DATE '1996-01-01'", P.LEVELS)
def product_round_trip(spark, d):
    """A product with units and provenance, written by level and read again: columns and predicate reach the files."""
    path = f"{shared_folder(spark)}/thalweg/product-{np.random.default_rng().integers(1 << 62)}"
    S.write_product(P.levels(spark, d), path, ["lev"], units={"value": "cm"}, names={"value": "turnover"}, provenance={"source": "orders", "stage": "levels"})
    read = S.read_table(spark, path, ["lev", "month", "value"], F.col("lev").isin(2, 3) & (F.col("month") >= "1996-01-01"))
    told, origin = read.schema["value"].metadata, S.provenance_of(spark, path)
    return read.select("lev", "month", rd("value").alias("value"), F.lit(told["units"]).alias("unit"), F.lit(told["long_name"]).alias("long_name")).crossJoin(F.broadcast(origin.where("name = 'source'").select(F.col("value").alias("source"))))


@query("SELECT c_custkey AS k, c_nationkey AS lat, c_acctbal AS lon, CASE WHEN c_custkey % 2 = 0 THEN 1025e0 ELSE 1000e0 END AS density FROM customer")
def named_attributes(spark, d):
    """Coordinates by any of their names, and a density that free text states, which has to be the product's."""
    k = F.col("k")
    rows = P.load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nav_lat"), F.col("c_acctbal").alias("longitude"))
    rows = S.named_columns(rows, {"lat": ("latitude", "nav_lat"), "lon": ("longitude", "lon")})
    text = F.concat(F.lit("Units: cm. Water DENSITY: "), F.when(k % 2 == 0, "1025").otherwise("1000.0"), F.lit(" kg/m^3"))
    return rows.withColumn("density", K.expected_number(S.attribute_number(text, "density"), F.when(k % 2 == 0, 1025.0).otherwise(1000.0)))


@query("SELECT s_suppkey AS k, 'M' || CAST(s_nationkey % 6 AS VARCHAR) AS model, CASE WHEN s_nationkey % 6 < 4 THEN 'areacello_Ofx_M' || CAST(s_nationkey % 6 AS VARCHAR) || '_a.nc' END AS area_file FROM supplier")
def cell_area_files(spark, d):
    m = F.concat(F.lit("M"), (F.col("s_nationkey") % 6).cast("string"))
    areas = P.load(spark, d, "nation").where("n_nationkey < 4").select(F.concat(F.lit("M"), F.col("n_nationkey").cast("string")).alias("model"), F.explode(F.array(F.lit("_b.nc"), F.lit("_a.nc"))).alias("x"))
    areas = areas.select("model", F.concat(F.lit("areacello_Ofx_"), "model", "x").alias("area_file"))
    return K.by_model(P.load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), m.alias("model")), areas).select("k", "model", "area_file")


@query("SELECT ix, x, -74.5e0 + ix * 10 AS expected FROM (SELECT i AS ix, lat + CASE WHEN i % 4 = 1 THEN 0.25e0 ELSE -4.5e0 END AS x FROM (SELECT DISTINCT i, lat FROM regular)) WHERE abs(x - (-74.5e0 + ix * 10)) >= 1e-6", P.REGULAR)
def grid_check(spark, d):
    """Places of an axis that are not where the product's grid has them."""
    axis = P.regular(spark, d).select(F.col("i").alias("ix"), (F.col("lat") + F.when(F.col("i") % 4 == 1, 0.25).otherwise(-4.5)).alias("x")).distinct()
    return K.axis_offences(axis, "x", -74.5, 10.0)


@query("SELECT lev, month, realization, round(truth, 3) AS truth, round(pred, 3) AS pred, n, parts FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY lev, realization) AS n, 'r' || CAST(realization AS VARCHAR) AS parts FROM members WHERE lev = 3 WINDOW w AS (PARTITION BY lev, realization ORDER BY month)) WHERE k BETWEEN 13 AND n - 12", P.MEMBERS)
def paired_members(spark, d):
    """Truth and prediction of members at one level, a file each, paired by month and cut at both ends."""
    m = P.members(spark, d)
    path = f"{shared_folder(spark)}/thalweg/members-{np.random.default_rng().integers(1 << 62)}"
    m.select("lev", "realization", "month", "truth", "pred").write.partitionBy("realization").parquet(path)
    rows = S.read_pairs(spark, path, F.col("lev") == 3)
    out = W.trim_edges(rows.withColumn("n", F.count("*").over(W.W.partitionBy("lev", "realization"))), ["lev", "realization"], "month")
    return out.select("lev", "month", F.col("realization").cast("long").alias("realization"), rd("truth", 3).alias("truth"), rd("pred", 3).alias("pred"), "n", "parts")


# -- validators --------------------------------------------------------------------------------------------------------

_BASELINES = (
    "b AS (SELECT s_suppkey AS baseline, CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'N' ELSE 'M' END AS source_model, CASE WHEN s_suppkey % 5 = 0 THEN 2003 ELSE 2004 END AS y, s_suppkey % 3 = 0 AS rep, s_suppkey % 4 = 1 AS dry, s_suppkey % 6 AS w FROM supplier)"
)


@query(
    "SELECT baseline, offence FROM (SELECT baseline, unnest([CASE WHEN source_model IS NULL THEN 'no source model' END, CASE WHEN source_model = 'N' THEN 'other source model' END, CASE WHEN y <> 2004 THEN 'other period' END, CASE WHEN rep THEN 'repeated variable' END,"
    " CASE WHEN dry THEN 'no ocean variable' END, CASE WHEN w = 0 THEN 'no wind' END, CASE WHEN w = 1 THEN 'other wind' END, CASE WHEN w = 2 THEN 'no wind column' END, CASE WHEN w = 3 THEN 'no wind level' END]) AS offence FROM b) WHERE offence IS NOT NULL",
    _BASELINES,
)
def baseline_validity(spark, d):
    k = F.col("s_suppkey")
    wind = F.lit("ua@85000")
    variables = F.concat(F.when(k % 4 == 1, F.array(F.lit("pbo"))).otherwise(F.array(F.lit("pbo"), F.lit("zos"))), F.when(k % 3 == 0, F.array(F.lit("pbo"))).otherwise(F.array().cast("array<string>")), F.when(k % 6 == 2, F.array().cast("array<string>")).otherwise(F.array(wind)))
    rows = P.load(spark, d, "supplier").select(
        k.alias("baseline"), F.when(k % 7 == 0, None).when(k % 7 == 1, "N").otherwise("M").alias("source_model"), F.when(k % 5 == 0, 2003).otherwise(2004).alias("first_year"), F.lit(2009).alias("last_year"),
        variables.alias("variables"), F.when(k % 6 == 0, None).when(k % 6 == 1, "uas").otherwise(wind).alias("wind_source"), F.when(k % 6 != 3, 85000.0).alias("wind_level"),
    )
    return K.baseline_offences(rows, F.lit("M"), wind, (2004, 2009))


@query("SELECT record, offence FROM (SELECT c_custkey AS record, unnest([CASE WHEN c_custkey % 5 = 0 THEN 'no anomaly' END, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'other wind convention' END, CASE WHEN c_custkey % 7 = 0 THEN 'other period' END]) AS offence FROM customer) WHERE offence IS NOT NULL")
def anomaly_gate(spark, d):
    k = F.col("c_custkey")
    rows = P.load(spark, d, "customer").select(
        k.alias("record"), F.when(k % 2 == 0, "tauu").otherwise("ssh").alias("kind"), F.when(k % 10 == 0, None).otherwise(k % 5 != 0).alias("anomaly"), F.when(k % 3 == 0, "full").otherwise("anomaly_2004_2009").alias("convention"),
        F.when(k % 7 != 0, 2004).alias("first_year"), F.lit(2009).alias("last_year"),
    )
    return K.anomaly_offences(rows, (2004, 2009))


@query("SELECT s_suppkey AS k, 'f' || CAST(s_suppkey % 9 AS VARCHAR) || CASE WHEN s_suppkey < 5 THEN '' ELSE '_' || CAST(s_suppkey AS VARCHAR) END AS feature, CASE WHEN s_suppkey < 5 THEN 'ok' ELSE 'unknown' END AS state FROM supplier WHERE s_suppkey % 9 <> 0 OR s_suppkey >= 5")
def feature_mapping(spark, d):
    """Trained features and where they come from."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("f"), (k % 9).cast("string"), F.when(k < 5, "").otherwise(F.concat(F.lit("_"), k.cast("string"))))
    features = P.load(spark, d, "supplier").where((k % 9 != 0) | (k >= 5)).select(k.alias("k"), name.alias("feature"))
    known = P.load(spark, d, "region").select(F.concat(F.lit("f"), F.col("r_regionkey").cast("string")).alias("feature"), F.col("r_name").alias("source"))
    return K.feature_sources(features, known).select("k", "feature", "state")


@query(
    "SELECT key, 'left' AS side FROM (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) || '/' || l_returnflag AS key FROM lineitem WHERE l_quantity > 20 EXCEPT SELECT DISTINCT CAST(l_linenumber AS VARCHAR) || '/' || l_returnflag FROM lineitem WHERE l_linenumber < 6)"
    " UNION ALL SELECT key, 'left' FROM (SELECT CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS key FROM lineitem WHERE l_quantity > 20 EXCEPT SELECT CAST(month AS VARCHAR) FROM levels WHERE month >= DATE '1996-01-01')",
    P.LEVELS,
)
def budget_consistency(spark, d):
    """A saved budget against the registry of products and the months it should have."""
    l = P.load(spark, d, "lineitem")  # noqa: E741
    budget = l.where("l_quantity > 20").select("l_linenumber", "l_returnflag", C.month_of("l_shipdate").alias("month"))
    return K.budget_offences(budget, l.where("l_linenumber < 6"), P.levels(spark, d).where(F.col("month") >= "1996-01-01"), ["l_linenumber", "l_returnflag"])


@query(
    ", r AS (SELECT lev, lat_ix AS lat, CASE WHEN lev = 2 THEN NULL ELSE avg(value) END AS v, CASE WHEN lat_ix = 3 THEN 1999 ELSE 2004 END AS y FROM plane WHERE lev < 6 GROUP BY 1, 2), g AS (SELECT DISTINCT lev, lat_ix AS lat FROM plane WHERE lev > 1)"
    " SELECT lev, lat, 'only reference' AS offence FROM r WHERE lev <= 1 UNION ALL SELECT lev, lat, 'only grid' FROM g WHERE lev >= 6 UNION ALL SELECT lev, lat, 'other period' FROM r WHERE y <> 2004 UNION ALL SELECT lev, lat, 'no value' FROM r WHERE v IS NULL",
    P.PLANE,
)
def reference_state(spark, d):
    plane = P.plane(spark, d)
    ref = plane.where("lev < 6").groupBy("lev", F.col("lat_ix").alias("lat")).agg(F.when(F.col("lev") != 2, F.avg("value")).alias("value"), F.when(F.col("lat") == 3, 1999).otherwise(2004).alias("first_year"), F.lit(2009).alias("last_year"))
    return K.reference_offences(ref, plane.where("lev > 1").select("lev", F.col("lat_ix").alias("lat")).distinct(), (2004, 2009))


@query("SELECT fold, member, offence FROM (SELECT f AS fold, m AS member, CASE WHEN f * 5 + m IN (8, 12) THEN 'missing' END AS offence FROM (SELECT unnest(generate_series(1, 5)) AS f), (SELECT unnest(generate_series(1, 3)) AS m)) WHERE offence IS NOT NULL UNION ALL SELECT f, m, 'superfluous' FROM a WHERE m = 4 UNION ALL SELECT f, m, 'other version' FROM a WHERE f = 4",
       "a AS (SELECT DISTINCT s_suppkey % 5 + 1 AS f, m FROM supplier, (SELECT unnest(generate_series(1, 4)) AS m) WHERE (s_suppkey % 5 + 1) * 5 + m NOT IN (8, 12))")
def artifact_set(spark, d):
    """Networks that are missing, superfluous, or of an unknown version."""
    a = P.load(spark, d, "supplier").select((F.col("s_suppkey") % 5 + 1).cast("int").alias("fold"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("member")).distinct()
    found = a.where(~(F.col("fold") * 5 + F.col("member")).isin(8, 12)).withColumn("version", F.when(F.col("fold") == 4, "0.9").otherwise("1.0"))
    return K.artifact_offences(found, 5, 3, ["1.0", "1.1"]).select(F.col("fold").cast("long").alias("fold"), F.col("member").cast("long").alias("member"), "offence")


@query(
    ", x AS (SELECT series, month, month_ix - lag(month_ix) OVER (PARTITION BY series ORDER BY month) AS step, series % 10 AS k, month_ix % 9 AS q FROM series) SELECT series, month, offence FROM (SELECT series, month, unnest([CASE WHEN k = 3 AND q = 0 THEN 'value' END, CASE WHEN k = 4 AND q = 1 THEN 'error' END, CASE WHEN step <> 1 THEN 'not monthly' END]) AS offence FROM x) WHERE offence IS NOT NULL",
    P.SERIES,
)
def series_gate(spark, d):
    """Provider series: values that are not finite, negative errors, months left out."""
    k, q = F.col("series") % 10, F.col("month_ix") % 9
    rows = P.series(spark, d).withColumn("value", F.when((k == 3) & (q == 0), float("nan")).otherwise(F.col("value"))).withColumn("error", F.when((k == 4) & (q == 1), -1.0).otherwise(1.0))
    return K.series_offences(rows, ["series"])


@query(
    ", m AS (SELECT lat_ix, lev, avg(value) AS v FROM plane GROUP BY 1, 2), t AS (SELECT c_custkey AS target, c_custkey % 7 * 20 - 63e0 AS latitude, CASE WHEN c_custkey % 3 = 2 THEN c_custkey % 9 * 1e0 END AS level, CASE WHEN c_custkey % 3 = 0 THEN 'mid' ELSE 'abyssal' END AS core FROM customer),"
    " n AS (SELECT target, level, core, (SELECT l FROM (SELECT unnest(generate_series(0, 5)) AS l) ORDER BY abs(l * 20 - 60e0 - latitude), l LIMIT 1) AS lat_ix, (SELECT l FROM (SELECT unnest(generate_series(1, 7)) AS l) ORDER BY abs(l - coalesce(level, 0)), l LIMIT 1) AS near FROM t),"
    " c AS (SELECT core, lat_ix, CAST(greatest(1, least(7, round_even(CASE least(lat_ix, 5 - lat_ix, 2) WHEN 0 THEN l WHEN 1 THEN avg(l) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE avg(l) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 0))) AS BIGINT) AS lev"
    " FROM (SELECT 'mid' AS core, lat_ix, arg_max(lev, v) AS l FROM m GROUP BY 2 UNION ALL SELECT 'abyssal', lat_ix, arg_min(lev, v) FROM m GROUP BY 2) WINDOW w AS (PARTITION BY core ORDER BY lat_ix)),"
    " r AS (SELECT target, n.lat_ix, CASE WHEN level IS NOT NULL THEN near ELSE c.lev END AS lev, CASE WHEN level IS NOT NULL THEN 'explicit_cell' ELSE n.core || '_core' END AS mode FROM n JOIN c ON c.core = n.core AND c.lat_ix = n.lat_ix)"
    " SELECT target, CAST(r.lat_ix AS INTEGER) AS lat_ix, CAST(r.lev AS INTEGER) AS lev, mode, CASE WHEN r.lev < 7 THEN CAST(r.lev * 6 + r.lat_ix AS BIGINT) END AS out_ix, round(v, 3) AS baseline, CASE WHEN mode = 'mid_core' AND r.lat_ix = 0 THEN 'no core' WHEN r.lev = 7 THEN 'outside the mask' ELSE 'ok' END AS state FROM r LEFT JOIN m ON m.lat_ix = r.lat_ix AND m.lev = r.lev",
    P.PLANE,
)
def target_resolution(spark, d):
    """Targets by latitude and core, mid or abyssal, or by an explicit level, inside the trained cells."""
    k = F.col("c_custkey")
    mean = P.plane(spark, d).groupBy("lat_ix", F.col("lev").cast("int").alias("lev")).agg(F.avg("value").alias("value")).withColumn("lat", F.col("lat_ix") * 20.0 - 60.0)
    targets = P.load(spark, d, "customer").select(k.alias("target"), (k % 7 * 20 - 63.0).alias("latitude"), F.when(k % 3 == 2, (k % 9).cast("double")).alias("level"), F.when(k % 3 == 0, "mid").otherwise("abyssal").alias("core"))
    valid = mean.where("lev < 7").select("lat_ix", "lev", (F.col("lev") * 6 + F.col("lat_ix")).cast("long").alias("out_ix"))
    out = K.resolve_target(materialised(mean, "mean"), targets, "lat", "lev", valid)
    return rounded(out, "baseline", places=3)


# -- networks ----------------------------------------------------------------------------------------------------------


def _net(member: int) -> tuple:
    """A network 64 - 6 - 3 with a skip, by a rule."""
    w1 = (((np.arange(64)[:, None] * 7 + np.arange(6) * 13 + member * 5) % 11) - 5) / 20.0
    w2 = (((np.arange(6)[:, None] * 5 + np.arange(3) * 7 + member) % 7) - 3) / 5.0
    skip = (((np.arange(6)[:, None] * 3 + np.arange(3) * 5 + member) % 5) - 2) / 10.0
    return [w1, w2], [(np.arange(6) - 2) / 10.0, (np.arange(3) + 1) / 10.0], skip


_NET = """mm AS (SELECT unnest([0, 1, 2, 3]) AS me), z1 AS (SELECT sample, me, o, sum(value * ((feature * 7 + o * 13 + me * 5) % 11 - 5) / 20e0) + (o - 2) / 10e0 AS z FROM features, mm, (SELECT unnest(generate_series(0, 5)) AS o) GROUP BY 1, 2, 3),
 z2 AS (SELECT sample, me, k, sum(z / (1 + exp(-z)) * ((o * 5 + k * 7 + me) % 7 - 3) / 5e0) + (k + 1) / 10e0 AS z, sum(z * ((o * 3 + k * 5 + me) % 5 - 2) / 10e0) AS s FROM z1, (SELECT unnest(generate_series(0, 2)) AS k) GROUP BY 1, 2, 3)"""


@query(
    ", h AS (SELECT sample, me // 2 AS fold, me, o, sum((z + s) * ((k * 3 + o) % 5 - 2) / 4e0) + o / 3e0 AS y FROM z2, (SELECT unnest(generate_series(0, 3)) AS o) GROUP BY 1, 2, 3, 4), f AS (SELECT sample, fold, o, avg(y) * (2 + o + fold) + 10 * o AS v FROM h GROUP BY 1, 2, 3)"
    " SELECT sample, CAST(o AS INTEGER) AS out, round(avg(v), 6) AS value FROM f GROUP BY 1, 2",
    P.FEATURES, _NET,
)
def ensemble_forward(spark, d):
    """Two folds of two networks with swish: components undone before members are averaged, scales after, then folds."""
    out = np.arange(4)
    parts = (((np.arange(3)[:, None] * 3 + out) % 5) - 2) / 4.0
    nets = [(m // 2, m % 2, _net(m)) for m in range(4)]
    heads = {f: (parts, out / 3.0, 2.0 + out + f, 10.0 * out) for f in (0, 1)}
    return rounded(ensemble_mean(predict(P.vectors(spark, d), nets, "sample", "swish", heads), "sample"), "value", places=6).withColumn("out", F.col("out").cast("int"))


@query(
    ", hd AS (SELECT sample, me, sum((z + s) * (k + 1)) AS output, sum((k + 1) * (k + 1) / 10e0) AS b2 FROM z2 GROUP BY 1, 2),"
    " r1 AS (SELECT sample, me, o, z, sum((z / (1 + exp(-z)) * ((o * 5 + k * 7 + me) % 7 - 3) / 5e0 + z * ((o * 3 + k * 5 + me) % 5 - 2) / 10e0) * (k + 1)) AS r FROM z1, (SELECT unnest(generate_series(0, 2)) AS k) GROUP BY 1, 2, 3, 4),"
    " x AS (SELECT f.sample, me, feature // 16 AS block, sum(value * r / z * ((feature * 7 + o * 13 + me * 5) % 11 - 5) / 20e0) AS total FROM features f JOIN r1 USING (sample) GROUP BY 1, 2, 3), b1 AS (SELECT sample, me, sum(r / z * (o - 2) / 10e0) AS b1 FROM r1 GROUP BY 1, 2)"
    " SELECT sample, me AS member, CAST(block AS INTEGER) AS block, round(total, 5) AS total, round(output, 5) AS output, round(b1 + b2, 5) AS bias FROM x JOIN hd USING (sample, me) JOIN b1 USING (sample, me)",
    P.FEATURES, _NET,
)
def ensemble_relevance(spark, d):
    """Relevance of every input for each network, by block of inputs, with what biases take."""
    nets = [(m, *_net(m)) for m in range(4)]
    out = L.explain(P.vectors(spark, d), nets, "sample", [1.0, 2.0, 3.0], kind="swish")
    rows = out.select("sample", "member", "output", "bias", F.posexplode("relevance").alias("feature", "value"))
    sums = A.relevance_by_block(rows, ["sample", "member", "output", "bias"], "feature", 16)
    return rounded(sums.select("sample", "member", "block", "total", "output", "bias"), "total", "output", "bias", places=5)


_PARTS = (
    "hd AS (SELECT sample, me, sum((z + s) * (k + 1)) AS output, sum((k + 1) * (k + 1) / 10e0) AS b2 FROM z2 GROUP BY 1, 2),"
    " r1 AS (SELECT sample, me, o, z, sum((z / (1 + exp(-z)) * ((o * 5 + k * 7 + me) % 7 - 3) / 5e0 + z * ((o * 3 + k * 5 + me) % 5 - 2) / 10e0) * (k + 1)) AS r FROM z1, (SELECT unnest(generate_series(0, 2)) AS k) GROUP BY 1, 2, 3, 4),"
    " rl AS (SELECT f.sample, me, feature, sum(value * r / z * ((feature * 7 + o * 13 + me * 5) % 11 - 5) / 20e0) AS value FROM features f JOIN r1 USING (sample) GROUP BY 1, 2, 3), b1 AS (SELECT sample, me, sum(r / z * (o - 2) / 10e0) AS b1 FROM r1 GROUP BY 1, 2),"
    " pt AS (SELECT sample, me, any_value(output) AS output, sum(value) + any_value(b1) + any_value(b2) AS parts, sum(value) FILTER (feature < 32) + any_value(b1) + any_value(b2) AS half FROM rl JOIN hd USING (sample, me) JOIN b1 USING (sample, me) GROUP BY 1, 2)"
)


@query(
    ", ck AS (SELECT 'accounting' AS \"check\", parts AS a, output AS b FROM pt UNION ALL SELECT 'half of the inputs', half, output FROM pt UNION ALL SELECT 'moved rows', parts + CASE WHEN sample % 7 = 0 THEN 1e-3 ELSE 0 END, output FROM pt)"
    " SELECT \"check\", round(max(abs(a - b)), 4) AS largest, count(*) FILTER (abs(a - b) > 1e-6) AS off, max(abs(a - b)) <= 1e-6 AS ok, (SELECT count(*) FROM pt) AS n FROM ck GROUP BY 1",
    P.FEATURES, _NET, _PARTS,
)
def relevance_checks(spark, d):
    """Relevance and biases add up to the output of the forward pass; that of half the inputs does not, nor do rows that were
    moved: how far off, and how many."""
    rows, nets = P.vectors(spark, d), [(m, *_net(m)) for m in range(4)]
    add = lambda parts: F.aggregate(parts, F.col("bias"), lambda a, x: a + x)
    told = L.explain(rows, nets, "sample", [1.0, 2.0, 3.0]).select("sample", "member", add("relevance").alias("parts"), add(F.slice("relevance", 1, 32)).alias("half"))
    each = [predict(rows, [(m, 0, _net(m))], "sample").select("sample", F.col("fold").alias("member"), (F.col("prediction")[0] + 2 * F.col("prediction")[1] + 3 * F.col("prediction")[2]).alias("forward")) for m in range(4)]
    both = told.join(each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]), ["sample", "member"])
    both = both.withColumn("moved", F.col("parts") + F.when(F.col("sample") % 7 == 0, 1e-3).otherwise(0.0))
    out = K.parity(both, [], {"accounting": ("parts", "forward", 1e-6), "half of the inputs": ("half", "forward", 1e-6), "moved rows": ("moved", "forward", 1e-6)})
    return out.select("check", rd("largest").alias("largest"), "off", "ok").crossJoin(F.broadcast(both.agg(F.count("*").alias("n"))))


@query(
    ", bl AS (SELECT sample, me, CAST(feature // 16 AS INTEGER) AS block, sum(value) AS value FROM rl GROUP BY 1, 2, 3), mn AS (SELECT sample % 5 AS realization, block, avg(value) AS mean, avg(abs(value)) AS mean_abs, count(*) AS n FROM bl GROUP BY 1, 2)"
    " SELECT realization, block, round(mean, 5) AS mean, round(mean_abs, 5) AS mean_abs, n, round(mean_abs / sum(mean_abs) OVER (PARTITION BY realization), 5) AS share FROM mn",
    P.FEATURES, _NET, _PARTS,
)
def relevance_by_realization(spark, d):
    """Relevance of blocks of inputs, averaged over the samples and networks of each realization."""
    out = L.explain(P.vectors(spark, d), [(m, *_net(m)) for m in range(4)], "sample", [1.0, 2.0, 3.0])
    rows = out.select("sample", "member", F.posexplode("relevance").alias("feature", "value"))
    blocks = A.relevance_by_block(rows, ["sample", "member"], "feature", 16).select((F.col("sample") % 5).alias("realization"), "block", F.col("total").alias("value"))
    return rounded(A.realization_means(blocks, "realization", ["block"]), "mean", "mean_abs", "share", places=5)


@query(
    ", c AS (SELECT month FROM flags WHERE flag = 'A' INTERSECT SELECT month FROM flags WHERE flag = 'N' INTERSECT SELECT month FROM flags WHERE flag = 'R'), r AS (SELECT flag, month, row_number() OVER (PARTITION BY flag ORDER BY month) - 1 AS k FROM flags)"
    " SELECT month, max(CASE WHEN flag = 'A' THEN k END) AS row_0, max(CASE WHEN flag = 'N' THEN k END) AS row_1, max(CASE WHEN flag = 'R' THEN k END) AS row_2 FROM r JOIN c USING (month) GROUP BY 1",
    P.FLAGS,
)
def common_month_rows(spark, d):
    """Months that three inputs share, with the row that each has them in."""
    s = P.flags(spark, d)
    return U.common_rows([s.where(F.col("flag") == k) for k in "ANR"])


@query("SELECT c_nationkey AS series, 'days since ' || CASE WHEN c_nationkey % 3 = 0 THEN '1850-01-01' ELSE '1950-01-01' END AS units, CASE WHEN c_nationkey % 5 = 0 THEN '360_day' ELSE 'noleap' END AS calendar, count(*) AS files, c_nationkey % 5 <> 0 OR bool_and(c_custkey % 2 = 0) AS one_axis FROM customer GROUP BY 1")
def time_axis_units(spark, d):
    """Files of a series that have to state one unit of time and one calendar; in some series, some state another."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    unit = F.concat(F.lit("days since "), F.when(n % 3 == 0, "1850-01-01").otherwise("1950-01-01"))
    files = P.load(spark, d, "customer").select(n.alias("series"), unit.alias("units"), F.when((n % 5 == 0) & (k % 2 == 0), "360_day").otherwise("noleap").alias("calendar"))
    return U.time_axes(files, ["series"])


@query("SELECT c_custkey AS k, c_name AS scalar, c_mktsegment || '/' || c_name AS vector FROM customer")
def text_decode(spark, d):
    """Names as bytes with padding, alone and in a vector, back to text."""
    padded = lambda c: F.concat(F.encode(F.concat(F.lit(" "), F.col(c), F.lit("  ")), "UTF-8"), F.lit(bytes(3)))
    rows = P.load(spark, d, "customer").select(F.col("c_custkey").alias("k"), padded("c_name").alias("a"), F.array(padded("c_mktsegment"), padded("c_name"), F.lit(None).cast("binary")).alias("b"))
    return rows.select("k", C.decoded_text("a").alias("scalar"), F.array_join(C.decoded_texts("b"), "/").alias("vector"))


_CURL = (
    "fc AS (SELECT *, tauu * cos(radians(lat)) AS f, row_number() OVER (PARTITION BY i ORDER BY j) AS r, first_value(tauv) OVER wr AS v1, last_value(tauv) OVER wr AS v2 FROM regular WINDOW wr AS (PARTITION BY i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),"
    " gc AS (SELECT i, j, lat, lon, f, CASE WHEN r = 36 THEN v1 ELSE lead(tauv) OVER (PARTITION BY i ORDER BY j) END AS east, CASE WHEN r = 1 THEN v2 ELSE lag(tauv) OVER (PARTITION BY i ORDER BY j) END AS west, lag(f) OVER wc AS fa, lead(f) OVER wc AS fb FROM fc WINDOW wc AS (PARTITION BY j ORDER BY i)),"
    " cu AS (SELECT lat, lon, ((east - west) / (2 * radians(10e0)) - CASE WHEN fa IS NULL THEN (fb - f) / radians(10e0) WHEN fb IS NULL THEN (f - fa) / radians(10e0) ELSE (fb - fa) / (2 * radians(10e0)) END) / (6.371e6 * cos(radians(lat))) AS curl FROM gc)"
)


@query(
    ", bx AS (SELECT box, curl, cos(radians(lat)) AS w FROM cu JOIN boxes ON lat >= lat_b1 AND lat < lat_b2 AND (CASE WHEN across_180 THEN lon >= lon_b1 OR lon < lon_b2 ELSE lon >= lon_b1 AND lon < lon_b2 END))"
    " SELECT box, round(sum(curl * w) / sum(w) * 1e9, 4) AS curl, count(*) AS cells FROM bx WHERE curl IS NOT NULL GROUP BY 1",
    P.REGULAR, _CURL, P.BOXES.split("\nmember AS")[0].rstrip(","),
)
def curl_rows(spark, d):
    """The curl of a stress grid as rows of regions: their area-weighted means."""
    curl = G.stress_curl(P.regular(spark, d), [], 36).select("i", "j", "lat", "lon", F.col("curl").alias("v")).where("v IS NOT NULL")
    rows = G.membership(curl, P.boxes(spark, d), "box")
    return rows.groupBy("box").agg(rd(A.weighted_mean("v", A.cosine_weight("lat")) * 1e9).alias("curl"), F.count("v").alias("cells"))
