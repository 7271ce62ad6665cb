"""Whole stages as one query each: masks, baselines, inputs, targets, model-ready data, evaluation, products, trends."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import filters
from ..operators import geometry as G
from ..operators import learning as M
from ..operators import montecarlo as N
from ..operators import relevance as L
from ..operators import tables as U
from ..operators import trends as R
from ..operators import windows as W
from ..operators.iterate import materialised
from . import panels as P
from .queries import N_TIME, _boot, _filtered, _paired, _mbb, refit_sql
from .register import query, rd, rounded
from .units import _net

# -- geometry and inputs -----------------------------------------------------------------------------------------------

_OPEN = "RECURSIVE g AS (SELECT DISTINCT c_custkey % 40 AS i, (c_custkey // 40) % 25 AS j FROM customer WHERE c_nationkey % 4 <> 0), o AS (SELECT i, j FROM g WHERE i <> 20)"


@query(
    f"WITH {_OPEN}, sa AS (SELECT i, j FROM o WHERE i < 20 ORDER BY i, j LIMIT 1), sb AS (SELECT i, j FROM o WHERE i > 20 ORDER BY i DESC, j DESC LIMIT 1),"
    " ra AS (SELECT i, j FROM sa UNION SELECT o.i, o.j FROM ra JOIN o ON abs(ra.i - o.i) + abs(ra.j - o.j) = 1), rb AS (SELECT i, j FROM sb UNION SELECT o.i, o.j FROM rb JOIN o ON abs(rb.i - o.i) + abs(rb.j - o.j) = 1)"
    " SELECT g.i, g.j, CASE WHEN g.j < 4 THEN 3 WHEN (ra.i IS NULL) = (rb.i IS NULL) THEN 0 WHEN ra.i IS NOT NULL THEN 1 ELSE 2 END AS basin_id FROM g LEFT JOIN ra ON ra.i = g.i AND ra.j = g.j LEFT JOIN rb ON rb.i = g.i AND rb.j = g.j"
)
def stage_basin_masks(spark, d):
    """A barrier is cut into the open cells, two basins are filled from their seeds, cells are labelled by the one that holds them."""
    c, k = P.load(spark, d, "customer").where("c_nationkey % 4 <> 0"), F.col("c_custkey")
    grid = materialised(c.select((k % 40).alias("i"), (F.floor(k / 40) % 25).alias("j")).distinct(), "grid")
    cells = grid.withColumns({"lon": F.col("i").cast("double"), "lat": F.col("j").cast("double")})
    barrier = grid.where("i = 20").select(F.concat_ws("/", "i", "j").alias("k"), F.col("i").cast("double").alias("plon"), F.col("j").cast("double").alias("plat"))
    closed = materialised(G.block_line(grid, cells, barrier, "k"), "closed")
    west, east = closed.where("i < 20").orderBy("i", "j").first(), closed.where("i > 20").orderBy(F.col("i").desc(), F.col("j").desc()).first()
    held = {name: G.flood_fill(closed, (s["i"], s["j"]) if s else (-9, -9)).withColumn(name, F.lit(True)) for name, s in (("west", west), ("east", east))}
    both = cells.join(held["west"], ["i", "j"], "left").join(held["east"], ["i", "j"], "left").fillna(False, ["west", "east"]).withColumn("south", F.lit(False))
    return G.basin_label(both, {"west": 1, "east": 2, "south": 3}, south="south", cut=4.0).select("i", "j", "basin_id")


@query(
    ", g AS (SELECT i // 7 + 100 * (j // 11) AS region, * FROM cells), x AS (SELECT region, max(CASE WHEN lat BETWEEN -75 AND 65 AND land THEN 1 WHEN lat BETWEEN -75 AND 65 THEN 0 END) AS ld, min(lon) AS w0, max(lon) AS e0, min(lat) AS s0, max(lat) AS n0 FROM g GROUP BY 1),"
    " b AS (SELECT region, (w0 + e0) / 2 AS plon, (s0 + n0) / 2 AS plat FROM x WHERE ld = 0), u AS (SELECT i, j, min(lon) AS lon, min(lat) AS lat FROM cells GROUP BY 1, 2), l AS (SELECT i, j, lon, lat, CASE WHEN lat < -35 THEN 3 WHEN lon < 20 AND lon > -100 THEN 1 ELSE 2 END AS basin FROM u)"
    " SELECT CAST(region AS BIGINT) AS region, plon AS lon, plat AS lat, basin AS basin_id FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY (plon - lon) * (plon - lon) + (plat - lat) * (plat - lat), i, j) AS k FROM b, l) WHERE k = 1",
    P.CELLS,
)
def stage_region_geometry(spark, d):
    """Boxes of regions without land, their centres, and the basin of the cell nearest to each."""
    cells = P.cells(spark, d).withColumn("region", F.floor(F.col("i") / 7) + 100 * F.floor(F.col("j") / 11))
    boxes = A.region_boxes(cells, "region", 0.5)
    centres = boxes.select("region", ((F.col("lon_b1") + F.col("lon_b2")) / 2).alias("plon"), ((F.col("lat_b1") + F.col("lat_b2")) / 2).alias("plat"))
    grid = cells.groupBy("i", "j").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    basin = G.basin_label(grid.withColumns({"a": (F.col("lon") < 20) & (F.col("lon") > -100), "p": ~((F.col("lon") < 20) & (F.col("lon") > -100)), "s": F.lit(False)}), {"a": 1, "p": 2, "s": 3}, south="s")
    near = G.nearest_cell(centres, basin, "region", ["basin_id"]).select("region", "basin_id")
    return centres.join(near, "region").select("region", F.col("plon").alias("lon"), F.col("plat").alias("lat"), "basin_id")


_REGIONS = "mb AS (SELECT DISTINCT lev, unnest([lev % 3, 3 + lev % 2]) AS region, 1 + lev * 0.25e0 AS w FROM members)"


def _regions(rows):
    return rows.select("lev", F.explode(F.array(F.col("lev") % 3, 3 + F.col("lev") % 2)).alias("region"), (1 + F.col("lev") * 0.25).alias("w")).distinct()


@query(
    ", p AS (SELECT * FROM members WHERE month BETWEEN DATE '1995-01-01' AND DATE '2000-12-01'), f AS (SELECT realization FROM p GROUP BY 1 HAVING count(DISTINCT month) = 72),"
    " r AS (SELECT region, realization, month, sum(value * w) / sum(w) AS value FROM p JOIN mb USING (lev) WHERE realization IN (SELECT realization FROM f) GROUP BY 1, 2, 3), m AS (SELECT region, realization, avg(value) AS m FROM r GROUP BY 1, 2) SELECT region, round(avg(m), 4) AS mean, count(m) AS n_members FROM m GROUP BY 1",
    P.MEMBERS, _REGIONS,
)
def stage_baseline(spark, d):
    """Reference means: members that have all 72 months of the period, averaged over regions, then time, then members."""
    rows = P.members(spark, d).where(F.col("month").between("1995-01-01", "2000-12-01"))
    whole = rows.groupBy("realization").agg(F.countDistinct("month").alias("n")).where("n = 72").select("realization")
    rows = rows.join(F.broadcast(whole), "realization").withColumn("time", F.struct("realization", "month"))
    means = A.area_mean(rows, _regions(rows), ["lev"], ["region"], "time").select("region", "time.realization", "value")
    return rounded(A.ensemble_baseline(means, ["region"], "realization"), "mean")


@query(
    ", st AS (SELECT i, j, lat, lon, 1.22e0 * CASE WHEN sp < 7.5e0 THEN 1e-3 ELSE (0.61e0 + 0.063e0 * sp) / 1000 END * sp * u AS tx FROM (SELECT *, sqrt(u * u + v * v) AS sp FROM (SELECT i, j, lat, lon, tauu * 100 AS u, tauv * 100 AS v FROM regular))),"
    " bx AS (SELECT box, st.tx, cos(radians(lat)) AS w FROM st JOIN boxes ON lat >= lat_b1 AND lat < lat_b2 AND (CASE WHEN across_180 THEN lon >= lon_b1 OR lon < lon_b2 ELSE lon >= lon_b1 AND lon < lon_b2 END)), mn AS (SELECT box, sum(tx * w) / sum(w) AS value FROM bx GROUP BY 1)"
    " SELECT box, round((value - r) * 1000, 6) AS anomaly FROM mn LEFT JOIN (SELECT c_custkey AS k, c_acctbal / 1e6 AS r FROM customer WHERE c_custkey % 4 <> 0) ON k = box",
    P.REGULAR, P.BOXES.replace("cells AS", "cells0 AS").split("\nmember AS")[0].rstrip(","),
)
def stage_stress_inputs(spark, d):
    """Winds to stress, stress to region means, and those to anomalies of each region's reference."""
    grid = P.regular(spark, d)
    x, _ = C.wind_stress(F.col("tauu") * 100, F.col("tauv") * 100)
    rows = G.membership(grid.select("i", "j", "lat", "lon", x.alias("v")), P.boxes(spark, d), "box")
    means = rows.groupBy("box").agg(A.weighted_mean("v", A.cosine_weight("lat")).alias("value"))
    ref = P.load(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("box"), (F.col("c_acctbal") / 1e6).alias("reference"))
    return U.subtract_reference(means, ref, ["box"]).select("box", rd(F.col("value") * 1000, 6).alias("anomaly"))


@query(
    ", ax AS (SELECT unnest([1.2e0, 2.9e0, 4.6e0, 6.8e0]) AS y, unnest([1, 2, 3, 4]) AS q), nr AS (SELECT lev, q FROM (SELECT lev, q, row_number() OVER (PARTITION BY lev ORDER BY abs(lev - y), q) AS k FROM (SELECT DISTINCT lev FROM plane), ax) WHERE k = 1),"
    " v AS (SELECT lat_ix, q, month, avg(value / 1035 / 1e6) * 1e6 AS value FROM plane JOIN nr USING (lev) GROUP BY 1, 2, 3), a AS (SELECT * FROM v WHERE lat_ix >= 2), s AS (SELECT min(lat_ix) AS seam FROM a WHERE value IS NOT NULL)"
    " SELECT lat_ix, q AS level, month, round(CASE WHEN lat_ix >= seam THEN value ELSE value * 2 END, 5) AS value FROM v, s",
    P.PLANE,
)
def stage_target_regrid(spark, d):
    """Mass to volume transport, levels to the nearest of another axis, and two sectors stitched where one begins."""
    plane = P.plane(spark, d).withColumn("value", C.to_sverdrup(C.mass_to_volume("value")) * 1e6)
    axis = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("level"), F.lit(y).alias("y")) for i, y in enumerate((1.2, 2.9, 4.6, 6.8))])).alias("a")).select("a.*")
    levels = G.nearest_value(plane.select("lev", F.col("lev").cast("double").alias("x")).distinct(), axis, "lev", "x", "level", "y")
    rows = materialised(plane.join(F.broadcast(levels.select("lev", "level")), "lev").groupBy("lat_ix", "level", "month").agg(F.avg("value").alias("value")), "regrid")
    out = G.stitch_sectors(rows.where("lat_ix >= 2"), rows.withColumn("value", F.col("value") * 2), ["level", "month"], "lat_ix")
    return rounded(out.select("lat_ix", "level", "month", "value"), "value", places=5)


# -- model-ready data, training, evaluation ----------------------------------------------------------------------------

_T0 = "(SELECT min(month_ix) FROM levels)"
_MEMBER_T = f"mt AS (SELECT realization, lev, month_ix - {_T0} AS t, value - avg(value) OVER (PARTITION BY realization, month) AS value FROM members WHERE lev <= 5 AND month IN (SELECT month FROM levels))"
_WHOLE = f"mw AS (SELECT * FROM mt WHERE (realization, lev) IN (SELECT (realization, lev) FROM mt GROUP BY realization, lev HAVING count(value) = {N_TIME}))"


def _members_ready(spark, d):
    """Members in the domain, demeaned by month, series with all months only."""
    m = P.members(spark, d).where("lev <= 5").join(F.broadcast(P.levels(spark, d).select("month").distinct()), "month", "left_semi")
    rows = A.demean(m, ["realization", "month"]).select("realization", "lev", "month_ix", "value")
    whole = rows.groupBy("realization", "lev").agg(F.count("value").alias("n")).where(F.col("n") == N_TIME).select("realization", "lev")
    return rows.join(F.broadcast(whole), ["realization", "lev"])  # a row per series


@query(
    f"SELECT CAST(realization AS VARCHAR) AS label, lev, CAST(o + {_T0} AS BIGINT) AS month_ix, round(value, 4) AS value FROM fs",
    P.LEVELS, P.MEMBERS, _MEMBER_T, _WHOLE, _filtered("mw", "realization, lev", 5, 1 / 24, 48),
)
def stage_model_ready(spark, d):
    """Domain, demeaning, complete series, low-pass by member, and all members under their labels."""
    low = materialised(filters.lowpass(_members_ready(spark, d), ["realization", "lev"], "month_ix"), "ready")
    parts = {str(k): low.where(F.col("realization") == k).drop("realization") for k in range(5)}
    return rounded(U.union_labelled(parts, "label"), "value").select("label", "lev", "month_ix", "value")


@query(
    "SELECT 'a' AS experiment, l_suppkey AS k, count(*) AS n, l_suppkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 <> 0) AND l_suppkey % 4 <> 1 AS aligned FROM lineitem GROUP BY 2 UNION ALL"
    " SELECT 'b', o_custkey, count(*), o_custkey IN (SELECT l_suppkey FROM lineitem) AND o_custkey % 4 <> 1 FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 2"
)
def stage_combine(spark, d):
    """Two experiments under one roof, and which keys both have with the same metadata."""
    a = P.load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n")).withColumn("unit", F.lit("Sv"))
    b = P.load(spark, d, "orders").where("o_orderkey % 3 <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).withColumn("unit", F.when(F.col("k") % 4 == 1, "kg").otherwise("Sv"))
    rows, wrong = U.union_experiments({"a": a, "b": b}, "experiment", ["k"], ["unit"])
    return rows.join(wrong.withColumn("__w", F.lit(True)), "k", "left").select("experiment", "k", "n", F.col("__w").isNull().alias("aligned"))


@query()
def stage_train(spark, d):
    """Folds by group, components of inputs by block and of the targets, both fitted on the training fold, and networks of
    their own for each fold, on batches with dropout: the loss of each."""
    e = _paired(spark, d)
    rows = materialised(e.join(F.broadcast(M.group_folds(e, "group", 2)), "group"), "folds")  # a row per group
    out = None
    for fold in range(2):
        known = rows.where(F.col("fold") != fold)
        blocks, inputs = [(0, 4), (4, 7)], None
        for b, (lo, hi) in enumerate(blocks):
            parts = M.fit_wide_components(known.select(F.slice("x", lo + 1, hi - lo).alias("x")), share=0.95, seed=M.pca_seed(7, "x", fold, b))
            scores = M.project(rows.select("sample", F.slice("x", lo + 1, hi - lo).alias("x")), parts, "sample").withColumnRenamed("score", f"x{b}")
            inputs = scores if inputs is None else inputs.join(scores, "sample")
        targets = M.fit_wide_components(known.select(F.col("y").alias("x")), 5, seed=M.pca_seed(7, "y", fold))
        y = M.project(rows.select("sample", F.col("y").alias("x")), targets, "sample").withColumnRenamed("score", "y")
        ready = rows.select("sample", F.when(F.col("fold") == fold, 0).otherwise(1).alias("fold")).join(inputs, "sample").join(y, "sample")
        nets = M.train_ensemble(ready.select("sample", "fold", F.concat("x0", "x1").alias("x"), "y"), 1, 2, (16, 8), seed=100 * fold, epochs=6, patience=4, rate=2e-2, l2=1e-4, batch=128, dropout=0.1)
        nets = nets.select(F.lit(fold).alias("fold"), "member", "loss")
        out = nets if out is None else out.unionByName(nets)
    return out


@query(
    ", pd AS (SELECT realization, lev, month_ix - " + _T0 + " AS t, truth, pred FROM members WHERE month IN (SELECT month FROM levels)), ok AS (SELECT realization, lev FROM pd GROUP BY 1, 2 HAVING count(*) = " + str(N_TIME) + "),"
    " bt AS (SELECT pd.realization, pd.lev, t, truth AS value FROM pd JOIN ok USING (realization, lev)), " + _filtered("bt", "realization, lev", 5, 1 / 120, 240) + ", ft AS (SELECT realization, lev, o, value AS truth FROM fs),"
    " bp AS (SELECT pd.realization, pd.lev, t, pred AS value FROM pd JOIN ok USING (realization, lev)), fp AS (SELECT realization, lev, o, sum(m * value) AS pred FROM bp JOIN fm ON fm.i = bp.t GROUP BY 1, 2, 3),"
    " b AS (SELECT * FROM ft JOIN fp USING (realization, lev, o)) SELECT lev, round(corr(truth, pred), 6) AS r, round(pow(corr(truth, pred), 2), 6) AS r2, round(sqrt(avg((pred - truth) * (pred - truth))), 4) AS rmse, round(avg(pred - truth), 4) AS bias, count(*) AS n FROM b GROUP BY 1",
    P.LEVELS, P.MEMBERS,
)
def stage_evaluate(spark, d):
    """Truth and predictions low-passed by member at ten years, then their skill by level over all members."""
    m = P.members(spark, d).join(F.broadcast(P.levels(spark, d).select("month").distinct()), "month", "left_semi")
    whole = m.groupBy("realization", "lev").agg(F.count("*").alias("n")).where(F.col("n") == N_TIME).select("realization", "lev")
    m = materialised(m.join(F.broadcast(whole), ["realization", "lev"]), "pairs")
    low = [filters.lowpass(m, ["realization", "lev"], "month_ix", value=c, cutoff=1 / 120, pad=240) for c in ("truth", "pred")]
    out = R.pair_skill(low[0].join(low[1], ["realization", "lev", "month_ix"]), ["lev"])
    return out.select("lev", rd("r", 6).alias("r"), rd("r2", 6).alias("r2"), rd("rmse").alias("rmse"), rd("bias").alias("bias"), "n")


# -- observations ------------------------------------------------------------------------------------------------------


@query(
    ", sm AS (SELECT region, month, datediff('day', DATE '1995-01-01', CAST(month + 9 + CAST(month_ix % 13 AS INTEGER) AS DATE)) AS day, sum(value * w) / sum(w) AS y FROM levels JOIN mb USING (lev) WHERE month_ix % 7 <> 3 GROUP BY region, month, month_ix), ax AS (SELECT DISTINCT datediff('day', DATE '1995-01-01', CAST(month + 15 AS DATE)) AS day, month_ix FROM levels WHERE month_ix BETWEEN 303 AND 378),"
    " nb AS (SELECT region, month_ix, a.day, (SELECT max(day) FROM sm s WHERE s.region = r.region AND s.day <= a.day) AS d1, (SELECT min(day) FROM sm s WHERE s.region = r.region AND s.day >= a.day) AS d2 FROM (SELECT DISTINCT region FROM sm) r, ax a),"
    " ip AS (SELECT nb.region, month_ix, CASE WHEN d1 = d2 THEN p.y ELSE p.y + (q.y - p.y) * (nb.day - d1) / (d2 - d1) END AS v FROM nb JOIN sm p ON p.region = nb.region AND p.day = d1 JOIN sm q ON q.region = nb.region AND q.day = d2),"
    " an AS (SELECT region, month_ix, v - avg(CASE WHEN month_ix BETWEEN 312 AND 347 THEN v END) OVER (PARTITION BY region) AS v FROM ip) SELECT region, month_ix, round(v - avg(v) OVER (PARTITION BY month_ix), 4) AS value FROM an",
    P.LEVELS, _REGIONS.replace("FROM members", "FROM levels"),
)
def stage_satellite(spark, d):
    """Region means of samples at odd days, interpolated to the 16th of every month, referred to a baseline, demeaned by month."""
    rows = P.levels(spark, d).where("month_ix % 7 <> 3")
    day = F.datediff(F.date_add("month", (9 + F.col("month_ix") % 13).cast("int")), F.lit("1995-01-01").cast("date")).cast("long")
    samples = A.area_mean(rows.withColumn("day", day), _regions(P.levels(spark, d)), ["lev"], ["region"], "day")
    axis = P.levels(spark, d).where(F.col("month_ix").between(303, 378)).select("month_ix", F.datediff(F.date_add("month", 15), F.lit("1995-01-01").cast("date")).cast("long").alias("day")).distinct()
    asked = samples.select("region").distinct().crossJoin(F.broadcast(axis.select("day")))  # regions x months: the size of the result
    monthly = W.interpolate(samples, asked, ["region"], "day").join(F.broadcast(axis), "day")
    based = A.anomaly(monthly, ["region"], F.col("month_ix").between(312, 347)).select("region", "month_ix", F.col("anomaly").alias("value"))
    return rounded(A.demean(based, ["month_ix"]), "value")


@query(
    ", rs AS (SELECT l_linenumber AS lev, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_extendedprice) AS value FROM lineitem WHERE l_shipdate < DATE '2001-11-01' GROUP BY 1, 2), lt AS (SELECT lev, (year(month) - 1970) * 12 + month(month) - 1 - (SELECT min(month_ix) FROM levels) AS t, value FROM rs)," + _filtered("lt", "lev", 5, 1 / 24, 24)
    + ", ms AS (SELECT DISTINCT month, month_ix - (SELECT min(month_ix) FROM levels) AS o FROM levels) SELECT lev, round(year(month) + month(month) / 12e0, 6) AS year, round(value, 4) AS value FROM fs JOIN ms USING (o)",
    P.LEVELS,
)
def stage_in_situ(spark, d):
    """Daily series to calendar months, low-passed with a short pad, on decimal years."""
    rows = P.load(spark, d, "lineitem").where(F.col("l_shipdate") < "2001-11-01").select(F.col("l_linenumber").alias("lev"), "l_shipdate", F.col("l_extendedprice").alias("value"))
    months = A.resample_months(rows, ["lev"], "l_shipdate")
    low = filters.lowpass(months.withColumn("ix", C.month_index("month")), ["lev"], "ix", pad=24)
    return low.select("lev", rd(C.decimal_year(C.month_from_index("ix")), 6).alias("year"), rd("value").alias("value"))


@query(
    ", ab AS (SELECT a.month_ix, a.value / 1e4 AS x0, b.value / 1e4 AS x1 FROM flags a JOIN flags b USING (month_ix) WHERE a.flag = 'A' AND b.flag = 'R'), mm AS (SELECT unnest([0, 1, 2, 3]) AS me),"
    " z1 AS (SELECT month_ix, me, o, x0 * ((o * 13 + me * 5) % 11 - 5) / 20e0 + x1 * ((7 + o * 13 + me * 5) % 11 - 5) / 20e0 + (o - 2) / 10e0 AS z FROM ab, mm, (SELECT unnest(generate_series(0, 5)) AS o)),"
    " z2 AS (SELECT month_ix, me, k, sum(z / (1 + exp(-z)) * ((o * 5 + k * 7 + me) % 7 - 3) / 5e0 + z * ((o * 3 + k * 5 + me) % 5 - 2) / 10e0) + (k + 1) / 10e0 AS y FROM z1, (SELECT unnest(generate_series(0, 2)) AS k) GROUP BY 1, 2, 3)"
    " SELECT month_ix, CAST(k AS INTEGER) AS out, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS spread FROM z2 GROUP BY 1, 2",
    P.FLAGS,
)
def stage_reconstruct(spark, d):
    """Inputs of two sources on their common months, stacked as features, through every network: mean and spread of members."""
    flags = P.flags(spark, d)
    a, b = (flags.where(F.col("flag") == k).select("month", "month_ix", (F.col("value") / 1e4).alias("value")) for k in "AR")
    common = U.common_months([a, b]).select("month")
    blocks = [x.join(common, "month", "left_semi").select("month_ix", F.lit(0).alias("ix"), "value") for x in (a, b)]
    stacked = U.stack_features(blocks, ["month_ix"], "ix", 1)
    rows = stacked.groupBy("month_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda s: s["value"]).alias("x"))
    nets = [(m, 0, (([w[:2] if k == 0 else w for k, w in enumerate(_net(m)[0])]), *_net(m)[1:])) for m in range(4)]
    each = M.predict(rows, nets, "month_ix").select("month_ix", F.posexplode("prediction").alias("out", "value"))
    return rounded(A.member_spread(each, ["month_ix", "out"]), "mean", "spread", places=6)


# -- trends and relevance ----------------------------------------------------------------------------------------------

_BUDGET = (
    "lt AS (SELECT lev, month_ix - 300 AS t, value FROM levels)", _mbb("lt"),
    "ms AS (SELECT lev, realization, CASE WHEN count(value) = count(*) THEN regr_slope(value, month_ix) END AS s FROM members GROUP BY 1, 2), sm AS (SELECT lev, stddev_samp(s) AS sigma_members FROM ms GROUP BY 1),"
    " ps AS (SELECT l_linenumber AS lev, l_returnflag AS f, regr_slope(v, ix) AS s FROM (SELECT l_linenumber, l_returnflag, (year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 AS ix, avg(l_discount * 1000) AS v FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2), sp AS (SELECT lev, stddev_samp(s) AS sigma_products FROM ps GROUP BY 1),"
    " er AS (SELECT lev, realization, month, month_ix % 2 AS br, pred - truth AS e FROM members), bc AS (SELECT lev, sqrt(sum(d * d) / (count(e) - 2)) AS mapping FROM (SELECT *, e - avg(e) OVER (PARTITION BY lev, br) AS d FROM er) GROUP BY 1),"
    " gm AS (SELECT lev, covar_pop(truth, pred) / var_pop(truth) AS gamma FROM members GROUP BY 1)",
)


@query(
    ", tot AS (SELECT lev, slope, sigma_serial, sigma_members, sigma_products, mapping / 100 AS sigma_mapping, gamma, sqrt(pow(sigma_serial, 2) + pow(sigma_members, 2) + pow(sigma_products, 2) + pow(mapping / 100, 2)) AS total FROM bf JOIN bs USING (lev) JOIN sm USING (lev) JOIN sp USING (lev) JOIN bc USING (lev) JOIN gm USING (lev))"
    " SELECT lev, round(slope, 4) AS slope, round(slope / gamma, 4) AS undamped, round(sigma_serial, 4) AS sigma_serial, round(sigma_members, 4) AS sigma_members, round(sigma_products, 5) AS sigma_products, round(sigma_mapping, 4) AS sigma_mapping, round(total, 4) AS sigma_total, abs(slope) > 2 * total AS significant FROM tot",
    P.LEVELS, P.MEMBERS, *_BUDGET,
)
def stage_trend_budget(spark, d):
    """A trend and all terms of its uncertainty: serial, members, products, mapping about branch means, and attenuation."""
    m = P.members(spark, d)
    fit = _boot(P.levels(spark, d).withColumn("t", F.col("month_ix") - 300), ["lev"]).select("lev", "slope", "sigma_serial")
    members = A.trend_spread(m, ["lev"], "realization", "month_ix").select("lev", F.col("spread").alias("sigma_members"))
    l = P.load(spark, d, "lineitem").withColumn("month_ix", C.month_index("l_shipdate"))  # noqa: E741
    products = l.groupBy(F.col("l_linenumber").alias("lev"), "l_returnflag", "month_ix").agg(F.avg(F.col("l_discount") * 1000).alias("value"))
    products = A.trend_spread(products, ["lev"], "l_returnflag", "month_ix").select("lev", F.col("spread").alias("sigma_products"))
    errors = m.select("lev", (F.col("month_ix") % 2).alias("branch"), (F.col("pred") - F.col("truth")).alias("value"))
    n = F.count("value")
    mapping = errors.withColumn("d", F.col("value") - F.avg("value").over(W.W.partitionBy("lev", "branch"))).groupBy("lev").agg((F.sqrt(F.sum(F.col("d") * F.col("d")) / (n - 2)) / 100).alias("sigma_mapping"))
    gamma = R.attenuation(m, ["lev"]).select("lev", "gamma")
    out = fit.join(members, "lev").join(products, "lev").join(mapping, "lev").join(gamma, "lev")
    out = R.quadrature(out, "slope", ["sigma_serial", "sigma_members", "sigma_products", "sigma_mapping"])
    return out.select("lev", rd("slope").alias("slope"), rd(F.col("slope") / F.col("gamma")).alias("undamped"), *[rd(c, 5 if c == "sigma_products" else 4).alias(c) for c in ("sigma_serial", "sigma_members", "sigma_products", "sigma_mapping", "sigma_total")], "significant")


@query(
    ", cb AS (SELECT a * 2 + b AS combo, a, b FROM (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1]) AS b)), x AS (SELECT combo, lev, month_ix - 300 AS t, (CASE a WHEN 0 THEN value WHEN 1 THEN value * 1.1e0 ELSE value + month_ix * 9e0 END) + (CASE b WHEN 1 THEN month_ix * 25e0 ELSE 0 END) AS value FROM levels, cb),"
    " lt AS (SELECT combo * 100 + lev AS lev, t, value FROM x)," + _mbb("lt") + ", p AS (SELECT lev // 100 AS combo, lev % 100 AS lev, slope, sigma_serial, abs(slope) > 2 * sigma_serial AS significant FROM bf JOIN bs USING (lev))"
    " SELECT CAST(combo AS INTEGER) AS combo, CAST(lev AS BIGINT) AS lev, round(slope, 4) AS slope, round(sigma_serial, 4) AS sigma_serial, significant, round(stddev_samp(slope) OVER (PARTITION BY lev), 4) AS spread FROM p",
    P.LEVELS,
)
def stage_combination_trends(spark, d):
    """Every combination of products: its trends with their serial error, and the spread of trends over combinations."""
    combos = U.product_registry({"a": ("0", "1", "2"), "b": ("0", "1")}, spark.range(1))
    t = F.col("month_ix") * 1.0
    first = F.when(F.col("a") == "0", F.col("value")).when(F.col("a") == "1", F.col("value") * 1.1).otherwise(F.col("value") + t * 9)
    rows = P.levels(spark, d).crossJoin(F.broadcast(combos)).select("combo", "lev", (F.col("month_ix") - 300).alias("t"), (first + F.when(F.col("b") == "1", t * 25).otherwise(0.0)).alias("value"))
    fit = _boot(rows, ["combo", "lev"])
    out = R.quadrature(fit, "slope", ["sigma_serial"]).withColumn("spread", F.stddev_samp("slope").over(W.W.partitionBy("lev")))
    return out.select("combo", "lev", rd("slope").alias("slope"), rd("sigma_serial").alias("sigma_serial"), "significant", rd("spread").alias("spread"))


_TRIMS, _BUFFERS, _BLOCKS, _LEAST = (0, 1, 2), (0, 6, 12), (0, 6, 12, 24), 48
_NONE = "CAST(NULL AS BIGINT)"
#: The gap is months 330 to 334; blocks of 12 months, and of other lengths over the whole record.
_GRID = (
    "e AS (SELECT min(t) AS a, max(t) AS b FROM lt), tr AS (SELECT unnest([0, 1, 2]) AS x), bu AS (SELECT unnest([0, 6, 12]) AS u),"
    f" sc AS (SELECT 'whole' AS scenario, 'baseline' AS family, 12 AS block, a AS lo, b AS hi, {_NONE} AS cut_lo, {_NONE} AS cut_hi FROM e"
    f" UNION ALL SELECT 'start +' || s.x || 'y, end -' || n.x || 'y', 'startend', 12, a + 12 * s.x, b - 12 * n.x, NULL, NULL FROM e, tr s, tr n WHERE s.x + n.x > 0 AND b - a - 12 * (s.x + n.x) + 1 >= {_LEAST}"
    " UNION ALL SELECT 'gap +-' || u, 'gap', 12, a, b, greatest(a, 330 - u), least(b, 334 + u) FROM e, bu"
    " UNION ALL SELECT 'before the gap', 'split', 12, a, 329, NULL, NULL FROM e WHERE 330 - a >= 24 UNION ALL SELECT 'behind the gap', 'split', 12, 335, b, NULL, NULL FROM e WHERE b - 334 >= 24"
    f" UNION ALL SELECT 'drop ' || y, 'jackknife', 12, a, b, greatest(a, (y - 1970) * 12), least(b, (y - 1970) * 12 + 11) FROM e, (SELECT DISTINCT year(month) AS y FROM levels) WHERE b - a - (least(b, (y - 1970) * 12 + 11) - greatest(a, (y - 1970) * 12)) >= {_LEAST}"
    " UNION ALL SELECT 'blocks of ' || k, 'serial', k, a, b, NULL, NULL FROM e, (SELECT unnest([0, 6, 24]) AS k))"
)
_REFITS = (
    "ms AS (SELECT lev, realization, CASE WHEN count(value) = count(*) THEN regr_slope(value, month_ix) END AS s FROM members GROUP BY 1, 2), sm AS (SELECT lev, stddev_samp(s) AS m FROM ms GROUP BY 1),"
    " tot AS (SELECT *, sqrt(sigma_serial * sigma_serial + m * m) AS total FROM bf JOIN bs USING (scenario, lev) JOIN sm USING (lev)),"
    " bb AS (SELECT lev, slope AS base, sigma_serial AS base_serial, total AS base_total, abs(slope) > 2 * total AS was, n AS base_n FROM tot WHERE scenario = 'whole' AND sigma_serial > 0),"
    " rr AS (SELECT scenario, family, t.lev, slope, sigma_serial, total, abs(slope) > 2 * total AS sig, n, bb.* EXCLUDE (lev), abs(slope - base) AS moved, abs(slope - base) / base_total AS in_sigma FROM tot t JOIN sc USING (scenario) JOIN bb ON bb.lev = t.lev)"
)


def _refitted(spark, d):
    """The grid of scenarios over the levels, less their monthly means, and each one's refits with the whole uncertainty."""
    levels = A.demean(P.levels(spark, d), ["month"])
    grid = materialised(R.robustness_grid(levels, (330, 334), _TRIMS, _BUFFERS, _BLOCKS, 12, _LEAST), "scenarios")
    fits = R.refits(levels, ["lev"], "month_ix", grid, draws=100, starts=R.integer_starts)
    members = A.trend_spread(P.members(spark, d), ["lev"], "realization", "month_ix").select("lev", F.col("spread").alias("sigma_members"))
    return R.robustness(fits, grid, ["lev"], members, ["sigma_members"])


_DEMEANED = "lt AS (SELECT lev, month_ix AS t, value - avg(value) OVER (PARTITION BY month) AS value FROM levels)"


@query(
    ", x AS (SELECT scenario, family, avg(CAST(sig AS INTEGER)) AS significant, avg(CASE WHEN was THEN CAST(sig AS INTEGER) END) AS retained, avg(CASE WHEN was THEN CAST(sign(slope) <> sign(base) AS INTEGER) END) AS sign_flipped,"
    " avg(CAST(in_sigma > 1 AS INTEGER)) AS over_1_sigma, avg(CAST(in_sigma > 2 AS INTEGER)) AS over_2_sigma, covar_pop(base, slope) / (stddev_pop(base) * stddev_pop(slope)) AS map_r, median(moved) AS median_moved, max(moved) AS most_moved, median(in_sigma) AS median_in_sigma, max(in_sigma) AS most_in_sigma,"
    " median(sigma_serial) / median(base_serial) AS serial_ratio, max(n) AS n, max(n) >= 0.75e0 * max(base_n) AS enough, count(*) AS cells FROM rr GROUP BY 1, 2)"
    " SELECT scenario, family, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("significant", "retained", "sign_flipped", "over_1_sigma", "over_2_sigma", "map_r", "median_moved", "most_moved", "median_in_sigma", "most_in_sigma", "serial_ratio")) + ", n, enough, cells FROM x",
    P.LEVELS, P.MEMBERS, _DEMEANED, _GRID, refit_sql("lt", "sc", 100), _REFITS,
)
def stage_trend_robustness(spark, d):
    """Does a trend hold: the grid of scenarios, each refitted with its bootstrap, and one row for each scenario."""
    out = R.robustness_summary(_refitted(spark, d))
    return rounded(out, "significant", "retained", "sign_flipped", "over_1_sigma", "over_2_sigma", "map_r", "median_moved", "most_moved", "median_in_sigma", "most_in_sigma", "serial_ratio")


@query(
    ", w AS (SELECT family, lev, max(in_sigma) AS worst FROM rr WHERE family <> 'baseline' GROUP BY 1, 2)"
    " SELECT family, round(median(worst), 4) AS median, round(quantile_cont(worst, 0.95), 4) AS p95, round(max(worst), 4) AS worst, round(avg(CAST(worst > 1 AS INTEGER)), 4) AS over_1_sigma, count(*) AS cells FROM w GROUP BY 1",
    P.LEVELS, P.MEMBERS, _DEMEANED, _GRID, refit_sql("lt", "sc", 100), _REFITS,
)
def stage_robustness_families(spark, d):
    """The worst case of every family of scenarios: each cell's largest change in baseline sigmas, and its spread over cells."""
    rows = _refitted(spark, d).where("family != 'baseline'").withColumn("sigma", F.col("base_total"))
    return rounded(A.worst_case(rows, ["family"], ["lev"]), "median", "p95", "worst", "over_1_sigma")


@query(
    " SELECT scenario, lev, round(slope, 5) AS slope, round(sigma_serial, 5) AS sigma_serial, CAST(n AS BIGINT) AS n FROM bf JOIN bs USING (scenario, lev)",
    P.LEVELS, _DEMEANED, _GRID, refit_sql("lt", "sc", 100),
)
def scenario_refits(spark, d):
    levels = A.demean(P.levels(spark, d), ["month"])
    grid = R.robustness_grid(levels, (330, 334), _TRIMS, _BUFFERS, _BLOCKS, 12, _LEAST)
    out = R.refits(levels, ["lev"], "month_ix", grid, draws=100, starts=R.integer_starts)
    return out.select("scenario", "lev", rd("slope", 5).alias("slope"), rd("sigma_serial", 5).alias("sigma_serial"), "n")


_MC_DRAWS = 500
_MC = (
    f"dr AS (SELECT unnest(generate_series(0, {_MC_DRAWS - 1})) AS draw), lt AS (SELECT lev, month_ix - 300 AS t, value FROM levels), mean AS (SELECT t, avg(value) / 1e6 AS s FROM lt GROUP BY 1),"
    " e AS (SELECT draw, lev, t, (((draw * 7919 + lev * 104729 + t * 31) % 1000) / 500e0 - 1) * s AS v FROM lt JOIN mean USING (t), dr WHERE t % 5 <> 3 OR t = 0),"
    f" nb AS (SELECT t, max(CASE WHEN s.t0 <= t THEN s.t0 END) AS a, min(CASE WHEN s.t0 >= t THEN s.t0 END) AS b FROM (SELECT unnest(generate_series(0, {N_TIME - 1})) AS t), (SELECT DISTINCT t AS t0 FROM lt WHERE t % 5 <> 3 OR t = 0) s GROUP BY 1),"
    " ip AS (SELECT x.draw, x.lev, nb.t, CASE WHEN a = b THEN x.v ELSE x.v + (y.v - x.v) * (nb.t - a) / (b - a) END AS v FROM nb JOIN e x ON x.t = a JOIN e y ON y.draw = x.draw AND y.lev = x.lev AND y.t = b),"
    " rb AS (SELECT draw, lev, t, v - avg(CASE WHEN t BETWEEN 20 AND 60 THEN v END) OVER (PARTITION BY draw, lev) AS v FROM ip), dm AS (SELECT draw, lev, t, v - avg(v) OVER (PARTITION BY draw, t) AS value FROM rb)",
    _filtered("dm", "draw, lev", 5, 1 / 24, 24),
    "x0 AS (SELECT -1 AS draw, o0.t, o0.lev - 1 AS f, o0.value / 1e5 AS v FROM lt o0 UNION ALL SELECT -1, month_ix - 300, 6 + lev, q FROM (SELECT l_linenumber AS lev, (year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 AS month_ix, avg(l_quantity) / 50e0 AS q FROM lineitem WHERE l_shipdate < DATE '2001-11-01' GROUP BY 1, 2)),"
    " xx AS (SELECT * FROM x0 UNION ALL SELECT dr.draw, x0.t, f, x0.v + coalesce(fs.value, 0) FROM x0 CROSS JOIN dr LEFT JOIN fs ON fs.draw = dr.draw AND fs.o = x0.t AND fs.lev = f + 1),"
    " n1 AS (SELECT draw, t, me, o, sum(v * ((f * 7 + o * 13 + me * 5) % 11 - 5) / 20e0) + (o - 2) / 10e0 AS z FROM xx, (SELECT unnest([0, 1, 2, 3]) AS me), (SELECT unnest(generate_series(0, 5)) AS o) GROUP BY 1, 2, 3, 4),"
    " n2 AS (SELECT draw, t, k, avg(y) AS y FROM (SELECT draw, t, me, k, sum(z / (1 + exp(-z)) * ((o * 5 + k * 7 + me) % 7 - 3) / 5e0 + z * ((o * 3 + k * 5 + me) % 5 - 2) / 10e0) + (k + 1) / 10e0 AS y FROM n1, (SELECT unnest(generate_series(0, 2)) AS k) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),"
    " aw AS (SELECT b.draw, b.t, b.k, b.y, b.y - c.y AS d FROM n2 b JOIN n2 c ON c.draw = -1 AND c.t = b.t AND c.k = b.k WHERE b.draw >= 0),"
    " mo AS (SELECT k, t, avg(d) AS bias, stddev_samp(d) AS sigma FROM aw GROUP BY 1, 2), ts AS (SELECT k, stddev_samp(s) AS sigma_trend FROM (SELECT k, draw, regr_slope(y, t) AS s FROM aw GROUP BY 1, 2) GROUP BY 1)",
)


def _given_noise(sigma):
    """A rule in place of a stream: the noise of a draw for the samples (months since the first) and regions of ``sigma``."""

    def draw(number):
        t, region = sigma[0][:, None], np.arange(1, sigma[1].shape[1] + 1)[None, :]
        return ((number * 7919 + region * 104729 + t * 31) % 1000 / 500.0 - 1.0) * sigma[1]

    return draw


def _noise_monte_carlo(spark, d):
    """Moments and trends of the draws: two blocks of inputs, noise in the first, four networks of a rule."""
    levels = P.levels(spark, d).withColumn("t", F.col("month_ix") - 300)
    first = levels.select("t", (F.col("lev") - 1).cast("int").alias("f"), (F.col("value") / 1e5).alias("v"))
    quantity = P.load(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("2001-11-01").cast("timestamp")).groupBy(F.col("l_linenumber").alias("lev"), (C.month_index("l_shipdate") - 300).alias("t"))
    second = quantity.agg((F.avg("l_quantity") / 50).alias("v")).select("t", (F.col("lev") + 6).cast("int").alias("f"), "v")
    # A panel of months x features: settings-sized, as the networks are.
    panel = first.unionByName(second).groupBy("t").pivot("f", list(range(14))).agg(F.first("v")).orderBy("t").toPandas()
    base, months = panel.drop(columns="t").to_numpy(float), panel["t"].to_numpy()
    seen = np.array([t for t in months if t % 5 != 3 or t == 0])
    spread = np.array([x[:7].mean() / 10 for x in base])[np.isin(months, seen)]
    noise = _given_noise((seen, np.repeat(spread[:, None], 7, axis=1)))
    nets = [([w[:14] if k == 0 else w for k, w in enumerate(_net(m)[0])], *_net(m)[1:]) for m in range(4)]
    return N.monte_carlo(spark, base, N.ensemble_response(nets), noise, N.observation_operator(seen, months, (20, 60)), 0, _MC_DRAWS)


@query(" SELECT CAST(k AS BIGINT) AS cell, CAST(t AS INTEGER) AS month, round(bias, 6) AS bias, round(sigma, 6) AS sigma FROM mo", P.LEVELS, *_MC)
def noise_monte_carlo_months(spark, d):
    """What noise does to each month of the prediction: its bias and spread over 500 draws."""
    return rounded(N.noise_budget(*_noise_monte_carlo(spark, d))[0], "bias", "sigma", places=6)


@query(
    f" SELECT CAST(k AS BIGINT) AS cell, round(sqrt(avg(sigma * sigma)), 6) AS sigma_month, round(avg(abs(bias)), 6) AS bias, CAST({_MC_DRAWS} AS BIGINT) AS n, round(any_value(sigma_trend), 8) AS sigma_trend FROM mo JOIN ts USING (k) GROUP BY 1",
    P.LEVELS, *_MC,
)
def stage_noise_monte_carlo(spark, d):
    """Observation noise through the chain and the ensemble, 500 draws: monthly spread, bias and spread of trends of each cell."""
    out = N.noise_budget(*_noise_monte_carlo(spark, d))[1]
    return out.select("cell", rd("sigma_month", 6).alias("sigma_month"), rd("bias", 6).alias("bias"), "n", rd("sigma_trend", 8).alias("sigma_trend"))


_HEAD = "hw AS (SELECT k, sum(((k * 3 + 2) % 5 - 2) / 4e0 * 3) AS w FROM (SELECT unnest(generate_series(0, 2)) AS k) GROUP BY 1)"


@query(
    ", r1 AS (SELECT sample, me, o, z, sum((z / (1 + exp(-z)) * ((o * 5 + k * 7 + me) % 7 - 3) / 5e0 + z * ((o * 3 + k * 5 + me) % 5 - 2) / 10e0) * w) AS r FROM z1, hw GROUP BY 1, 2, 3, 4),"
    " x AS (SELECT f.sample, me, feature // 16 AS block, sum(value * r / z * ((feature * 7 + o * 13 + me * 5) % 11 - 5) / 20e0) AS total FROM features f JOIN r1 USING (sample) GROUP BY 1, 2, 3)"
    " SELECT sample, CAST(block AS INTEGER) AS block, round(avg(total), 5) AS mean, round(stddev_pop(total), 5) AS std, round(avg(abs(total)), 5) AS mean_abs FROM x GROUP BY 1, 2",
    P.FEATURES, "mm AS (SELECT unnest([0, 1, 2, 3]) AS me), z1 AS (SELECT sample, me, o, sum(value * ((feature * 7 + o * 13 + me * 5) % 11 - 5) / 20e0) + (o - 2) / 10e0 AS z FROM features, mm, (SELECT unnest(generate_series(0, 5)) AS o) GROUP BY 1, 2, 3)", _HEAD,
)
def stage_relevance(spark, d):
    """Relevance for one physical output: the head of components and scale, every network, moments over networks by block."""
    parts = spark.range(3).select(F.lit(2).alias("feature"), F.col("id").cast("int").alias("component"), (((F.col("id") * 3 + 2) % 5 - 2) / 4.0).alias("weight"), F.lit(0.5).alias("mean"))
    scaler = spark.range(1).select(F.lit(2).alias("feature"), F.lit(3.0).alias("scale"), F.lit(7.0).alias("centre"))
    head = [r["w"] for r in L.physical_head(parts, scaler, "feature").orderBy("component").collect()]  # a number per component
    out = L.explain(P.vectors(spark, d), [(m, *_net(m)) for m in range(4)], "sample", head)
    rows = out.select("sample", "member", F.posexplode("relevance").alias("feature", "value"))
    blocks = A.relevance_by_block(rows, ["sample", "member"], "feature", 16).select("sample", "block", F.col("total").alias("value"))
    return rounded(A.member_moments(blocks, ["sample", "block"]), "mean", "std", "mean_abs", places=5)


