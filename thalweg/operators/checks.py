"""Gates before a stage: frames of offences, empty if all is well (V*, M9, S9, S14-S17, T10, L5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import month_index
from .tables import unmatched
from .windows import core_levels

Keys = Sequence[str]


def offences(df: DataFrame, keys: Keys, rules: dict[str, Column]) -> DataFrame:
    """(keys..., offence) for each rule that a row does not keep; a rule that is null is not kept."""
    each = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(*keys, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("offence"))


def baseline_offences(baselines: DataFrame, model: Column, wind: Column, period: tuple[int, int]) -> DataFrame:
    """V2: baselines (baseline, source_model, first_year, last_year, variables, wind_source, wind_level) that do not fit.

    The model has to be told and be this one, the period too; variables are told once each, with both of the ocean, and
    the wind that is wanted, which needs the level that was chosen if its name has one.
    """
    names, has = F.col("variables"), lambda c: F.array_contains("variables", c)
    return offences(baselines, ["baseline"], {
        "no source model": F.col("source_model").isNotNull(),
        "other source model": F.coalesce(F.col("source_model") == model, F.lit(True)),
        "other period": F.coalesce((F.col("first_year") == period[0]) & (F.col("last_year") == period[1]), F.lit(True)),
        "repeated variable": F.size(F.array_distinct(names)) == F.size(names),
        "no ocean variable": has(F.lit("pbo")) & has(F.lit("zos")),
        "no wind": F.col("wind_source").isNotNull(),
        "other wind": F.coalesce(F.col("wind_source") == wind, F.lit(True)),
        "no wind column": F.coalesce(has(wind), F.lit(False)),
        "no wind level": ~F.contains(wind, F.lit("@")) | F.col("wind_level").isNotNull(),
    })


def anomaly_offences(records: DataFrame, period: tuple[int, int]) -> DataFrame:
    """V3: observation records (record, kind, anomaly, convention, first_year, last_year) that are no anomalies of the baseline."""
    wind = F.col("kind").isin("uas", "tauu", "curltau")
    return offences(records, ["record"], {
        "no anomaly": F.col("anomaly"),
        "other wind convention": ~wind | (F.col("convention") == f"anomaly_{period[0]}_{period[1]}"),
        "other period": (F.col("first_year") == period[0]) & (F.col("last_year") == period[1]),
    })


def feature_sources(features: DataFrame, known: DataFrame) -> DataFrame:
    """V3: the source and kind of each trained feature, in training order; ``state`` tells unknown and repeated ones."""
    n = F.count("*").over(W.partitionBy("feature"))
    out = features.withColumn("__n", n).join(known, "feature", "left")
    return out.withColumn("state", F.when(F.col("source").isNull(), "unknown").when(F.col("__n") > 1, "repeated").otherwise("ok")).drop("__n")


def budget_offences(budget: DataFrame, registry: DataFrame, months: DataFrame, keys: Keys, month: str = "month") -> DataFrame:
    """V6: what a saved budget and the registry and months it was made for do not have in common: (key, side)."""
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    tuples = unmatched(budget.select(name.alias("key")), registry.select(name.alias("key")), ["key"])
    times = unmatched(budget.select(F.col(month).cast("string").alias("key")), months.select(F.col(month).cast("string").alias("key")), ["key"])
    return tuples.unionByName(times)


def reference_offences(reference: DataFrame, grid: DataFrame, period: tuple[int, int]) -> DataFrame:
    """V7: cells (lev, lat) that a reference state has and its grid lacks or the other way round, or of another period."""
    shape = unmatched(reference, grid, ["lev", "lat"]).select("lev", "lat", F.concat(F.lit("only "), F.when(F.col("side") == "left", "reference").otherwise("grid")).alias("offence"))
    other = offences(reference, ["lev", "lat"], {"other period": (F.col("first_year") == period[0]) & (F.col("last_year") == period[1]), "no value": F.col("value").isNotNull()})
    return shape.unionByName(other)


def parity(rows: DataFrame, keys: Keys, pairs: dict[str, tuple[str, str, float]]) -> DataFrame:
    """V8: (check, largest, off, ok) for pairs of columns that have to agree: name -> (one, other, tolerance); ``off`` rows
    are beyond it."""
    away = {name: F.abs(F.col(a) - F.col(b)) for name, (a, b, _) in pairs.items()}
    far = rows.agg(*[F.max(d).alias(name) for name, d in away.items()], *[F.count_if(d > pairs[name][2]).alias(f"__{name}") for name, d in away.items()])
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("largest"), F.col(f"__{n}").alias("off"), (F.col(n) <= t).alias("ok")) for n, (_, _, t) in pairs.items()])
    return far.select(F.explode(each).alias("c")).select("c.*")


def artifact_offences(found: DataFrame, folds: int, members: int, versions: Sequence[str]) -> DataFrame:
    """M9: artifacts (fold, member, version) that are missing, superfluous or of a version that is not known."""
    plan = found.sparkSession.range(folds * members).select((F.floor(F.col("id") / members) + 1).cast("int").alias("fold"), (F.col("id") % members + 1).cast("int").alias("member"))
    sides = unmatched(plan, found, ["fold", "member"])
    own = found.where(~F.coalesce(F.col("version").isin(*versions), F.lit(False))).select("fold", "member", F.lit("version").alias("side"))
    return sides.unionByName(own).select("fold", "member", F.when(F.col("side") == "left", "missing").when(F.col("side") == "right", "superfluous").otherwise("other version").alias("offence"))


def series_offences(df: DataFrame, keys: Keys, month: str = "month", value: str = "value", error: str = "error") -> DataFrame:
    """Rows of provider series with a value that is not finite, an error that is not or is negative, or a gap before."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    ix = month_index(month)
    step = ix - F.lag(ix).over(W.partitionBy(*keys).orderBy(month))
    rows = df.withColumn("__step", step)
    return offences(rows, [*keys, month], {"value": finite(value), "error": finite(error) & (F.col(error) >= 0), "not monthly": F.coalesce(F.col("__step") == 1, F.lit(True))})


def expected_number(found: Column, expected: Column) -> Column:
    """What an attribute states, if it is what the product is known to have; anything else raises an error."""
    message = F.concat(F.lit("stated "), F.coalesce(found.cast("string"), F.lit("nothing")), F.lit(", expected "), expected.cast("string"))
    return F.when(found == expected, found).otherwise(F.raise_error(message).cast("double"))


def axis_offences(axis: DataFrame, x: str, first: float, step: float) -> DataFrame:
    """Places of an axis (ix from 0, x) that are not where a regular grid has them."""
    want = F.lit(first) + F.col("ix") * F.lit(step)
    return axis.where(~F.coalesce(F.abs(F.col(x) - want) < 1e-6, F.lit(False))).select("ix", x, want.alias("expected"))


def by_model(df: DataFrame, areas: DataFrame, model: str = "model") -> DataFrame:
    """The cell-area file of each row's model (equal names only; of several the first), null where there is none."""
    return df.join(areas.groupBy(model).agg(F.min("area_file").alias("area_file")), model, "left")


def resolve_target(plane: DataFrame, targets: DataFrame, lat: str, lev: str, valid: DataFrame, value: str = "value", mid_from: float = -55.5) -> DataFrame:
    """The cell of each target (target, latitude, core or level): (target, lat_ix, lev, mode, out_ix, baseline, state).

    ``plane``: (lat, lat_ix, lev, value), the baseline.  The latitude is the nearest one; the level that of the core
    (``mid``: the maximum, ``abyssal``: the minimum, both smoothed along latitude) or the nearest to the one given.
    ``valid``: (lat_ix, lev, out_ix), the cells that were trained; a target outside them, or a mid core south of
    ``mid_from``, is told by its state.
    """
    rows = plane.select(F.col(lat).alias("lat"), "lat_ix", F.col(lev).alias("lev"), F.col(value).alias("value"))
    lats = rows.select("lat", "lat_ix").distinct().agg(F.collect_list(F.struct("lat", "lat_ix")).alias("__lats"))
    levs = rows.select("lev").distinct().agg(F.collect_list("lev").alias("__levs"))
    cores = core_levels(rows, "lat_ix", "lev").select("lat_ix", F.col("core").alias("mid"))
    cores = cores.join(core_levels(rows.withColumn("value", -F.col("value")), "lat_ix", "lev").select("lat_ix", F.col("core").alias("abyssal")), "lat_ix")
    near = F.array_min(F.transform("__lats", lambda a: F.struct(F.abs(a["lat"] - F.col("latitude")).alias("d"), a["lat_ix"].alias("lat_ix"), a["lat"].alias("lat"))))
    level = F.array_min(F.transform("__levs", lambda a: F.struct(F.abs(a - F.col("level")).alias("d"), a.alias("lev"))))["lev"]
    at = targets.crossJoin(F.broadcast(lats)).crossJoin(F.broadcast(levs)).select("target", "core", "level", near.alias("n"), level.alias("__near"))
    at = at.select("target", "core", "level", "n.lat_ix", "n.lat", "__near").join(F.broadcast(cores), "lat_ix")  # a row per latitude
    mode = F.when(F.col("level").isNotNull(), "explicit_cell").otherwise(F.concat("core", F.lit("_core")))
    chosen = F.when(F.col("level").isNotNull(), F.col("__near")).when(F.col("core") == "mid", F.col("mid")).when(F.col("core") == "abyssal", F.col("abyssal"))
    out = at.select("target", "lat_ix", "lat", mode.alias("mode"), chosen.cast("int").alias("lev"))
    out = out.join(valid, ["lat_ix", "lev"], "left").join(rows.select("lat_ix", "lev", F.col("value").alias("baseline")), ["lat_ix", "lev"], "left")
    state = F.when(F.col("lev").isNull(), "unknown core").when((F.col("mode") == "mid_core") & (F.col("lat") < mid_from), "no core").when(F.col("out_ix").isNull(), "outside the mask").otherwise("ok")
    return out.select("target", "lat_ix", "lev", "mode", "out_ix", "baseline", state.alias("state"))
