"""Column expressions: dates, units, physics, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEAWATER_DENSITY = 1035.0
GRAVITY = 9.806
EARTH_RADIUS_M = 6.371e6
EARTH_RADIUS_KM = 6371.0
AIR_DENSITY = 1.22


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- dates ------------------------------------------------------------------------------------------------------------


def month_of(ts: Column | str) -> Column:
    """The first day of the month, as a date."""
    return F.trunc(col(ts).cast("date"), "MM")


def month_index(month: Column | str) -> Column:
    """Months since January 1970."""
    m = col(month)
    return ((F.year(m) - 1970) * 12 + F.month(m) - 1).cast("long")


def month_from_index(ix: Column | str) -> Column:
    return F.add_months(F.lit("1970-01-01").cast("date"), col(ix).cast("int"))


def decimal_year(month: Column | str) -> Column:
    """year + month / 12: December lands on the next whole year."""
    m = col(month)
    return F.year(m) + F.month(m) / F.lit(12.0)


def month_label(month: Column | str) -> Column:
    return F.date_format(col(month), "yyyy-MM")


def parse_month(label: Column | str) -> Column:
    return F.to_date(F.concat(F.substring(F.trim(col(label)), 1, 7), F.lit("-01")))


def days_in_month(month: Column | str) -> Column:
    return F.dayofmonth(F.last_day(col(month)))


def from_days(days: Column | str, epoch: str) -> Column:
    """Decodes days since an epoch date, Gregorian calendar (fractions of days are cut)."""
    return F.date_add(F.lit(epoch).cast("date"), F.floor(col(days)).cast("int"))


def from_hours(hours: Column | str, epoch: str) -> Column:
    return F.timestamp_add("HOUR", col(hours).cast("int"), F.lit(epoch).cast("timestamp_ntz"))


def calendar_month(days: Column | str, epoch_year: int, calendar: str) -> Column:
    """(year, month) of days since 1 January of a year, in calendars of 360 or 365 days a year."""
    d = F.floor(col(days)).cast("long")
    if calendar == "360_day":
        return F.struct((F.lit(epoch_year) + F.expr("0") + F.floor(d / 360)).cast("int").alias("year"), (F.floor(F.pmod(d, F.lit(360)) / 30) + 1).cast("int").alias("month"))
    if calendar != "noleap":
        raise ValueError(calendar)
    of_year = F.pmod(d, F.lit(365))
    starts = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)
    month = sum((F.when(of_year >= s, 1).otherwise(0) for s in starts), F.lit(0))
    return F.struct((F.lit(epoch_year) + F.floor(d / 365)).cast("int").alias("year"), month.cast("int").alias("month"))


def in_gap(month: Column | str, first: str = "2017-07", last: str = "2018-05") -> Column:
    return month_label(month).between(first, last)


# -- units and physics ------------------------------------------------------------------------------------------------


def water_cm_to_pascal(cm: Column | str, density: float = 1000.0) -> Column:
    return col(cm) / 100.0 * GRAVITY * density


def mass_to_volume(kg_s: Column | str) -> Column:
    return col(kg_s) / SEAWATER_DENSITY


def to_sverdrup(m3_s: Column | str) -> Column:
    return col(m3_s) / 1e6


def recentred_longitude(lon: Column | str) -> Column:
    """0..360 to -180..180."""
    return F.when(col(lon) > 180.0, col(lon) - 360.0).otherwise(col(lon))


def pressure_in_pascal(level: Column | str, unit: Column | str) -> Column:
    return F.when(F.lower(col(unit)).isin("hpa", "mbar", "millibar"), col(level) * 100.0).otherwise(col(level))


def region_id(sigma2: Column | str, lat: Column | str, sigma_cut: float = 36.7, lat_cut: float = -34.0) -> Column:
    return 2 * (col(sigma2) > sigma_cut).cast("int") + (col(lat) < lat_cut).cast("int")


#: Neutral drag laws by their published names (fixed values): 1000 Cd in light wind, the wind speed (m/s) where that ends,
#: and from there on offset and slope of 1000 Cd.
DRAG_LAWS = {"smith1980": (1.0, 7.5, 0.61, 0.063), "largepond1981": (1.2, 11.0, 0.49, 0.065)}


def drag_coefficient(speed: Column | str, law: str = "smith1980") -> Column:
    """Neutral drag coefficient at 10 m, with the jump that a law has where light wind ends."""
    if law not in DRAG_LAWS:
        raise ValueError(f"drag law {law}: known are {', '.join(DRAG_LAWS)}")
    light, end, offset, slope = DRAG_LAWS[law]
    return F.when(col(speed) < end, F.lit(light)).otherwise(offset + slope * col(speed)) / 1000.0


def wind_stress(u: Column | str, v: Column | str, density: float = AIR_DENSITY, law: str = "smith1980") -> tuple[Column, Column]:
    """Both components of the stress: density * Cd * speed * wind."""
    speed = F.hypot(col(u), col(v))
    return tuple(density * drag_coefficient(speed, law) * speed * col(c) for c in (u, v))


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1 - lon2))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) * EARTH_RADIUS_KM


# -- text -------------------------------------------------------------------------------------------------------------


def realization_of(path: Column | str) -> Column:
    """The member number of a file name (``_r7i``), null if there is none."""
    return F.nullif(F.regexp_extract(col(path), r"_r(\d+)i", 1), F.lit("")).cast("int")


def source_of(name: Column | str) -> Column:
    """The model of ``var_table_model_experiment_member_grid`` names, null for other names."""
    parts = F.split(col(name), "_")
    return F.when(F.get(parts, F.lit(4)).rlike(r"^r\d+i\d+p\d+f\d+$"), F.get(parts, F.lit(2)))


def file_pattern(var: Column, table: Column, model: Column, experiment: Column | None = None, suffix: str = "*.nc") -> Column:
    """The pattern of the files of a variable, table and model, and of an experiment where it is told."""
    return F.concat(F.concat_ws("_", var, table, model, *([] if experiment is None else [experiment])), F.lit(suffix))


def parse_numbers(spec: Column | str) -> Column:
    """``"1,6-10"`` as a sorted array of distinct numbers."""
    part = lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.regexp_replace(col(spec), r"\s+", ""), ","), part))))


#: Wind inputs (fixed values): file slot, raw variables, units, and if a pressure level is needed.
WINDS = {
    "uas": ("uas", ("uas",), "m s-1", False),
    "ua": ("uas", ("ua",), "m s-1", True),
    "tauu": ("tauu", ("tauu",), "Pa", False),
    "curltau": ("curltau", ("tauu", "tauv"), "N m-3", False),
}


def wind_spec(spec: Column | str) -> Column:
    """``name[@pascal][:mode]`` taken apart: name, level, mode, canonical form, slot, components, units, suffix and if it is valid.

    A name is valid if it is known and has a positive level exactly where it needs one.  The suffix of baselines is
    empty for the slot of winds.
    """
    s = F.lower(F.regexp_replace(col(spec), r"\s+", ""))
    name = F.regexp_extract(s, r"^([^@:]+)", 1)
    level = F.nullif(F.regexp_extract(s, r"@([0-9.]+)", 1), F.lit("")).cast("double")
    mode = F.nullif(F.regexp_extract(s, r":(\w+)$", 1), F.lit(""))
    plain = F.regexp_replace(level.cast("decimal(20,4)").cast("string"), r"\.?0+$", "")
    canonical = F.concat(name, F.coalesce(F.concat(F.lit("@"), plain), F.lit("")), F.coalesce(F.concat(F.lit(":"), mode), F.lit("")))
    pick = lambda i, wrap=F.lit: F.coalesce(*[F.when(name == k, wrap(v[i])) for k, v in WINDS.items()])
    slot, needs = pick(0), pick(3)
    valid = F.coalesce(F.when(needs, level > 0).otherwise(needs.isNotNull() & ~F.contains(s, F.lit("@"))), F.lit(False))
    return F.struct(
        name.alias("name"), level.alias("level"), mode.alias("mode"), canonical.alias("canonical"), slot.alias("slot"), pick(1, lambda v: F.array(*map(F.lit, v))).alias("components"),
        pick(2).alias("units"), F.when(slot == "uas", "").otherwise(F.concat(F.lit("_"), slot)).alias("suffix"), valid.alias("valid"),
    )


def covariate_tag(names: Column | str) -> Column:
    """A comma list, trimmed and without blanks, joined by ``+``."""
    return F.concat_ws("+", F.filter(F.transform(F.split(col(names), ","), lambda x: F.trim(x)), lambda x: x != ""))


def filter_years(experiment: Column | str) -> Column:
    """The years of a ``_LPF<n>Year`` tag, null if there is none."""
    return F.nullif(F.regexp_extract(col(experiment), r"_LPF(\d+)Year", 1), F.lit("")).cast("int")


def historical_sibling(experiment: Column | str) -> Column:
    return F.regexp_replace(col(experiment), "_[^_]*$", "_historical")


def member_tag(spec: Column | str) -> Column:
    """``_r<first>_r<last>`` of a list of members, with ``_n<count>`` where the list has gaps."""
    members = parse_numbers(spec)
    first, last, n = F.element_at(members, 1), F.element_at(members, -1), F.size(members)
    name = lambda k, x: F.concat(F.lit(k), x.cast("string"))
    return F.concat(name("_r", first), name("_r", last), F.when(n == last - first + 1, "").otherwise(name("_n", n)))


#: Settings of an experiment's name with the values that are not told (fixed values).
EXPERIMENT_DEFAULTS = {
    "residual": True, "pca_x": 0, "pca_y": 64, "activation": "leaky_relu", "loss": "mse", "scale_y": True, "scaler_x": "standard", "neurons": "192x96x48",
    "reg": "0.01", "dropout": "0.2", "batch": 600, "members": 5, "epochs": 2000, "rate": "0.001", "patience": 30, "seed": 0, "folds": 1, "lowpass_months": 24,
}


def experiment_name(**settings: Column) -> Column:
    """The folder name that tells an experiment's settings; those left out have their defaults."""
    if unknown := set(settings) - set(EXPERIMENT_DEFAULTS):
        raise ValueError(f"no settings: {', '.join(sorted(unknown))}")
    of = {k: settings.get(k, F.lit(v)) for k, v in EXPERIMENT_DEFAULTS.items()}
    text = lambda k: of[k].cast("string")

    def tag(before: str, k: str, after: str = "", quiet: object = None) -> Column:
        """``before`` value ``after``, or nothing where the setting has its quiet value."""
        return F.when(of[k] == F.lit(EXPERIMENT_DEFAULTS[k] if quiet is None else quiet), "").otherwise(F.concat(F.lit(before), text(k), F.lit(after)))

    use_x, use_y = of["pca_x"] > 0, of["pca_y"] > 0
    components = F.concat(F.lit("PCAin"), F.when(use_x, F.concat(F.lit("X"), text("pca_x"))).otherwise(""), F.when(use_y, F.concat(F.lit("Y"), text("pca_y"))).otherwise(""))
    return F.concat(
        F.lit("FullDepth_"), F.when(use_y, F.concat(components, F.lit("_"))).otherwise(""), F.when(of["residual"], "ResNet").otherwise("MLP"), F.when(use_x, components).otherwise(""), F.lit("_"),
        F.when(of["scale_y"], "").otherwise("NoYScaler_"), F.when(of["scaler_x"] == "minmax", "MinMaxXScaler_").when(of["scaler_x"] == "robust", "RobustXScaler_").otherwise(""),
        F.lit("Neur"), text("neurons"), F.lit("_"), tag("BS", "batch", "_"), tag("Ens", "members", "_"), tag("Epoch", "epochs", "_"), tag("LR", "rate", "_"), tag("Pat", "patience", "_"),
        tag("Seed", "seed", "_"), F.when(of["folds"] > 1, F.concat(text("folds"), F.lit("foldCV_"))).otherwise(""), F.lit("Reg"), text("reg"),
        F.when(text("dropout").cast("double") == 0, "").otherwise(F.concat(F.lit("Drop"), text("dropout"))), F.when(of["loss"] == "mse", "").otherwise(F.concat(F.lit("_"), text("loss"), F.lit("loss"))),
        F.when(of["activation"] == "leaky_relu", "").otherwise(F.concat(F.lit("_"), text("activation"), F.lit("Activation"))),
        F.when(of["lowpass_months"] > 0, F.concat(F.lit("_LPF"), F.floor(of["lowpass_months"] / 12).cast("string"), F.lit("Year"))).otherwise(""),
    )


def number_slug(value: Column | str, signed: bool = False) -> Column:
    """-45.5 as ``m45p5``, to four places; positive numbers get a ``p`` in front if ``signed``."""
    v = col(value).cast("double")
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.abs(v)), "0+$", ""), r"\.$", "")
    return F.concat(F.when(v < 0, "m").otherwise("p" if signed else ""), F.replace(digits, F.lit("."), F.lit("p")))


def epsilon_slug(value: Column | str) -> Column:
    """0.25 as ``epsilon_2p5e-01``, to eleven places of the mantissa; negative numbers raise an error."""
    v = col(value).cast("double")
    text = F.format_string("%.11e", v)
    mantissa = F.regexp_replace(F.regexp_extract(text, "^([^e]+)", 1), r"\.?0+$", "")
    told = F.concat(F.lit("epsilon_"), F.replace(mantissa, F.lit("."), F.lit("p")), F.lit("e"), F.replace(F.regexp_extract(text, "e(.+)$", 1), F.lit("+"), F.lit("")))
    return F.when(v < 0, F.raise_error(F.lit("epsilon is negative")).cast("string")).when(v == 0, "lrp0_z_rule").otherwise(told)


#: Sources of each kind of input and what a file name says of them (fixed values): nothing of the first.
SOURCES = {
    "pressure": {"GRACE": "", "GRACE_CSR": "_obpCSR"},
    "height": {"DUACS": "", "NASASSH": "_sshNASASSH"},
    "wind": {"CCMP": "", "ERA5": "_ERA5wind"},
}


def source_suffix(pressure: Column | str, height: Column | str, wind: Column | str) -> Column:
    """The suffix of a choice of sources; a source that is not known raises an error."""

    def said(kind: str, source: Column) -> Column:
        known = F.coalesce(*[F.when(source == k, F.lit(v)) for k, v in SOURCES[kind].items()])
        return F.coalesce(known, F.raise_error(F.concat(F.lit(f"{kind}: no source "), source)).cast("string"))

    return F.concat(*[said(k, col(c)) for k, c in (("pressure", pressure), ("height", height), ("wind", wind))])


def latitude_label(lat: Column | str) -> Column:
    v = col(lat)
    return F.concat(F.format_string("%.1f", F.abs(v)), F.lit("°"), F.when(v < 0, "S").otherwise("N"))


def sorted_json(pairs: dict[str, Column | str]) -> Column:
    """A JSON object with its keys in order."""
    return F.to_json(F.struct(*[col(pairs[k]).alias(k) for k in sorted(pairs)]))


def decoded_text(x: Column | str) -> Column:
    """Text that may be bytes of UTF-8, without the zero bytes and white space it is padded with."""
    return F.btrim(F.rtrim(F.decode(col(x).cast("binary"), "UTF-8"), F.lit("\0")))


def decoded_texts(x: Column | str) -> Column:
    """X8 for a vector; nulls stay."""
    return F.transform(col(x), lambda v: F.when(v.isNotNull(), decoded_text(v)))
