"""Column expressions: pure JVM-side maths, no UDF."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0
METERS_PER_DEG_LON = 75_000.0
METERS_PER_DEG_LAT = 111_000.0
LN_SQRT_A = 0.147
# Two-sided normal quantiles per nominal level.
Z_TABLE = {0.80: 1.28155, 0.85: 1.43953, 0.90: 1.64485, 0.95: 1.95996, 0.98: 2.32635, 0.99: 2.57583}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(x: float) -> Column:
    """A double literal: Spark types `1.0` in SQL text as decimal."""
    return F.lit(float(x))


def epoch_s(ts) -> Column:
    return F.unix_timestamp(col(ts))


def floor_bin(ts, bin_min: int) -> Column:
    """Start of the grid bin that holds `ts`."""
    s = epoch_s(ts)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(bin_min * 60)))


def minutes_between(later, earlier) -> Column:
    return (epoch_s(later) - epoch_s(earlier)) / dbl(60)


# ---- local time -----------------------------------------------------------------


def local_ts(ts, tz: str | None) -> Column:
    c = col(ts)
    return F.from_utc_timestamp(c, tz) if tz else c


def local_day(ts, tz: str | None) -> Column:
    return F.to_date(local_ts(ts, tz))


def local_hour(ts, tz: str | None) -> Column:
    return F.hour(local_ts(ts, tz))


def local_dow(ts, tz: str | None) -> Column:
    """Monday is 0."""
    return F.weekday(local_ts(ts, tz))


def hhmm(ts, tz: str | None = None) -> Column:
    return F.date_format(local_ts(ts, tz), "HH:mm")


# ---- stock ----------------------------------------------------------------------


def ratio(num, den) -> Column:
    """num/den as double where den > 0, else null."""
    n, d = col(num), col(den)
    return F.when(d > 0, n.cast("double") / d.cast("double"))


def occ_ratio(bikes="bikes", capacity="capacity") -> Column:
    return ratio(bikes, capacity)


def floor0(x) -> Column:
    """max(x, 0); null stays null (`greatest` alone would give 0)."""
    c = col(x)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0)))


def unit_interval(x) -> Column:
    """Values outside [0, 1] are not an occupancy."""
    c = col(x)
    return F.when(c.between(0.0, 1.0), c)


def docks_available(bikes="bikes", capacity="capacity", docks=None) -> Column:
    derived = floor0(col(capacity) - col(bikes))
    return F.coalesce(col(docks), derived) if docks is not None else derived


def flag(cond: Column) -> Column:
    """Byte flag; an undecidable condition counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("byte")


def rate(cond: Column) -> Column:
    """Share of rows meeting `cond`, null conditions left out."""
    return F.avg(cond.cast("int").cast("double"))


def station_status(status="status", renting="is_renting", returning="is_returning") -> Column:
    open_ = (F.coalesce(col(renting), F.lit(1)) == 1) & (F.coalesce(col(returning), F.lit(1)) == 1)
    return F.coalesce(col(status), F.when(open_, F.lit("OK")).otherwise(F.lit("CLOSED")))


def clip_round(pred, capacity=None) -> Column:
    """Prediction clipped to [0, capacity] (no upper clip without one), half-to-even, integer."""
    p = F.greatest(col(pred).cast("double"), dbl(0))
    if capacity is not None:
        p = F.coalesce(F.when(p > col(capacity), col(capacity).cast("double")), p)
    return F.when(col(pred).isNotNull(), F.rint(p)).cast("int")


def horizon_bins(bins=None, minutes=None, bin_min: int = 5) -> Column:
    """Horizon in bins from a bins column, else from minutes."""
    parts = []
    if bins is not None:
        parts.append(F.rint(col(bins).cast("double")))
    if minutes is not None:
        parts.append(F.rint(col(minutes).cast("double") / dbl(bin_min)))
    return F.coalesce(*parts).cast("int")


def strict_horizon_bins(minutes: int, bin_min: int) -> int:
    """Bins of a requested horizon; a horizon off the grid is an error."""
    if minutes <= 0 or minutes % bin_min:
        raise ValueError(f"horizon of {minutes} min is not a multiple of the {bin_min} min bin")
    return minutes // bin_min


def trim_code(code) -> Column:
    """Station code without leading zeros; empty becomes null."""
    stripped = F.regexp_replace(F.trim(col(code).cast("string")), "^0+", "")
    return F.when(stripped != "", stripped)


def backfilled_id(station_id="station_id", code="stationcode") -> Column:
    sid = F.trim(col(station_id).cast("string"))
    return F.coalesce(F.when(sid != "", sid), col(code).cast("string"))


# ---- geography --------------------------------------------------------------------


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    la1, lo1, la2, lo2 = (F.radians(col(c).cast("double")) for c in (lat1, lon1, lat2, lon2))
    half = dbl(2)
    s1, s2 = F.sin((la2 - la1) / half), F.sin((lo2 - lo1) / half)
    a = s1 * s1 + F.cos(la1) * F.cos(la2) * s2 * s2
    return dbl(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.sqrt(a), dbl(1)))


def grid_cell(lat, lon, meters: float = 300.0) -> tuple[Column, Column]:
    x = F.floor(col(lon) / dbl(meters / METERS_PER_DEG_LON)).cast("int")
    y = F.floor(col(lat) / dbl(meters / METERS_PER_DEG_LAT)).cast("int")
    return x, y


def zone_label(lat, lon, digits: int, sep: str, district=None, fallback: str | None = None) -> Column:
    """Rounded-coordinate label; a named district wins."""
    scale = dbl(10**digits)
    la, lo = F.rint(col(lat) * scale) / scale, F.rint(col(lon) * scale) / scale
    label = F.when(la.isNotNull() & lo.isNotNull(), F.concat_ws(sep, la.cast("string"), lo.cast("string")))
    parts = ([col(district).cast("string")] if district is not None else []) + [label]
    if fallback is not None:
        parts.append(F.lit(fallback))
    return F.coalesce(*parts)


# ---- calendar ---------------------------------------------------------------------


def calendar_columns(ts="tbin_utc", tz: str = "Europe/Paris") -> dict[str, Column]:
    """UTC and local calendar features with their cyclic encodings."""
    t, loc = col(ts), local_ts(ts, tz)
    dow, local_d = F.weekday(t), F.weekday(loc)
    day_angle = (F.hour(t) + F.minute(t) / dbl(60)) / dbl(24) * F.pi() * dbl(2)
    week_angle = dow / dbl(7) * F.pi() * dbl(2)
    return {
        "hour": F.hour(t),
        "minute": F.minute(t),
        "dow": dow,
        "month": F.month(t),
        "is_weekend": (dow >= 5).cast("byte"),
        "hod_sin": F.sin(day_angle),
        "hod_cos": F.cos(day_angle),
        "dow_sin": F.sin(week_angle),
        "dow_cos": F.cos(week_angle),
        "paris_hour": F.hour(loc),
        "paris_dow": local_d,
        "paris_is_we": (local_d >= 5).cast("byte"),
    }


# ---- metrics ----------------------------------------------------------------------


def mae(y, p) -> Column:
    return F.avg(F.abs(col(y).cast("double") - col(p).cast("double")))


def rmse(y, p) -> Column:
    e = col(y).cast("double") - col(p).cast("double")
    return F.sqrt(F.avg(e * e))


def mean_error(y, p) -> Column:
    return F.avg(col(y).cast("double") - col(p).cast("double"))


def lift(mae_base, mae_model) -> Column:
    b, m = col(mae_base), col(mae_model)
    return F.when(b != 0, (b - m) / b)


def percent_present(p) -> Column:
    return F.avg(col(p).isNotNull().cast("int").cast("double")) * dbl(100)


def erf_inverse(x: Column, a: float = LN_SQRT_A) -> Column:
    """Winitzki's approximation: with L = ln(1 - x^2) and b = 2/(pi a) + L/2, sgn(x) (sqrt(b^2 - L/a) - b)^(1/2)."""
    log = F.log1p(-x * x)
    b = log / dbl(2) + dbl(2 / (math.pi * a))
    return F.signum(x) * F.pow(F.pow(b * b - log / dbl(a), dbl(0.5)) - b, dbl(0.5))


def normal_quantile(p: Column) -> Column:
    """Theoretical QQ coordinate of a probability, kept inside the open interval by 1e-6.

    As published without the factor sqrt(2); multiply for true z values.
    """
    edge = dbl(1 - 1e-6)
    return erf_inverse(F.greatest(-edge, F.least(edge, p * dbl(2) - dbl(1))))


def z_for_nominal(p: float) -> float:
    """Two-sided normal quantile of a nominal level by linear interpolation; 90 % stands in outside the table."""
    levels = np.array(sorted(Z_TABLE))
    inside = levels[0] <= p <= levels[-1]
    return float(np.interp(p, levels, [Z_TABLE[level] for level in levels])) if inside else Z_TABLE[0.90]


# ---- status lights ------------------------------------------------------------------


def age_minutes(ts, now) -> Column:
    return F.greatest(minutes_between(now, ts), dbl(0))


# Bounds of the PSI light.
PSI_BOUNDS = ((0.10, "ok"), (0.20, "warn"))


def first_bound(x, bounds, reached, otherwise: str) -> Column:
    """The label of the first (bound, label) with `reached(x, bound)`; null values have none."""
    hits = [F.when(reached(col(x), dbl(bound)), F.lit(label)) for bound, label in bounds]
    return F.coalesce(*hits, F.lit(otherwise))


def status_light(x, ok: float, warn: float, higher_is_better: bool = False) -> Column:
    """ok, warn or down, bounds included; thresholds of a better-when-higher figure are given negated."""
    reached = (lambda v, b: v >= -b) if higher_is_better else (lambda v, b: v <= b)
    return first_bound(x, ((ok, "ok"), (warn, "warn")), reached, "down")


def psi_light(psi) -> Column:
    return first_bound(psi, PSI_BOUNDS, lambda v, b: v < b, "down")
