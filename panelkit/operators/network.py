"""Network reports: snapshot, curves, tension, episodes, zones, profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.config import PanelConfig
from panelkit.functions import columns as X
from panelkit.operators.blocks import block_window, drop_halo, runs, with_halo
from panelkit.operators.clean import last_days, last_ts, today_window
from panelkit.operators.quantiles import quantiles
from panelkit.operators.rows import combine, day_bins, hours, week_hours
from panelkit.session import materialize

CFG = PanelConfig()
HUNDRED = 100.0
DEFAULT_STEP_MIN = 15.0


def _docks(df: DataFrame) -> Column:
    return X.docks_available(docks="docks" if "docks" in df.columns else None)


def _pct(cond: Column) -> Column:
    return X.rate(cond) * HUNDRED


# ---- snapshot -----------------------------------------------------------------------


def snapshot(df: DataFrame) -> DataFrame:
    """Rows at the latest timestamp with `docks`."""
    return df.filter(F.col("tbin_utc") == last_ts(df)).withColumn("docks", _docks(df))


def snapshot_kpis(df: DataFrame, universe: DataFrame | None = None, tz: str = CFG.tz) -> DataFrame:
    """Active and offline stations and availability at the latest timestamp, one row."""
    known = (universe if universe is not None else df).agg(F.count_distinct("station_id").alias("stations_universe"))
    now = snapshot(df).agg(
        F.max("tbin_utc").alias("snapshot_ts_utc"),
        X.local_ts(F.max("tbin_utc"), tz).alias("snapshot_ts_local"),
        F.count_distinct("station_id").alias("stations_active"),
        _pct(F.col("bikes") > 0).alias("availability_bike_pct"),
        _pct(F.col("docks") > 0).alias("availability_dock_pct"),
        _pct(F.col("bikes") == 0).alias("penury_pct"),
        _pct(F.col("docks") == 0).alias("saturation_pct"),
    )
    return combine(known, now).withColumn(
        "stations_offline", F.greatest(F.col("stations_universe") - F.col("stations_active"), F.lit(0))
    )


def offline_stations(df: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """The stations of the universe without a row at the latest timestamp."""
    known = (universe if universe is not None else df).select("station_id").distinct()
    return known.join(snapshot(df).select("station_id"), "station_id", "left_anti")


def snapshot_distribution(df: DataFrame) -> DataFrame:
    """Counts and shares of the four states at the latest timestamp."""
    counts = snapshot(df).agg(
        F.count_distinct("station_id").alias("total_active"),
        F.count_if(F.col("bikes") > 0).alias("bike_avail"),
        F.count_if(F.col("docks") > 0).alias("dock_avail"),
        F.count_if(F.col("bikes") == 0).alias("penury"),
        F.count_if(F.col("docks") == 0).alias("saturation"),
    )
    rows = counts.unpivot("total_active", ["bike_avail", "dock_avail", "penury", "saturation"], "metric", "count")
    return rows.withColumn("pct", F.try_divide("count", "total_active") * HUNDRED)


def snapshot_map(df: DataFrame) -> DataFrame:
    return snapshot(df).select(
        "station_id",
        F.coalesce("name", "station_id").alias("name"),
        "lat", "lon", "bikes",
        F.col("docks").alias("docks_avail"),
        X.flag(F.col("bikes") == 0).alias("is_penury"),
        X.flag(F.col("docks") == 0).alias("is_saturation"),
    )


def availability_view(df: DataFrame) -> DataFrame:
    """Latest state of every station with non-negative counts."""
    last = df.groupBy("station_id").agg(
        F.max_by(F.struct("name", "lat", "lon", "capacity", "bikes"), "tbin_utc").alias("s")
    )
    cap, bikes = F.coalesce("s.capacity", F.lit(0)), F.coalesce("s.bikes", F.lit(0))
    return last.select(
        "station_id", "s.name", "s.lat", "s.lon", cap.alias("capacity"),
        F.greatest(bikes, F.lit(0)).alias("num_bikes_available"),
        F.greatest(cap - bikes, F.lit(0)).alias("num_docks_available"),
    )


# ---- coverage, volatility, curves ---------------------------------------------------------


def presence_coverage(df: DataFrame, days: int = CFG.last_days, tz: str = CFG.tz) -> DataFrame:
    """Mean share of the network's timestamps each station was seen at."""
    seen = last_days(df, days, tz).select("station_id", "tbin_utc").distinct()
    total = seen.agg(F.count_distinct("tbin_utc")).scalar()
    per = seen.groupBy("station_id").agg(F.count(F.lit(1)).alias("_n")).select((F.col("_n") / total).alias("_c"))
    return per.agg((F.avg("_c") * HUNDRED).alias("coverage_pct"))


def volatility_today(df: DataFrame, tz: str = CFG.tz) -> DataFrame:
    """Median over stations of the population deviation of stock in the last local day."""
    per = today_window(df, tz).groupBy("station_id").agg(F.stddev_pop("bikes").alias("_sd"))
    q = quantiles(per, [], "_sd", [0.5], name="_q")
    return combine(q.agg(F.coalesce(F.max(F.col("_q")[0]), X.dbl(0)).alias("volatility_today")))


def last_day(df: DataFrame) -> Column:
    """UTC day of the latest timestamp."""
    return F.to_date(last_ts(df))


def _day(df: DataFrame, day) -> Column:
    return last_day(df) if day is None else F.lit(day)


def availability_curve(df: DataFrame, day: date | None = None) -> DataFrame:
    """Share of stations with a bike at every timestamp of one UTC day."""
    return _curve(df.filter(F.to_date("tbin_utc") == _day(df, day)))


def _curve(df: DataFrame) -> DataFrame:
    return df.groupBy("tbin_utc").agg(_pct(F.col("bikes") > 0).alias("pct")).select(
        "tbin_utc", X.hhmm("tbin_utc").alias("hhmm"), "pct"
    )


def reference_curve(
    df: DataFrame, day: date | None = None, ref_days: int = CFG.ref_days, bin_min: int = CFG.bin_min
) -> DataFrame:
    """Median curve of the same weekday over the days before, on the full day grid."""
    d, target = F.to_date("tbin_utc"), _day(df, day)
    past = df.filter(
        (d < target) & (d >= F.date_sub(target, ref_days)) & (F.weekday("tbin_utc") == F.weekday(target))
    )
    med = _curve(past).groupBy("hhmm").agg(F.percentile("pct", 0.5).alias("pct_median"))
    return day_bins(df.sparkSession, bin_min).join(med, "hhmm", "left")


def kpis_vs_lags(df: DataFrame, day: date | None = None, lags: tuple[int, ...] = (7, 14, 21)) -> DataFrame:
    """Day-mean availability for a day and the same day some weeks earlier, in one pass."""
    d, target = F.to_date("tbin_utc"), _day(df, day)
    wanted = F.array(*[F.struct(F.lit(n).alias("lag_days"), F.date_sub(target, n).alias("date")) for n in (0, *lags)])
    back = F.date_diff(target, d)
    stats = (
        df.filter(back.isin(0, *lags))
        .withColumns({"docks": _docks(df), "_lag": back})
        .groupBy("_lag")
        .agg(
            _pct(F.col("bikes") > 0).alias("avail_bike"),
            _pct(F.col("docks") > 0).alias("avail_dock"),
            _pct(F.col("bikes") == 0).alias("pen"),
            _pct(F.col("docks") == 0).alias("sat"),
        )
    )
    dim = df.sparkSession.range(1).select(F.explode(wanted).alias("w")).select("w.*")
    return dim.join(stats, F.col("lag_days") == F.col("_lag"), "left").drop("_lag")


def station_tension_rates(df: DataFrame, days: int | None = CFG.last_days, tz: str = CFG.tz) -> DataFrame:
    """Share of empty and of full readings per station, worst first."""
    w = df if days is None else last_days(df, days, tz)
    full = (F.col("docks") == 0) if "docks" in df.columns else (F.col("capacity") - F.col("bikes") <= 0)
    return (
        w.groupBy("station_id")
        .agg(X.rate(F.col("bikes") == 0).alias("penury_rate"), X.rate(full).alias("saturation_rate"))
        .orderBy(F.desc("penury_rate"), F.desc("saturation_rate"), "station_id")
    )


# ---- occupancy with exclusive states ---------------------------------------------------------


def _capacity(docks: bool) -> Column:
    b = X.floor0("bikes")
    stock = F.percentile(b, 0.98)
    if docks:
        stock = F.coalesce(F.percentile(b + X.floor0("docks"), 0.98), stock)
    declared = F.max("capacity")
    return F.coalesce(F.when(declared > 0, declared.cast("double")), stock)


def capacity_estimate(df: DataFrame, keys: tuple[str, ...] = ("station_id",)) -> DataFrame:
    """Largest declared capacity, else the 98th percentile of bikes + docks, else of bikes.

    The percentiles run over dock counts: their buffers hold as many entries as
    there are distinct counts, however many rows a station has.
    """
    return df.groupBy(*keys).agg(_capacity("docks" in df.columns).alias("cap_est"))


def exclusive_masks(df: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    """`cap_est`, `occ` in [0,1], `valid`, and the states is_sat / is_pen, never both."""
    out = df if "cap_est" in df.columns else df.join(capacity_estimate(df), "station_id", "left")
    b, c = X.floor0("bikes"), F.col("cap_est")
    occ = F.when((c > 0) & b.isNotNull(), F.least(b / c, X.dbl(1)))
    full = (F.col("docks") == 0) if "docks" in df.columns else (c - b <= cfg.saturation_threshold)
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    return (
        out.withColumn("occ", occ)
        .withColumn("valid", F.col("occ").isNotNull())
        .withColumn("is_sat", F.col("valid") & yes(full))
        .withColumn("is_pen", F.col("valid") & ~F.col("is_sat") & yes(b <= cfg.penury_threshold))
    )


def _state_rates() -> list[Column]:
    return [
        F.avg("occ").alias("occ_mean"),
        X.rate(F.col("is_pen")).alias("penury_rate"),
        X.rate(F.col("is_sat")).alias("saturation_rate"),
        F.count_if(F.col("valid")).alias("n_obs"),
    ]


def _masked(df: DataFrame, cfg: PanelConfig) -> DataFrame:
    return df if "is_pen" in df.columns and "is_sat" in df.columns else exclusive_masks(df, cfg)


def weekly_heatmap(df: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    """Local weekday x hour: mean occupancy and state rates, all 168 cells."""
    cells = (
        _masked(df, cfg)
        .groupBy(X.local_dow("tbin_utc", cfg.tz).alias("dow"), X.local_hour("tbin_utc", cfg.tz).alias("hour"))
        .agg(*_state_rates())
    )
    return week_hours(df.sparkSession).join(cells, ["dow", "hour"], "left").withColumn(
        "n_obs", F.coalesce("n_obs", F.lit(0))
    )


def heatmap_matrix(heatmap: DataFrame, value: str = "occ_mean") -> DataFrame:
    """One row per weekday with one column per hour."""
    return heatmap.groupBy("dow").pivot("hour", list(range(24))).agg(F.max(value))


def weekday_profiles(heatmap: DataFrame) -> DataFrame:
    """Per weekday the 24 hourly mean occupancies as an array."""
    cell = F.collect_list(F.struct("hour", "occ_mean"))
    return heatmap.groupBy("dow").agg(F.transform(F.array_sort(cell), lambda s: s["occ_mean"]).alias("profile"))


def hourly_rates(df: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    agg = (
        _masked(df, cfg)
        .groupBy(X.local_hour("tbin_utc", cfg.tz).alias("hour"))
        .agg(X.rate(F.col("is_pen")).alias("penury_rate"), X.rate(F.col("is_sat")).alias("saturation_rate"))
    )
    return hours(df.sparkSession).join(agg, "hour", "left")


def step_median(df: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    """Median positive gap between a station's readings, minutes; 15 without any."""
    halo = with_halo(df.select("station_id", "tbin_utc"), ["station_id"], "tbin_utc", cfg.bin_min, before=1,
                     block_bins=cfg.block_bins)
    prev = F.lag("tbin_utc").over(block_window(["station_id"], "tbin_utc"))
    gaps = drop_halo(halo.withColumn("gap", X.minutes_between("tbin_utc", prev))).filter("gap > 0")
    q = quantiles(gaps, [], "gap", [0.5], name="_q")
    return q.agg(F.coalesce(F.max(F.col("_q")[0]), X.dbl(DEFAULT_STEP_MIN)).alias("step_min"))


def episodes(df: DataFrame, cfg: PanelConfig = CFG, days: int | None = None, min_minutes: float = 60.0) -> DataFrame:
    """Penury and saturation episodes: runs of at least `min_minutes` of consecutive readings."""
    w = _masked(df if days is None else last_days(df, days, cfg.tz), cfg)
    step = step_median(w, cfg).scalar()
    # A numeric state keeps the run aggregation hash-based.
    state = F.when(F.col("is_pen"), 1).when(F.col("is_sat"), 2)
    kind = F.when(F.col("state") == 1, "penury").otherwise("saturation")
    need = F.greatest(F.rint(X.dbl(min_minutes) / step), X.dbl(1))
    return (
        runs(w, ["station_id"], "tbin_utc", state, cfg.bin_min, cfg.block_bins)
        .filter(F.col("state").isNotNull() & (F.col("n") >= need))
        .select(
            "station_id", kind.alias("type"), F.col("start").alias("start_utc"),
            F.col("end").alias("end_utc"), F.col("n").alias("steps"), (F.col("n") * step).alias("duration_min"),
        )
    )


def by_zone(df: DataFrame, cfg: PanelConfig = CFG, days: int | None = None) -> DataFrame:
    """Rates per coordinate zone and the summed capacity of its stations."""
    w = _masked(df if days is None else last_days(df, days, cfg.tz), cfg).withColumn(
        "zone", X.zone_label("lat", "lon", 3, "|", fallback="NA")
    )
    rates = w.groupBy("zone").agg(*_state_rates())
    cap = (
        w.filter("cap_est is not null")
        .groupBy("station_id", "zone")
        .agg(F.max_by("cap_est", "tbin_utc").alias("cap_est"))
        .groupBy("zone")
        .agg(F.sum("cap_est").alias("cap_sum"))
    )
    return rates.join(cap, "zone", "left").select(
        "zone", "occ_mean", "penury_rate", "saturation_rate", "cap_sum", "n_obs"
    )


def tension_index(df: DataFrame, cfg: PanelConfig = CFG, days: int | None = None) -> DataFrame:
    """Rates, mean occupancy and last description per station; index = penury + saturation."""
    w = _masked(df if days is None else last_days(df, days, cfg.tz), cfg)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("tbin_utc"))).alias(c)
    zero = lambda c: F.coalesce(F.col(c), X.dbl(0))
    out = w.groupBy("station_id").agg(*_state_rates(), last("name"), last("lat"), last("lon"))
    return out.withColumn("tension_index", zero("penury_rate") + zero("saturation_rate")).select(
        "station_id", "name", "lat", "lon", "penury_rate", "saturation_rate", "occ_mean", "tension_index", "n_obs"
    )


# ---- regularity and profiles -------------------------------------------------------------------


def regularity(df: DataFrame, cfg: PanelConfig = CFG, ref_curves: int = 90, min_common: int = 8) -> DataFrame:
    """Correlation of each station's curve today with its median curve of the same weekday.

    The days are picked first (a rank limit, pruned in every map task); only their
    rows are shaped, and they are written once.
    """
    day = X.local_day("tbin_utc", cfg.tz)
    today = df.agg(F.max(day)).scalar()
    docks = [c for c in ("docks",) if c in df.columns]
    rows = df.select("station_id", "bikes", "capacity", *docks, day.alias("_day"), X.hhmm("tbin_utc", cfg.tz).alias("_hhmm")).filter(
        (F.col("_day") == today) | ((F.col("_day") < today) & (F.weekday("_day") == F.weekday(today)))
    )
    keys = ["station_id", "_day"]
    recent = Window.partitionBy("station_id").orderBy(F.desc("_day"))
    # Today, where the station has it, and the reference days before.
    days = (
        rows.select(*keys).distinct().withColumn("_now", F.col("_day") == today)
        .withColumn("_rn", F.row_number().over(recent))
        .filter(F.col("_rn") <= ref_curves + 1)
        .withColumn("_rn", F.col("_rn") - F.max(F.col("_now").cast("int")).over(Window.partitionBy("station_id")))
        .filter(F.col("_now") | (F.col("_rn") <= ref_curves))
        .select(*keys, "_now")
    )
    picked = materialize(rows.join(days, keys), "regularity-days")
    stock = F.percentile(X.floor0("bikes"), 0.98)
    scale = picked.groupBy(*keys).agg(_capacity(bool(docks)).alias("_cap"), F.when(stock > 0, stock).alias("_stock"))
    full = F.coalesce(F.when(F.col("_cap") > 0, F.col("_cap")), F.col("_stock"))
    share = F.when(full.isNotNull(), F.least(X.floor0("bikes") / full, X.dbl(1))).otherwise(X.dbl(0))
    occ = F.when(F.col("bikes").isNotNull(), share)
    curves = picked.join(scale, keys).groupBy(*keys, "_hhmm", "_now").agg(F.avg(occ).alias("_occ"))
    # One row per station and minute of the day: its value today and its median before.
    at = curves.groupBy("station_id", "_hhmm").agg(
        F.max(F.when(F.col("_now"), F.col("_occ"))).alias("_occ"),
        F.percentile(F.when(~F.col("_now"), F.col("_occ")), 0.5).alias("_typ"),
        F.bool_or("_now").alias("_here"),
    )
    both = F.col("_occ").isNotNull() & F.col("_typ").isNotNull()
    o, t = F.when(both, F.col("_occ")), F.when(both, F.col("_typ"))
    moving = (F.min(o) < F.max(o)) & (F.min(t) < F.max(t))
    # Pearson by its parts: `corr` itself fails on a flat curve in ANSI mode.
    pearson = F.try_divide(F.covar_pop(o, t), F.stddev_pop(o) * F.stddev_pop(t))
    return at.groupBy("station_id").agg(
        F.when((F.count(o) >= min_common) & moving, pearson).alias("regularity_corr_today_vs_typical"),
        F.bool_or("_here").alias("_here"),
    ).filter("_here").drop("_here")


def station_profile(df: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    """Description, rates and 24-hour mean occupancy of every station with enough bins."""
    raw = F.col("occ_ratio") if "occ_ratio" in df.columns else X.occ_ratio()
    d = df.withColumns({"_occ": X.unit_interval(raw), "_h": F.hour("tbin_utc")})
    flags = {"is_penury", "is_saturation"} <= set(df.columns)
    day = F.to_date("tbin_utc")
    span = df.agg((F.date_diff(F.max(day), F.min(day)) + 1).alias("d")).scalar()
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("tbin_utc"))).alias(c)
    share = lambda c: (F.avg(F.col(c).cast("double")) if flags else F.lit(None).cast("double"))
    return (
        d.groupBy("station_id")
        .agg(
            F.count("_occ").alias("bins_seen"),
            last("name"), last("lat"), last("lon"),
            F.percentile("capacity", 0.5).alias("capacity_est"),
            F.when(F.count("_occ") > 1, F.stddev_pop("_occ")).alias("volatility"),
            share("is_penury").alias("penury_rate"),
            share("is_saturation").alias("saturation_rate"),
            F.array(*[F.avg(F.when(F.col("_h") == h, F.col("_occ"))) for h in range(24)]).alias("profile"),
        )
        .filter(F.col("bins_seen") >= cfg.min_bins_keep)
        .withColumn(
            "coverage_pct",
            F.least(F.col("bins_seen") / F.greatest(span * cfg.bins_per_day, F.lit(1)), X.dbl(1)) * HUNDRED,
        )
    )


def station_distributions(profiles: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram over stations of coverage, volatility and the two rates (percent)."""
    long = profiles.select(
        F.explode(
            F.array(
                F.struct(F.lit("coverage_pct").alias("metric"), F.col("coverage_pct").alias("v")),
                F.struct(F.lit("volatility").alias("metric"), F.col("volatility").alias("v")),
                F.struct(F.lit("penury_pct").alias("metric"), (F.col("penury_rate") * 100).alias("v")),
                F.struct(F.lit("saturation_pct").alias("metric"), (F.col("saturation_rate") * 100).alias("v")),
            )
        ).alias("m")
    ).select("m.*").filter("v is not null")
    # One row per metric (four), so the copy sent to every task is bounded.
    span = long.groupBy("metric").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / X.dbl(bins)
    bin_ = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1))
    return (
        long.join(F.broadcast(span), "metric")
        .groupBy("metric", bin_.alias("bin"), "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("metric", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_left"), "n")
    )
