"""History features: lags, rolling statistics, trend, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelkit.config import LAG_BINS, ROLL_BINS, PanelConfig
from panelkit.functions import columns as X
from panelkit.operators.blocks import block_window, drop_halo, with_halo
from panelkit.operators.clean import dedup_latest
from panelkit.operators.quantiles import is_count
from panelkit.operators.rows import small_side

STATION = ["station_id"]
WEATHER = ("temp_C", "precip_mm", "wind_mps")


class _Frames:
    """Window frames over one blocked panel, by row or by grid time."""

    def __init__(self, cfg: PanelConfig, mode: str):
        self.mode, self.step = mode, cfg.step_s
        self.rows = block_window(STATION, "tbin_utc")
        self.time = block_window(STATION, "_e")

    def at(self, col: str, offset: int):
        """Value `offset` bins away (negative: earlier)."""
        if self.mode == "rows":
            return F.lag(col, -offset).over(self.rows) if offset < 0 else F.lead(col, offset).over(self.rows)
        s = offset * self.step
        return F.max(col).over(self.time.rangeBetween(s, s))

    def previous(self, n: int):
        if self.mode == "rows":
            return self.rows.rowsBetween(-n, -1)
        return self.time.rangeBetween(-n * self.step, -self.step)


def _blocked(df: DataFrame, cfg: PanelConfig, mode: str, before: int = 0, after: int = 0):
    halo = with_halo(df, STATION, "tbin_utc", cfg.bin_min, before, after, cfg.block_bins, mode)
    return halo.withColumn("_e", F.unix_timestamp("tbin_utc")), _Frames(cfg, mode)


def _finish(df: DataFrame) -> DataFrame:
    return drop_halo(df).drop("_e")


def lags(
    df: DataFrame, col: str = "bikes", bins: tuple[int, ...] = LAG_BINS,
    cfg: PanelConfig = PanelConfig(), mode: str = "rows",
) -> DataFrame:
    b, f = _blocked(df, cfg, mode, before=max(bins))
    return _finish(b.withColumns({f"lag_{col}_{n}": f.at(col, -n) for n in bins}))


def lead_target(df: DataFrame, bins: int, cfg: PanelConfig = PanelConfig(), mode: str = "rows") -> DataFrame:
    b, f = _blocked(df, cfg, mode, after=bins)
    return _finish(b.withColumn("y_nb", f.at("bikes", bins)))


def rolling(
    df: DataFrame, col: str = "bikes", bins: tuple[int, ...] = ROLL_BINS,
    cfg: PanelConfig = PanelConfig(), mode: str = "rows",
) -> DataFrame:
    b, f = _blocked(df, cfg, mode, before=max(bins))
    return _finish(_rolling(b, f, col, bins))


def _rolling(b: DataFrame, f: _Frames, col: str, bins: tuple[int, ...]) -> DataFrame:
    """Mean and sample deviation of the rows before the current one.

    For counts by row: differences of running sums, exact in integers, so the
    cost does not grow with the width. Otherwise the frames themselves.
    """
    if f.mode == "rows" and is_count(b, col):
        return _rolling_counts(b, f, col, bins)
    out = {}
    for n in bins:
        w = f.previous(n)
        enough = F.count(col).over(w) >= max(1, n // 2)
        out[f"roll_mean_{n}"] = F.when(enough, F.avg(col).over(w))
        out[f"roll_std_{n}"] = F.when(enough, F.stddev_samp(col).over(w))
    return b.withColumns(out)


def _rolling_counts(b: DataFrame, f: _Frames, col: str, bins: tuple[int, ...]) -> DataFrame:
    upto = f.rows.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(col).cast("long")
    runs = b.withColumns({"_s": F.sum(x).over(upto), "_q": F.sum(x * x).over(upto), "_n": F.count(x).over(upto)})

    def within(c: str, n: int):
        total = lambda k: F.coalesce(F.lag(c, k).over(f.rows), F.lit(0))
        return total(1) - total(n + 1)

    sums = runs.withColumns({f"{c}{n}": within(c, n) for n in bins for c in ("_s", "_q", "_n")})
    out = {}
    for n in bins:
        s, q, k = (F.col(f"{c}{n}") for c in ("_s", "_q", "_n"))
        enough = k >= max(1, n // 2)
        out[f"roll_mean_{n}"] = F.when(enough, s / k)
        out[f"roll_std_{n}"] = F.when(enough & (k > 1), F.sqrt((k * q - s * s) / (k * (k - 1))))
    return sums.withColumns(out).drop("_s", "_q", "_n", *[f"{c}{n}" for n in bins for c in ("_s", "_q", "_n")])


def _trend_columns(f: _Frames, step: int, bins: int = 12) -> dict:
    """Least-squares slope per bin over the previous rows."""
    w, x = f.previous(bins), F.col("_e") / X.dbl(step)
    return {
        f"trend_nb_{bins}b": F.regr_slope(F.col("bikes").cast("double"), x).over(w),
        f"trend_occ_{bins}b": F.regr_slope(X.occ_ratio(), x).over(w),
    }


def trend_slope(df: DataFrame, bins: int = 12, cfg: PanelConfig = PanelConfig(), mode: str = "rows") -> DataFrame:
    b, f = _blocked(df, cfg, mode, before=bins)
    return _finish(b.withColumns(_trend_columns(f, cfg.step_s, bins)))


def weather_lag1(df: DataFrame, cfg: PanelConfig = PanelConfig(), mode: str = "rows") -> DataFrame:
    b, f = _blocked(df, cfg, mode, before=1)
    return _finish(b.withColumns({f"{c}_lag1": f.at(c, -1) for c in WEATHER}))


def history_features(
    df: DataFrame, cfg: PanelConfig = PanelConfig(), mode: str = "rows", targets: dict[str, int] | None = None,
) -> DataFrame:
    """Lags, rolling statistics, trend, weather lag (and targets, bins ahead by name) in one pass over one blocking."""
    targets = targets or {}
    b, f = _blocked(df, cfg, mode, before=max(*LAG_BINS, *ROLL_BINS), after=max(targets.values(), default=0))
    cols = {f"lag_bikes_{n}": f.at("bikes", -n) for n in LAG_BINS}
    cols |= _trend_columns(f, cfg.step_s)
    cols |= {f"{c}_lag1": f.at(c, -1) for c in WEATHER}
    cols |= {name: f.at("bikes", n) for name, n in targets.items()}
    return _finish(_rolling(b.withColumns(cols), f, "bikes", ROLL_BINS)).withColumn("occ_ratio", X.occ_ratio())


def calendar_features(df: DataFrame, ts: str = "tbin_utc", tz: str = "Europe/Paris") -> DataFrame:
    return df.withColumns(X.calendar_columns(ts, tz))


def latest_rows(df: DataFrame, order: tuple[str, ...] = ("tbin_utc",)) -> DataFrame:
    """The last row of each station; `order` is unique within a station."""
    return dedup_latest(df, STATION, order, unique=True)


def last_bins(df: DataFrame, bins: int, ts: str = "tbin_utc") -> DataFrame:
    """The last `bins` rows of each station of a clean panel: a rank limit, pruned in every map task."""
    order = Window.partitionBy("station_id").orderBy(F.desc(ts))
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= bins).drop("_rn")


def recent_history(df: DataFrame, minutes: int = 60, ts: str = "tbin_utc", bin_min: int | None = None) -> DataFrame:
    """Rows within `minutes` of their station's last row, from one scan.

    Callers of a clean panel, with one row per station and bin of `bin_min` minutes, say so: then these are at most
    minutes / bin_min + 1 rows, and a rank limit comes before the time filter. Otherwise time alone decides.
    """
    tail = df if bin_min is None else last_bins(df, minutes // bin_min + 1, ts)
    last = F.max(ts).over(Window.partitionBy("station_id"))
    return tail.withColumn("_last", last).filter(F.unix_timestamp("_last") - F.unix_timestamp(ts) <= minutes * 60).drop("_last")


def join_weather(df: DataFrame, weather: DataFrame, ts: str = "tbin_utc") -> DataFrame:
    """Hourly weather on the hour of the bin; one row per hour, broadcast while that is few."""
    return (
        df.withColumn("hour_utc", F.date_trunc("hour", ts))
        .join(small_side(weather), "hour_utc", "left")
        .drop("hour_utc")
    )


def forecast_targets(
    df: DataFrame, horizons_min: tuple[int, ...], cfg: PanelConfig = PanelConfig(), keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per (row, horizon): stock at T + h and the persistence baseline.

    The target is looked up by time inside blocks, so all horizons share one
    shuffle and the last bins of a day find their target in the next day.
    """
    bins = [X.strict_horizon_bins(h, cfg.bin_min) for h in horizons_min]
    b, f = _blocked(df, cfg, "time", after=max(bins))
    pairs = F.array(
        *[F.struct(F.lit(n).alias("horizon_bins"), f.at("bikes", n).alias("y_true")) for n in bins]
    )
    keep = tuple(dict.fromkeys(("tbin_utc", "station_id", "bikes", "capacity", *keep)))
    return (
        _finish(b.withColumn("_p", pairs))
        .select(*keep, F.explode("_p").alias("_p"))
        .select(
            *keep, "_p.horizon_bins", "_p.y_true",
            F.col("bikes").alias("y_baseline_persist"),
            F.timestamp_seconds(F.unix_timestamp("tbin_utc") + F.col("_p.horizon_bins") * cfg.step_s).alias("tbin_target"),
        )
    )


def attach_features(perf: DataFrame, features: DataFrame) -> DataFrame:
    """Features at the anchor bin; the columns perf already has are kept from perf."""
    extra = [c for c in features.columns if c in ("tbin_utc", "station_id") or c not in perf.columns]
    return perf.join(features.select(*extra), ["tbin_utc", "station_id"], "left")


def attach_predictions(perf: DataFrame, predictions: DataFrame, col: str = "y_pred") -> DataFrame:
    """Predictions keyed by their target time (and horizon, where they carry one)."""
    on = ["station_id", "tbin_target"] + (["horizon_bins"] if "horizon_bins" in predictions.columns else [])
    return perf.join(predictions.select(*on, col), on, "left").withColumn(
        "y_pred_int", X.clip_round(col, "capacity")
    )


def pick_prediction(df: DataFrame) -> DataFrame:
    """`y_hat`: the integer prediction where the table has one, else the float one."""
    have = [c for c in ("y_pred_int", "y_pred") if c in df.columns]
    if not have:
        raise ValueError("no prediction column")
    return df.withColumn("y_hat", F.col(have[0]))


def panel_apply(df: DataFrame, fn, schema) -> DataFrame:
    """User extension point: a pandas function per station; no built-in uses it."""
    return df.groupBy("station_id").applyInPandas(fn, schema)
