"""Model evaluation: error cuts, residuals, calibration, uncertainty.

Inputs carry `y_true`, `y_baseline_persist` and `y_hat` (see `pick_prediction`).
Every report is computed for all horizons at once, grouped by `horizon_bins`.
Tables with one row per horizon (or horizon and hour) are broadcast: their size
follows the list of horizons, not the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.config import ACF_LAGS, EXPLAIN_HIST_BINS, QQ_POINTS, PanelConfig
from panelkit.functions import columns as X
from panelkit.operators.blocks import positions, runs
from panelkit.operators.quantiles import (
    bin_right_closed, counted, quantiles, quantiles_of_counts, unique_edges,
)
from panelkit.operators.rows import small_side
from panelkit.session import materialize

CFG = PanelConfig()
H = "horizon_bins"


def resid() -> Column:
    return F.col("y_true").cast("double") - F.col("y_hat").cast("double")


def error_metrics(y: str, p: str, suffix: str = "") -> list[Column]:
    return [
        X.mae(y, p).alias(f"mae{suffix}"), X.rmse(y, p).alias(f"rmse{suffix}"), X.mean_error(y, p).alias(f"me{suffix}"),
    ]


def _cut_metrics() -> list[Column]:
    return [
        *error_metrics("y_true", "y_hat", "_model"),
        *error_metrics("y_true", "y_baseline_persist", "_baseline"),
        X.percent_present("y_hat").alias("coverage_pred_pct"),
        F.count(F.lit(1)).alias("n"),
    ]


def _with_lift(df: DataFrame) -> DataFrame:
    return df.withColumn("lift_vs_baseline", X.lift("mae_baseline", "mae_model"))


def cut_columns(df: DataFrame, tz: str) -> DataFrame:
    """Local day, hour and weekday of every row."""
    return df.withColumns(
        {
            "date": X.local_day("tbin_utc", tz),
            "hour": X.local_hour("tbin_utc", tz),
            "dow": X.local_dow("tbin_utc", tz),
        }
    )


def performance(perf: DataFrame, by: tuple[str, ...] = (), tz: str = CFG.tz) -> DataFrame:
    """Error of model and baseline per horizon and cut (date, hour, dow, station_id, cluster)."""
    return _with_lift(cut_columns(perf, tz).groupBy(H, *by).agg(*_cut_metrics()))


def performance_global(perf: DataFrame) -> DataFrame:
    return _with_lift(
        perf.groupBy(H).agg(
            *_cut_metrics(),
            F.count_distinct("station_id").alias("stations"),
            F.min("tbin_utc").alias("ts_min"),
            F.max("tbin_utc").alias("ts_max"),
        )
    )


def performance_cuts(perf: DataFrame, tz: str = CFG.tz) -> DataFrame:
    """All cuts in one scan: rows (horizon, cut, key) for global, date, hour, dow and station."""
    dims = ["date", "hour", "dow", "station_id"]
    d = cut_columns(perf, tz)
    sets = [[F.col(H)]] + [[F.col(H), F.col(c)] for c in dims]
    grouped = d.groupingSets(sets, F.col(H), *[F.col(c) for c in dims]).agg(
        *_cut_metrics(), F.grouping_id().alias("_g")
    )
    # grouping_id: bits for (horizon, date, hour, dow, station); 0 marks the grouped ones.
    full = 2 ** len(dims) - 1
    cut, key = F.lit("global"), F.lit(None).cast("string")
    for i, c in enumerate(dims):
        here = F.col("_g") == full - 2 ** (len(dims) - 1 - i)
        cut = F.when(here, F.lit(c)).otherwise(cut)
        key = F.when(here, F.col(c).cast("string")).otherwise(key)
    return _with_lift(grouped.withColumns({"cut": cut, "key": key})).drop("_g", *dims)


def performance_by_cluster(perf: DataFrame, clusters: DataFrame) -> DataFrame:
    """The cluster cut; stations without a label are left out."""
    labels = clusters.select("station_id", "cluster").filter("cluster is not null")
    return _with_lift(perf.join(small_side(labels), "station_id").groupBy(H, "cluster").agg(*_cut_metrics()))


def lift_curve(daily: DataFrame, last: int | None = None) -> DataFrame:
    """Daily lift; `last` keeps the latest days of each horizon."""
    out = daily.select(H, "date", "lift_vs_baseline")
    if last:
        w = Window.partitionBy(H).orderBy(F.desc("date"))
        out = out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= last).drop("_rn")
    return out


def horizons_available(perf: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Requested horizons (bins) that the table holds."""
    asked = perf.sparkSession.createDataFrame([(int(h),) for h in horizons], f"{H} int")
    return asked.join(perf.select(H).distinct(), H, "left_semi")


# ---- residuals --------------------------------------------------------------------------------


def scored(perf: DataFrame) -> DataFrame:
    """Rows with finite truth and prediction, and their residual."""
    rows = perf.filter("y_true is not null and y_hat is not null").withColumn("resid", resid())
    return rows.filter(F.abs(F.col("resid").cast("double")) < float("inf"))


def value_pairs(perf: DataFrame) -> DataFrame:
    """(horizon, y_true, y_hat, resid, _w): distinct truth and prediction with their frequency, written once."""
    rows = perf.select(H, "y_true", "y_hat", resid().alias("resid"))
    return materialize(rows.groupBy(H, "y_true", "y_hat", "resid").agg(F.count(F.lit(1)).alias("_w")), "value-pairs")


def _weighted(pairs: DataFrame, groups: list[str], value) -> DataFrame:
    """Value counts (see `counted`) from counts of pairs."""
    return counted(pairs, groups, value, F.col("_w"))


def weighted_mean(value) -> Column:
    v = X.col(value).cast("double")
    return F.sum(v * F.col("_w")) / F.sum(F.when(v.isNotNull(), F.col("_w")))


def residual_histogram(perf: DataFrame, bins: int = CFG.hist_bins) -> DataFrame:
    """Equal-width histogram of residuals within +-p99 of their size; empty bins included."""
    used = value_pairs(scored(perf))
    q = quantiles_of_counts(_weighted(used, [H], F.abs("resid")), [H], [0.99], name="_q")
    top99 = F.col("_q")[0]
    half = q.select(H, F.when(top99 > 0, top99).otherwise(X.dbl(1)).alias("half"), F.col("n"))
    step = F.col("half") * X.dbl(2) / X.dbl(bins)
    edge = lambda i: i * step - F.col("half")
    guess = F.least(F.floor((F.col("resid") + F.col("half")) / step), F.lit(bins - 1))
    # Rounding can put a value one bin off its edge; the edges decide.
    fixed = F.when(F.col("resid") < edge(F.col("_b")), F.col("_b") - 1).when(
        (F.col("resid") >= edge(F.col("_b") + 1)) & (F.col("_b") < bins - 1), F.col("_b") + 1
    ).otherwise(F.col("_b"))
    counts = (
        used.join(F.broadcast(half), H)
        .filter(F.abs("resid") <= F.col("half"))
        .withColumn("_b", guess)
        .groupBy(H, fixed.cast("int").alias("bin"))
        .agg(F.sum("_w").alias("count"))
    )
    grid = half.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [H, "bin"], "left").select(
        H, "bin", edge(F.col("bin")).alias("bin_left"), edge(F.col("bin") + 1).alias("bin_right"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def explain_histogram(perf: DataFrame) -> DataFrame:
    return residual_histogram(perf, EXPLAIN_HIST_BINS)


def qq_points(perf: DataFrame, m: int = QQ_POINTS) -> DataFrame:
    """m quantiles of the standardised residuals against their theoretical values."""
    used = scored(perf)
    probs = [(2 * i + 1) / (2 * m) for i in range(m)]
    q = quantiles(used, [H], "resid", probs, name="_q").drop("n")
    stats = used.groupBy(H).agg(F.avg("resid").alias("_mu"), F.stddev_pop("resid").alias("_sd"))
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(X.dbl(1))
    p = (F.col("i") * X.dbl(2) + X.dbl(1)) / X.dbl(2 * m)
    return (
        q.join(F.broadcast(stats), H)
        .select(H, "_mu", "_sd", F.posexplode("_q").alias("i", "_v"))
        .select(H, "i", X.normal_quantile(p).alias("theoretical"), ((F.col("_v") - F.col("_mu")) / sd).alias("empirical"))
    )


def acf(perf: DataFrame, nlags: int = ACF_LAGS, cfg: PanelConfig = CFG, parity: bool = True) -> DataFrame:
    """Autocorrelation of the mean residual per timestamp, lags by position.

    parity=True sums the published range of pairs, k fewer at lag k than the
    usual estimator, which parity=False gives. The series has one row per bin.
    """
    series = materialize(scored(perf).groupBy(H, "tbin_utc").agg(F.avg("resid").alias("_r")), "residual-series")
    stats = series.groupBy(H).agg(
        F.avg("_r").alias("_mu"), F.count(F.lit(1)).alias("_n")
    )
    x = positions(series, "tbin_utc", cfg.bin_min, cfg.block_bins, [H]).join(F.broadcast(stats), H).select(
        H, "pos", "_n", (F.col("_r") - F.col("_mu")).alias("_x")
    )
    shifted = x.select(
        H, F.col("_x").alias("_y"), F.col("pos").alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(nlags))).alias("lag")
    ).select(H, "lag", "_y", (F.col("_p") + F.col("lag")).alias("pos"))
    pairs = x.join(shifted, [H, "pos"])
    if parity:
        pairs = pairs.filter(F.col("pos") <= F.col("_n") - 1 - F.col("lag"))
    sums = pairs.groupBy(H, "lag").agg(F.sum(F.col("_x") * F.col("_y")).alias("_s"))
    total = x.groupBy(H).agg(F.sum(F.col("_x") * F.col("_x")).alias("_d"))
    grid = total.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(nlags))))
    value = F.when(F.col("lag") == 0, F.when(F.col("_d") > 0, X.dbl(1))).otherwise(
        F.try_divide(F.coalesce("_s", X.dbl(0)), F.col("_d"))
    )
    return grid.join(sums, [H, "lag"], "left").select(H, "lag", F.coalesce(value, X.dbl(0)).alias("acf"))


def heteroscedasticity(perf: DataFrame, q: int = 20) -> DataFrame:
    """MAE per quantile bin of the truth."""
    binned = _quantile_bins(value_pairs(scored(perf)), "y_true", q)
    return binned.groupBy(H, "bin").agg(weighted_mean(F.abs("resid")).alias("mae"), F.sum("_w").alias("n"))


def _quantile_bins(pairs: DataFrame, value: str, q: int) -> DataFrame:
    """`bin` of counted pairs over (a, b] quantile bins of `value`; equal edges merge."""
    edges = quantiles_of_counts(_weighted(pairs, [H], value), [H], [i / q for i in range(q + 1)], name="_q").select(
        H, unique_edges("_q").alias("_edges")
    )
    return (
        pairs.join(F.broadcast(edges), H)
        .withColumn("bin", bin_right_closed(F.col(value).cast("double"), "_edges"))
        .drop("_edges")
        .filter("bin is not null")
    )


def max_error_run(
    perf: DataFrame, threshold: float = CFG.error_run_threshold, cfg: PanelConfig = CFG
) -> DataFrame:
    """Longest run of large errors of every station and horizon that has one."""
    used = scored(perf)
    keys = ["station_id", H]
    longest = runs(used, keys, "tbin_utc", F.abs("resid") >= threshold, cfg.bin_min, cfg.block_bins).groupBy(*keys).agg(
        F.max(F.when(F.col("state"), F.col("n"))).alias("max_run"), F.sum("n").alias("n")
    )
    return longest.filter("max_run > 0")


# ---- calibration ------------------------------------------------------------------------------


def calibration_fit(perf: DataFrame, by: tuple[str, ...] = (), tz: str = CFG.tz) -> DataFrame:
    """Least squares y = alpha + beta * y_hat per horizon, or per horizon and local hour."""
    y, p = F.col("y_true").cast("double"), F.col("y_hat").cast("double")
    return cut_columns(scored(perf), tz).groupBy(H, *by).agg(
        F.regr_intercept(y, p).alias("alpha"), F.regr_slope(y, p).alias("beta"), F.count(F.lit(1)).alias("n")
    )


def calibration_bins(perf: DataFrame, q: int = 20) -> DataFrame:
    """Mean prediction and mean truth per quantile bin of the prediction."""
    binned = _quantile_bins(value_pairs(perf.filter("y_hat is not null")), "y_hat", q)
    return binned.groupBy(H, "bin").agg(
        weighted_mean("y_hat").alias("y_pred_mean"), weighted_mean("y_true").alias("y_true_mean"), F.sum("_w").alias("n"),
    )


def relative_error_levels(perf: DataFrame, q: int = 3) -> DataFrame:
    """Mean |error| / max(1, y) per tercile of the truth."""
    binned = _quantile_bins(value_pairs(scored(perf)), "y_true", q)
    rel = F.abs("resid") / F.greatest(F.col("y_true").cast("double"), X.dbl(1))
    return binned.groupBy(H, F.col("bin").alias("level")).agg(weighted_mean(rel).alias("mape_like"), F.sum("_w").alias("n"))


def bias_by_station(perf: DataFrame) -> DataFrame:
    """Mean residual per station with its last description, where the table has one."""
    used = perf.filter("y_hat is not null").withColumn("resid", resid())
    extra = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("tbin_utc"))).alias(c)
        for c in ("lat", "lon", "name") if c in perf.columns
    ]
    return used.groupBy(H, "station_id").agg(F.avg("resid").alias("bias"), F.count(F.lit(1)).alias("n"), *extra)


# ---- uncertainty --------------------------------------------------------------------------------


def interval_coverage(perf: DataFrame, nominal: float = CFG.nominal, tz: str = CFG.tz) -> DataFrame:
    """Share of truths inside the interval: given bands, else sigma bands, else hourly residual quantiles."""
    used = scored(perf)
    inside = lambda lo, hi: F.avg(F.col("y_true").between(lo, hi).cast("int").cast("double")).alias("empirical")
    n = F.count(F.lit(1)).alias("n")
    # The first kind of interval that any row has; a column of nulls is no interval.
    if {"yhat_lo", "yhat_hi"} <= set(perf.columns):
        banded = used.filter("yhat_lo is not null and yhat_hi is not null")
        if not banded.isEmpty():
            return banded.groupBy(H).agg(inside(F.col("yhat_lo"), F.col("yhat_hi")), n).withColumns(
                {"method": F.lit("provided_bands"), "nominal": X.dbl(nominal)}
            )
    if "yhat_std" in perf.columns:
        spread = F.col("yhat_std") * X.dbl(X.z_for_nominal(nominal))
        sigma = used.filter("yhat_std is not null")
        if not sigma.isEmpty():
            return sigma.groupBy(H).agg(inside(F.col("y_hat") - spread, F.col("y_hat") + spread), n).withColumns(
                {"method": F.lit("parametric_sigma"), "nominal": X.dbl(nominal)}
            )
    tail = (1.0 - nominal) / 2.0
    hourly = used.withColumn("hour", X.local_hour("tbin_utc", tz))
    q = quantiles(hourly, [H, "hour"], "resid", [tail, 1.0 - tail], name="_q").drop("n")
    lo, hi = F.col("y_hat") + F.col("_q")[0], F.col("y_hat") + F.col("_q")[1]
    return hourly.join(F.broadcast(q), [H, "hour"]).groupBy(H).agg(inside(lo, hi), n).withColumns(
        {"method": F.lit("residual_quantiles/by_hour"), "nominal": X.dbl(nominal)}
    )


# ---- series ---------------------------------------------------------------------------------------


def station_timeseries(perf: DataFrame, hours: int = 24, min_points: int = 12) -> DataFrame:
    """Truth, prediction and baseline over the last full hours for one station per horizon.

    The station: the first by id with enough points, else the one with most points.
    """
    end = F.date_trunc("hour", perf.agg(F.max("tbin_utc")).scalar())
    win = perf.filter(
        (F.col("tbin_utc") < end) & (F.col("tbin_utc") >= end - F.expr(f"interval {int(hours)} hours"))
    )
    rank = F.struct((F.col("_n") >= min_points).cast("int").alias("ok"),
                    F.when(F.col("_n") >= min_points, 0).otherwise(F.col("_n")).alias("n"))
    pick = (
        win.groupBy(H, "station_id").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy(H).orderBy(rank.desc(), "station_id")))
        .filter("_rn = 1")
        .select(H, "station_id")
    )
    return win.join(F.broadcast(pick), [H, "station_id"]).select(
        H, "station_id", "tbin_utc", "y_true", F.col("y_hat").alias("y_pred"), F.col("y_baseline_persist").alias("y_base")
    )

