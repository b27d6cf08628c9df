"""Reports as compositions of operators, and the status board over them.

A report is a dict of named tables. Tables shared by several reports are
written once to the shared folder, so each report reads prepared rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelkit.config import PanelConfig
from panelkit.functions import columns as X
from panelkit.operators import clean, drift, evaluate, features, ml, network, quality, views
from panelkit.operators.rows import combine
from panelkit.session import materialize
from panelkit.sources.tables import manifest, write_document

Report = dict[str, DataFrame]


def build_events(panel: DataFrame, day: date, mapping: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Enriched rows of one day, cleaned together with the tail of the day before."""
    rows = clean.clean_panel(clean.prev_day_tail(panel, day), cfg)
    return clean.day_only(clean.enrich_events(rows, mapping, cfg), day)


def build_perf(
    panel: DataFrame, day: date, packs: list[ml.ModelPack], cfg: PanelConfig = PanelConfig(), **parts
) -> DataFrame:
    """T -> T+h rows of one day with truth, baseline and the models' predictions.

    Targets come from the adjoining day too, so the last bins of the day have one.
    """
    tail = max(max(cfg.bin_min * 49, 240), max(p.horizon_min for p in packs))
    start = datetime(day.year, day.month, day.day)
    rows = clean.window_filter(
        panel, "tbin_utc", start - timedelta(minutes=tail), start + timedelta(days=1, minutes=tail), "[)"
    )
    targets = features.forecast_targets(rows, tuple(p.horizon_min for p in packs), cfg)
    feats = materialize(ml.feature_frame(rows, cfg, **parts), "features")
    preds = None
    for p in packs:
        scored = ml.predict(feats, p).select(
            "station_id", F.col("target_ts_utc").alias("tbin_target"),
            F.lit(X.strict_horizon_bins(p.horizon_min, cfg.bin_min)).alias("horizon_bins"),
            F.col("bikes_pred").cast("double").alias("y_pred"),
        )
        preds = scored if preds is None else preds.unionByName(scored)
    out = features.attach_predictions(clean.day_only(targets, day), preds)
    return out.withColumns(
        {"occ_ratio": X.occ_ratio(), "h": F.hour("tbin_utc").cast("byte"), "min": F.minute("tbin_utc").cast("byte")}
    )


def build_forecast(
    panel: DataFrame, packs: list[ml.ModelPack], now: datetime, cfg: PanelConfig = PanelConfig(), **parts
) -> DataFrame:
    """Forecast of every station for every horizon, from the recent history."""
    span = timedelta(minutes=49 * cfg.bin_min)
    recent = clean.window_filter(panel, "tbin_utc", now - max(span, timedelta(hours=4)), now, "[]")
    latest = materialize(ml.feature_frame(recent, cfg, latest=True, **parts), "serving")
    out = None
    for p in packs:
        rows = ml.predict(latest, p, now)
        out = rows if out is None else out.unionByName(rows)
    return out


def data_health(df: DataFrame, now: datetime, cfg: PanelConfig = PanelConfig()) -> Report:
    window = clean.health_window(df, now, max(cfg.last_days, 7), cfg.bin_min)
    _, end = clean.health_bounds(now, cfg.last_days, cfg.bin_min)
    bins = materialize(quality.station_bins(window), "station-bins")
    flats = materialize(quality.flat_sequences(quality.one_per_bin(window), cfg), "flat-sequences")
    kpis = materialize(quality.health_kpis(window, end, cfg, bins, flats), "health-kpis")
    found = materialize(quality.anomalies(window, cfg, bins=bins, flats=flats), "anomalies")
    return {
        "kpis": kpis,
        "station_health": quality.station_health(window, cfg, bins),
        "coverage_by_hour": quality.coverage_by_hour(window, cfg),
        "alerts": quality.health_alerts(kpis, cfg),
        "anomalies": quality.worst_anomalies(found, cfg.anomaly_topk),
        "anomaly_counts": quality.anomaly_counts(found),
    }


def data_drift(events: DataFrame, cfg: PanelConfig = PanelConfig()) -> Report:
    feats = drift.feature_columns(events)
    means = materialize(drift.daily_feature_means(events, cfg, feats), "daily-means")
    metrics = materialize(drift.drift_metrics(events, cfg, feats, means), "drift-metrics")
    return {
        "metrics": metrics,
        "summary": drift.drift_summary(metrics, cfg),
        "by_zone": drift.drift_by_zone(events, cfg, means),
        "occ_ratio_ema": drift.occupancy_ema(events, cfg),
        "bounds": drift.drift_bounds(events, cfg),
    }


def model_performance(
    perf: DataFrame, cfg: PanelConfig = PanelConfig(), clusters: DataFrame | None = None,
    horizons: tuple[int, ...] | None = None,
) -> Report:
    p = features.pick_prediction(perf) if "y_hat" not in perf.columns else perf
    if horizons:
        p = p.filter(F.col("horizon_bins").isin(list(horizons)))
    # One scan gives every cut; the single reports are rows of that table.
    cuts = materialize(evaluate.performance_cuts(p, cfg.tz), "performance-cuts")
    cut = lambda name, kind: cuts.filter(F.col("cut") == name).withColumn(name, F.col("key").cast(kind)).drop("cut", "key")
    daily = cut("date", "date")
    out = {
        "kpis": evaluate.performance_global(p),
        "cuts": cuts,
        "daily": daily,
        "lift_curve": evaluate.lift_curve(daily, cfg.last_days),
        "by_hour": cut("hour", "int"),
        "by_dow": cut("dow", "int"),
        "by_station": cut("station_id", "string"),
        "hist_residuals": evaluate.residual_histogram(p, cfg.hist_bins),
        "station_timeseries": evaluate.station_timeseries(p),
    }
    if clusters is not None:
        out["by_cluster"] = evaluate.performance_by_cluster(p, clusters)
    return out


def model_explainability(
    perf: DataFrame, cfg: PanelConfig = PanelConfig(), pack: ml.ModelPack | None = None
) -> Report:
    p = features.pick_prediction(perf) if "y_hat" not in perf.columns else perf
    out = {
        "hist": evaluate.explain_histogram(p),
        "qq": evaluate.qq_points(p),
        "acf": evaluate.acf(p, cfg=cfg),
        "hetero": evaluate.heteroscedasticity(p),
        "error_runs": views.top_error_runs(evaluate.max_error_run(p, cfg.error_run_threshold, cfg), cfg.error_run_topk),
        "calibration_fit": evaluate.calibration_fit(p),
        "calibration_by_hour": evaluate.calibration_fit(p, ("hour",), cfg.tz),
        "calibration_bins": evaluate.calibration_bins(p),
        "relative_error": evaluate.relative_error_levels(p),
        "bias_by_station": evaluate.bias_by_station(p),
        "uncertainty": evaluate.interval_coverage(p, cfg.nominal, cfg.tz),
        "overview": quality.panel_span(p),
    }
    if pack is not None:
        out["feature_importance"] = ml.feature_importance(perf.sparkSession, pack)
    return out


def network_overview(df: DataFrame, cfg: PanelConfig = PanelConfig(), day: date | None = None) -> Report:
    kpis = combine(
        network.snapshot_kpis(df, tz=cfg.tz),
        network.presence_coverage(df, cfg.last_days, cfg.tz),
        network.volatility_today(df, cfg.tz),
    )
    return {
        "kpis": kpis,
        "distribution": network.snapshot_distribution(df),
        "map": network.snapshot_map(df),
        "offline": network.offline_stations(df),
        "today_curve": network.availability_curve(df, day),
        "median_curve": network.reference_curve(df, day, cfg.ref_days, cfg.bin_min),
        "kpis_vs_lags": network.kpis_vs_lags(df, day),
        "station_tension": network.station_tension_rates(df, cfg.last_days, cfg.tz),
    }


def network_dynamics(df: DataFrame, cfg: PanelConfig = PanelConfig()) -> Report:
    recent = materialize(network.exclusive_masks(clean.last_days(df, cfg.last_days, cfg.tz), cfg), "states")
    heat = network.weekly_heatmap(recent, cfg)
    return {
        "heatmap": heat,
        "heatmap_matrix": network.heatmap_matrix(heat),
        "profiles": network.weekday_profiles(heat),
        "hourly": network.hourly_rates(recent, cfg),
        "episodes": network.episodes(recent, cfg),
        "by_zone": network.by_zone(recent, cfg),
        "tension": network.tension_index(recent, cfg),
        "regularity": network.regularity(df, cfg),
    }


def network_stations(events: DataFrame, cfg: PanelConfig = PanelConfig(), k: int | None = None) -> Report:
    spark = events.sparkSession
    profiles = materialize(network.station_profile(events, cfg), "profiles")
    c = ml.cluster_profiles(profiles, k)
    out = {
        "stations": profiles.join(c.labels, "station_id", "left"),
        "centroids": c.centroids,
        "distributions": network.station_distributions(profiles),
        "kpis": profiles.agg(F.count(F.lit(1)).alias("n_stations")).select(
            "n_stations", F.lit(c.k).alias("k"), F.lit(c.silhouette).cast("double").alias("silhouette"),
            F.lit(c.davies_bouldin).cast("double").alias("davies_bouldin"),
        ),
    }
    if profiles.limit(3).count() == 3:
        pca = ml.profile_pca(profiles)
        out["pca_scatter"] = pca.scores.join(c.labels, "station_id", "left")
        out["pca_components"] = pca.components
        out["pca_variance"] = spark.createDataFrame([pca.var_ratio], "pc1 double, pc2 double")
    return out


# ---- status board -------------------------------------------------------------------------


def status_board(
    overview: DataFrame, health: DataFrame, freshness: DataFrame, drift_summary: DataFrame, forecasts: DataFrame,
    now: datetime, cfg: PanelConfig = PanelConfig(),
) -> DataFrame:
    """One row: `kpis`, `statuses` (name, led, value, rows) and `activity`.

    `forecasts` has (horizon_min, generated_at, rows, model_version), one row per
    horizon; the first horizon with a forecast stands for all.
    """
    at = clean.as_ts(now)
    entry = F.struct(
        "horizon_min", "generated_at", "rows", "model_version",
        X.age_minutes("generated_at", at).alias("age_min"),
    )
    fc = forecasts.agg(F.array_sort(F.collect_list(entry)).alias("fc"))
    row = combine(
        overview.select("stations_active"),
        health.select("coverage_global_pct"),
        freshness.select(F.col("p95_min").alias("freshness_p95_min"), "weather_min"),
        drift_summary.select("psi_global", "top_feature", "top_feature_psi"),
        fc,
    )
    up = F.when(F.col("stations_active") > 0, "ok").otherwise("down")
    fc_light = lambda age: X.status_light(age, cfg.forecast_ok_min, cfg.forecast_warn_min)

    def status(name, led, value, rows=None):
        return F.struct(
            (F.lit(name) if isinstance(name, str) else name).alias("name"), led.alias("led"),
            value.cast("double").alias("value"),
            (F.lit(None) if rows is None else rows).cast("long").alias("rows"),
        )

    first = F.try_element_at(F.filter("fc", lambda e: e["generated_at"].isNotNull()), F.lit(1))
    per_horizon = F.transform(
        "fc", lambda e: status(F.concat(F.lit("batch_forecast_h"), e["horizon_min"]), fc_light(e["age_min"]), e["age_min"], e["rows"])
    )
    statuses = F.concat(
        F.array(
            status("api_stations", up, F.col("stations_active")),
            status("batch_forecast", fc_light(first["age_min"]), first["age_min"], first["rows"]),
            status("weather_provider", X.status_light("weather_min", cfg.weather_ok_min, cfg.weather_warn_min), F.col("weather_min")),
            status("data_drift", X.psi_light("psi_global"), F.col("psi_global")),
        ),
        per_horizon,
    )
    versions = F.array_join(F.transform("fc", lambda e: F.coalesce(
        e["model_version"], F.concat(F.lit("h"), e["horizon_min"]))), " / ")
    fact = lambda label, v: F.struct(F.lit(label).alias("label"), v.cast("string").alias("value"))
    activity = F.concat(
        F.array(
            fact("model versions", versions), fact("coverage", F.col("coverage_global_pct")),
            fact("active stations", F.col("stations_active")), fact("global drift", F.col("psi_global")),
        ),
        F.transform("fc", lambda e: F.struct(
            F.concat(F.lit("forecast rows h"), e["horizon_min"]).alias("label"), e["rows"].cast("string").alias("value"))),
    )
    return row.select(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"),
        F.struct(
            "stations_active", "freshness_p95_min", "coverage_global_pct", "psi_global", versions.alias("model_versions")
        ).alias("kpis"),
        statuses.alias("statuses"),
        activity.alias("activity"),
    )


def forecast_status(forecast: DataFrame) -> DataFrame:
    """(horizon_min, generated_at, rows, model_version) of a forecast table."""
    return forecast.groupBy(F.col("horizon_min").cast("int").alias("horizon_min")).agg(
        F.max("pred_ts_utc").alias("generated_at"), F.count(F.lit(1)).alias("rows"),
        F.max("model_version").alias("model_version"),
    )


def forecast_bundle(forecast: DataFrame) -> DataFrame:
    """The rows of a forecast table, each with `generated_at` and `rows` of its horizon's status.

    The forecast is written once by horizon: the status is that of the scored rows handed on.
    """
    scored = materialize(forecast, "forecast", by="horizon_min")
    status = forecast_status(scored).select("horizon_min", "generated_at", "rows")
    # One row per horizon.
    return scored.join(F.broadcast(status), "horizon_min")


def run_monitoring(
    spark: SparkSession, steps: dict[str, Callable[[], Report]], out: str, now: datetime, continue_on_error: bool = True,
) -> dict[str, Exception | None]:
    """Run report builders in order and write their tables and manifest below `out`.

    Returns the error of each step, None where it succeeded.
    """
    result: dict[str, Exception | None] = {}
    for name, build in steps.items():
        try:
            written = {}
            for table, df in build().items():
                write_document(df, f"{out}/{name}", table, now)
                # The manifest counts what was written.
                written[table] = spark.read.text(f"{out}/{name}/{table}/latest")
            write_document(manifest(spark, written, now), f"{out}/{name}", "manifest", now)
            result[name] = None
        except Exception as e:  # noqa: BLE001 - a failed step is reported, not fatal
            if not continue_on_error:
                raise
            result[name] = e
    return result
