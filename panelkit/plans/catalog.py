"""Every operator as a named query over the test tables.

Results are made comparable across engines by `canon`: times as text, integers
as long, floats rounded to six digits. The nudge of 1e-9 keeps values that sit
exactly between two roundings (such as n/128) from falling either way with the
order of a sum.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelkit.config import LAG_BINS, ROLL_BINS, PanelConfig
from panelkit.functions import columns as X
from panelkit.operators import clean, drift, evaluate, features, network, quality, spatial, views
from panelkit.operators.quantiles import quantiles
from panelkit.operators.rows import small_side
from panelkit.session import materialize, tune
from panelkit.sources import adapters as A

CFG = A.EVENTS_CFG
NOW = datetime(2024, 1, 31, 12, 0, 0)
DAY = date(2024, 1, 24)
DRIFT_CFG = PanelConfig(bin_min=360, block_bins=64, last_days=10, ref_days=15)
HORIZONS = (360, 720)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def canon(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.BooleanType, T.IntegralType)):
            c = c.cast("long")
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double") + 1e-9, 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return canon(fn(tune(spark), sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# ---- shared frames --------------------------------------------------------------------


def raw(s, d):
    return A.raw_snapshots(s, d)


def panel(s, d):
    return A.panel(s, d)


def events(s, d):
    return clean.stock_flags(panel(s, d)).withColumn("occ_ratio", X.occ_ratio())


def weathered(s, d):
    return features.join_weather(panel(s, d), A.weather(s, d))


def health(s, d):
    """Raw rows of the 14 days before NOW."""
    return clean.health_window(raw(s, d), NOW, 14, CFG.bin_min)


def perf(s, d):
    """Targets at +1 and +2 bins; the prediction is the mean of the three rows before."""
    p = features.rolling(panel(s, d), bins=(3,), cfg=CFG)
    t = features.forecast_targets(p, HORIZONS, CFG, keep=("lat", "lon", "name", "roll_mean_3"))
    t = t.withColumnRenamed("roll_mean_3", "y_pred").withColumn("y_pred_int", X.clip_round("y_pred"))
    return features.pick_prediction(t)


def float_perf(s, d):
    return perf(s, d).withColumn("y_hat", F.col("y_pred"))


def clusters(s, d):
    return panel(s, d).select("station_id").distinct().withColumn(
        "cluster", (F.col("station_id").cast("long") % 4).cast("int")
    )


def stations(s, d):
    return spatial.stations_of(panel(s, d))


# ---- cleaning -------------------------------------------------------------------------------


@query
def enforce_schema(s, d):
    """Fourteen typed columns from a table with missing, extra and textual columns."""
    src = A.table(s, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts_utc"),
        F.col("user_id").alias("station_id"),
        F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("bikes"),
        F.col("event_type").alias("status"),
        F.col("value").alias("temp_C"),
    )
    return clean.enforce_schema(src).select("station_id", "ts_utc", "tbin_utc", "bikes", "capacity", "status", "temp_C")


@query
def resolve_columns(s, d):
    """Aliased source names mapped to the panel's names."""
    from panelkit.schema import resolve_columns as resolve

    src = raw(s, d).select(
        F.col("tbin_utc").alias("Timestamp"), F.col("station_id").alias("stationcode"), F.col("bikes").alias("velos"),
        F.col("capacity").alias("num_docks_total"), F.col("ingested_at").alias("received_at"),
    )
    return resolve(src, ("tbin_utc", "station_id", "bikes")).groupBy("station_id").agg(
        F.sum("bikes").alias("bikes"), F.max("capacity").alias("capacity"), F.max("ingested_at").alias("ingested_at"),
        F.min("tbin_utc").alias("tbin_utc"),
    )


@query
def repair_grid(s, d):
    """Bins that are null, off the grid or right, all put on the 5-minute grid."""
    r = raw(s, d)
    broken = F.when(F.col("event_id") % 3 == 0, F.lit(None)).when(F.col("event_id") % 3 == 1, F.col("ts_utc")).otherwise(
        X.floor_bin("ts_utc", 5))
    return clean.repair_grid(r.withColumn("tbin_utc", broken), 5).select("event_id", "tbin_utc")


@query
def dedup_latest(s, d):
    """The last snapshot of every station and bin."""
    return panel(s, d).select("station_id", "tbin_utc", "ts_utc", "event_id", "bikes", "status")


@query
def health_window_bounds(s, d):
    """Rows per day in the (start, end] window that ends yesterday."""
    return health(s, d).groupBy(F.to_date("tbin_utc").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query
def local_days_window(s, d):
    """Rows per local day in the window of whole local days."""
    w = clean.local_days_window(panel(s, d), NOW, 10, CFG.bin_min, CFG.tz)
    return w.groupBy(X.local_day("tbin_utc", CFG.tz).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query
def enriched_events(s, d):
    """Occupancy, stock flags, status code and clock columns on the panel."""
    rows = clean.enforce_schema(panel(s, d))
    e = clean.enrich_events(rows, clean.status_mapping(rows), CFG)
    return e.select("station_id", "tbin_utc", "occ_ratio", "is_penury", "is_saturation", "status_code", "h", "min")


@query
def valid_occupancy(s, d):
    """Occupancy ratios outside [0, 1] become null."""
    return panel(s, d).groupBy("station_id").agg(
        F.avg(X.unit_interval(X.occ_ratio())).alias("occ_mean"), F.count(X.unit_interval(X.occ_ratio())).alias("n"),
        F.avg(X.docks_available().cast("double")).alias("docks_mean"),
    )


@query
def calendar_features(s, d):
    """UTC and local calendar columns with cyclic encodings."""
    cols = list(X.calendar_columns())
    return features.calendar_features(panel(s, d)).select("station_id", "tbin_utc", *cols)


@query
def station_geometry(s, d):
    """Distance to the centre, grid cell and zone label per station."""
    gx, gy = X.grid_cell("lat", "lon")
    return stations(s, d).select(
        "station_id", X.haversine_km("lat", "lon", X.dbl(48.853), X.dbl(2.349)).alias("dist_center_km"),
        gx.alias("grid_x"), gy.alias("grid_y"), X.zone_label("lat", "lon", 2, ",").alias("zone2"),
        X.zone_label("lat", "lon", 3, "|", fallback="NA").alias("zone3"),
    )


@query
def clip_round(s, d):
    """Predictions clipped to [0, capacity] and rounded half to even."""
    pred = (F.floor("value") % 60 - 10) + 0.5
    e = A.table(s, d, "events").select("event_id", pred.alias("p"), (20 + F.col("user_id") % 11).alias("cap"))
    return e.select("event_id", X.clip_round("p", "cap").alias("clipped"), X.clip_round("p").alias("unclipped"))


@query
def horizon_normalised(s, d):
    """Horizon in bins from a bins column, else from minutes."""
    e = A.table(s, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 12).alias("hb"),
        (F.col("user_id") % 60).alias("hm"),
    )
    return e.select("event_id", X.horizon_bins("hb", "hm", 5).alias("horizon_bins"))


@query
def station_code_clean(s, d):
    """Codes without leading zeros, with a fallback id and an opening status."""
    e = A.table(s, d, "events").select(
        "event_id", F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"),
        F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("string")).alias("sid"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("status"),
        (F.col("event_id") % 2).cast("int").alias("rent"), F.lit(1).alias("ret"),
    )
    return e.select(
        "event_id", X.trim_code("code").alias("code"), X.backfilled_id("sid", "code").alias("station_id"),
        X.station_status("status", "rent", "ret").alias("status"),
    )


@query
def status_lights(s, d):
    """Lights for ages and drift values."""
    age = X.age_minutes("ts_utc", F.lit("2024-01-15 00:00:00").cast("timestamp"))
    r = raw(s, d).select("event_id", age.alias("age_min"), (F.col("bikes") / 100.0).alias("psi"))
    return r.select(
        "event_id", "age_min", X.status_light("age_min", 7, 2000).alias("light"),
        X.psi_light("psi").alias("psi_light"), X.status_light("psi", -0.2, -0.1, True).alias("score_light"),
    )


@query
def best_day(s, d):
    """As-of day: latest day up to the anchor, and the first one after a too early anchor."""
    days = panel(s, d).select(F.to_date("tbin_utc").alias("date"))
    a = clean.best_day(days, date(2024, 1, 20)).withColumn("anchor", F.lit("2024-01-20"))
    b = clean.best_day(days, date(2023, 12, 1)).withColumn("anchor", F.lit("2023-12-01"))
    return a.unionByName(b)


# ---- joins, windows -----------------------------------------------------------------------------


@query
def weather_join(s, d):
    """Hourly weather on the hour of each bin."""
    return weathered(s, d).select("station_id", "tbin_utc", "temp_C", "precip_mm", "wind_mps")


@query
def forecast_targets(s, d):
    """Stock at T + h and persistence baseline for two horizons."""
    return features.forecast_targets(panel(s, d), HORIZONS, CFG)


@query
def forecast_pairs(s, d):
    """Targets with anchor features and a prediction joined at the target time."""
    p = panel(s, d)
    t = features.forecast_targets(p, (360,), CFG)
    anchored = features.attach_features(t, p.select("station_id", "tbin_utc", "mechanical", "ebike"))
    preds = features.rolling(p, bins=(3,), cfg=CFG).select(
        "station_id", F.col("tbin_utc").alias("tbin_target"), F.col("roll_mean_3").alias("y_pred"))
    return features.attach_predictions(anchored, preds).select(
        "station_id", "tbin_utc", "y_true", "mechanical", "ebike", "y_pred", "y_pred_int")


@query
def lag_features(s, d):
    """Lags of stock by row."""
    return features.lags(panel(s, d), cfg=CFG).select(
        "station_id", "tbin_utc", *[f"lag_bikes_{n}" for n in (1, 2, 3, 6, 12, 24, 36, 48)])


@query
def lag_features_by_time(s, d):
    """Lags of stock by grid time: a gap gives null."""
    return features.lags(panel(s, d), cfg=CFG, mode="time").select("station_id", "tbin_utc", *[f"lag_bikes_{n}" for n in LAG_BINS])


@query
def rolling_features(s, d):
    """Rolling mean and deviation of the rows before."""
    return features.rolling(panel(s, d), cfg=CFG).select(
        "station_id", "tbin_utc", *[f"roll_{f}_{n}" for n in ROLL_BINS for f in ("mean", "std")])


@query
def rolling_features_by_time(s, d):
    """Rolling mean and deviation over the grid time before."""
    return features.rolling(panel(s, d), cfg=CFG, mode="time").select(
        "station_id", "tbin_utc", *[f"roll_{f}_{n}" for n in ROLL_BINS for f in ("mean", "std")])


@query
def trend_slope(s, d):
    """Least-squares trend over the previous 12 rows."""
    return features.trend_slope(panel(s, d), cfg=CFG).select("station_id", "tbin_utc", "trend_nb_12b", "trend_occ_12b")


@query
def lead_target(s, d):
    """Stock three rows ahead and weather one row back."""
    return features.weather_lag1(features.lead_target(weathered(s, d), 3, CFG), CFG).select(
        "station_id", "tbin_utc", "y_nb", "temp_C_lag1")


@query
def latest_features(s, d):
    """One serving row per station: last row with its history features."""
    tail = features.last_bins(panel(s, d), max(*LAG_BINS, *ROLL_BINS) + 1)
    f = features.latest_rows(features.history_features(features.join_weather(tail, A.weather(s, d)), CFG))
    return f.select("station_id", "tbin_utc", "bikes", "occ_ratio", "lag_bikes_1", "lag_bikes_12", "roll_mean_6",
                    "roll_std_12", "trend_nb_12b", "temp_C_lag1")


@query
def recent_history(s, d):
    """Rows within two days of each station's last row."""
    return features.recent_history(panel(s, d), 2880, bin_min=CFG.bin_min).select("station_id", "tbin_utc", "bikes")


@query
def prev_day_tail(s, d):
    """One day with the last hours of the day before."""
    return clean.prev_day_tail(panel(s, d), DAY, 720).select("station_id", "tbin_utc", "bikes")


@query
def last_non_null(s, d):
    """Latest non-null name per station."""
    return clean.last_non_null(panel(s, d), ["name", "lat"], ["station_id"])


@query
def step_median(s, d):
    """Median gap between readings."""
    return network.step_median(panel(s, d), CFG)


@query
def knn_map(s, d):
    """Five nearest stations of every station."""
    return spatial.knn_map(stations(s, d), 5)


@query
def neighbour_mean(s, d):
    """Mean stock of the five nearest stations one, three and twelve bins ago."""
    p = materialize(panel(s, d), "panel")
    return spatial.neighbour_mean(p, small_side(spatial.knn_map(spatial.stations_of(p), 5)), cfg=CFG).select(
        "station_id", "tbin_utc", "knn_mean_bikes_lag1", "knn_mean_bikes_lag3", "knn_mean_bikes_lag12")


@query
def cluster_capacity_mean(s, d):
    """Mean capacity of each station's cluster."""
    st = stations(s, d).join(clusters(s, d), "station_id")
    return spatial.cluster_capacity_mean(st, "cluster").select("station_id", "cluster", "te_cap_mean")


# ---- quality ---------------------------------------------------------------------------------------


@query
def feed_freshness(s, d):
    """Age quantiles of the source timestamps and of the weather."""
    latest = features.latest_rows(raw(s, d).withColumnRenamed("ts_utc", "src_ts_utc"), ("src_ts_utc",))
    return quality.feed_freshness(latest, NOW, A.weather(s, d))


@query
def oldest_stations(s, d):
    """The 50 stations heard from least recently."""
    latest = features.latest_rows(raw(s, d).withColumnRenamed("ts_utc", "src_ts_utc"), ("src_ts_utc",))
    return quality.oldest_stations(latest, NOW)


@query
def panel_freshness(s, d):
    """Age of the last bins: p50, p95, objective."""
    return quality.panel_freshness(health(s, d), datetime(2024, 1, 30, 18), 5)


@query
def coverage_global(s, d):
    """Mean coverage over the days present."""
    return quality.coverage_global(health(s, d), CFG)


@query
def coverage_active(s, d):
    """Coverage between first and last sighting, plain, filtered and weighted."""
    h = health(s, d)
    a = quality.coverage_active(h, CFG).withColumn("kind", F.lit("plain"))
    b = quality.coverage_active(h, CFG, min_frac=0.5).withColumn("kind", F.lit("active"))
    c = quality.coverage_active(h, CFG, weighted=True).withColumn("kind", F.lit("weighted"))
    return a.unionByName(b).unionByName(c)


@query
def coverage_by_hour(s, d):
    """Mean coverage per local hour of day."""
    hourly = PanelConfig(bin_min=60)
    h = clean.health_window(raw(s, d).withColumn("tbin_utc", X.floor_bin("ts_utc", 60)), NOW, 14, 60)
    return quality.coverage_by_hour(h, hourly)


@query
def station_health(s, d):
    """Observed, expected and missing bins per station."""
    return quality.station_health(health(s, d), CFG)


@query
def supplier_gaps(s, d):
    """Presence coverage of a wide, gappy daily panel."""
    return quality.presence_table(A.supplier_panel(s, d), A.DAILY_CFG)


@query
def ingest_latency(s, d):
    """p50 and p95 of the ingestion delay."""
    return quality.ingest_latency(raw(s, d), 360, ts="ts_utc")


@query
def duplicates(s, d):
    """Extra rows per station and bin."""
    return quality.duplicates(raw(s, d))


@query
def flat_sequences(s, d):
    """Stretches of unchanged stock of at least two steps."""
    return quality.flat_sequences(panel(s, d), CFG, min_steps=2)


@query
def anomalies(s, d):
    """Flat, duplicate and missing-bin anomalies, the worst 100 of each kind."""
    cfg = PanelConfig(bin_min=360, block_bins=64, flat_steps=2)
    p = health(s, d)
    return quality.worst_anomalies(quality.anomalies(p, cfg), 100).select("type", "station_id", "steps", "dups", "missing", "expected")


@query
def anomaly_counts(s, d):
    """Number of anomalies per kind."""
    cfg = PanelConfig(bin_min=360, block_bins=64, flat_steps=2)
    return quality.anomaly_counts(quality.anomalies(health(s, d), cfg))


@query
def health_kpis(s, d):
    """All data-health figures in one row."""
    return quality.health_kpis(health(s, d), datetime(2024, 1, 30, 18), CFG)


@query
def health_alerts(s, d):
    """The alert flags of the health report."""
    return quality.health_alerts(quality.health_kpis(health(s, d), datetime(2024, 1, 30, 18), CFG), CFG)


@query
def panel_span(s, d):
    """Rows, stations and time span."""
    return quality.panel_span(panel(s, d))


@query
def worst_coverage(s, d):
    """The 50 least covered stations whose name or id contains a term."""
    return views.worst_coverage(quality.station_health(health(s, d), CFG), 50, "1").select(
        "station_id", "coverage_pct", "missing")


# ---- network ------------------------------------------------------------------------------------------


@query
def station_tension_rates(s, d):
    """Share of empty and of full readings per station."""
    return network.station_tension_rates(panel(s, d), None)


@query
def recent_tension_rates(s, d):
    """The same over the last seven days, top 20 by each rate."""
    return views.top_tension_rates(network.station_tension_rates(panel(s, d), 7, CFG.tz))


@query
def snapshot_kpis(s, d):
    """Availability at the latest timestamp."""
    return network.snapshot_kpis(panel(s, d), tz=CFG.tz)


@query
def snapshot_distribution(s, d):
    """Counts and shares of the four states at the latest timestamp."""
    return network.snapshot_distribution(panel(s, d))


@query
def snapshot_map(s, d):
    """One described row per station at the latest timestamp."""
    return network.snapshot_map(panel(s, d))


@query
def offline_stations(s, d):
    """Stations without a row at the latest timestamp."""
    return network.offline_stations(panel(s, d))


@query
def availability_view(s, d):
    """Latest state of every station."""
    return network.availability_view(panel(s, d))


@query
def presence_coverage(s, d):
    """Mean share of the network's timestamps each station was seen at."""
    return network.presence_coverage(panel(s, d), 7, CFG.tz)


@query
def volatility_today(s, d):
    """Median stock deviation of the last local day."""
    return network.volatility_today(panel(s, d), CFG.tz)


@query
def availability_curve(s, d):
    """Share of stations with a bike at each timestamp of a day."""
    return network.availability_curve(panel(s, d), DAY)


@query
def reference_curve(s, d):
    """Median curve of the same weekday before."""
    return network.reference_curve(panel(s, d), DAY, 28, CFG.bin_min)


@query
def kpis_vs_lags(s, d):
    """Day-mean availability against 7, 14 and 21 days before."""
    return network.kpis_vs_lags(panel(s, d), DAY)


@query
def capacity_estimate(s, d):
    """Declared capacity, else the 98th percentile of stock."""
    p = panel(s, d).withColumn("capacity", F.when(F.col("station_id").cast("long") % 3 != 0, F.col("capacity")))
    return network.capacity_estimate(p)


@query
def exclusive_states(s, d):
    """Occupancy and exclusive penury and saturation states per row."""
    return network.exclusive_masks(panel(s, d), CFG).select("station_id", "tbin_utc", "occ", "valid", "is_pen", "is_sat")


@query
def weekly_heatmap(s, d):
    """Weekday by hour occupancy and state rates, all cells."""
    return network.weekly_heatmap(panel(s, d), CFG)


@query
def heatmap_matrix(s, d):
    """Weekday by hour occupancy as a matrix."""
    m = network.heatmap_matrix(network.weekly_heatmap(panel(s, d), CFG))
    return m.select("dow", *[F.col(f"`{h}`").alias(f"h{h:02d}") for h in range(24)])


@query
def hourly_rates(s, d):
    """State rates per local hour."""
    return network.hourly_rates(panel(s, d), CFG)


@query
def by_zone(s, d):
    """Rates and capacity per zone over the last ten days."""
    return network.by_zone(panel(s, d), CFG, 10)


@query
def tension_index(s, d):
    """Rates, occupancy and tension index per station."""
    return network.tension_index(panel(s, d), CFG, 10)


@query
def top_tension(s, d):
    """The 200 most tense stations matching a term."""
    return views.top_tension(network.tension_index(panel(s, d), CFG), 200, "2").select("station_id", "tension_index")


@query
def episodes(s, d):
    """Penury and saturation episodes of at least 12 hours."""
    return network.episodes(panel(s, d), CFG, None, 720)


@query
def regularity(s, d):
    """Correlation of today's curve with the typical one, hourly bins."""
    p = raw(s, d).withColumn("tbin_utc", X.floor_bin("ts_utc", 60)).withColumn("station_id", F.lit("all"))
    few = p.withColumn("station_id", (F.col("event_id") % 3).cast("string"))
    return network.regularity(few.unionByName(p), PanelConfig(bin_min=60), min_common=8)


@query
def station_profile(s, d):
    """Description and rates per well-covered station."""
    return network.station_profile(events(s, d), CFG).drop("profile")


@query
def station_profile_hours(s, d):
    """The 24-hour occupancy profile, one row per station and hour."""
    p = network.station_profile(events(s, d), CFG)
    return p.select("station_id", F.posexplode("profile").alias("hour", "occ"))


@query
def station_distributions(s, d):
    """Histograms over stations of coverage, volatility and rates."""
    return network.station_distributions(network.station_profile(events(s, d), CFG)).select("metric", "bin", "n")


@query
def forecast_map_view(s, d):
    """Latest state with the forecast of each horizon where there is one."""
    known = perf(s, d).filter("y_true is not null").select("station_id", "horizon_bins", "tbin_utc", "y_pred_int")
    f = clean.dedup_latest(known, ["station_id", "horizon_bins"], ("tbin_utc",), unique=True).select(
        "station_id", (F.col("horizon_bins") * 360).alias("horizon_min"), F.col("y_pred_int").alias("bikes_pred_int"))
    return views.forecast_map_view(network.availability_view(panel(s, d)), f).select(
        "station_id", "horizon_min", "num_bikes_available", "bikes_pred_int", "occ_now", "occ_pred")


@query
def forecast_lookup(s, d):
    """Forecast rows of one horizon for a list of stations."""
    f = perf(s, d).withColumn("horizon_min", F.col("horizon_bins") * 360)
    wanted = clusters(s, d).filter("cluster = 1")
    return views.forecast_lookup(f, 720, wanted).select("station_id", "tbin_utc", "y_pred_int")


@query
def latest_times(s, d):
    """Latest target and observation times."""
    p = features.forecast_targets(panel(s, d), HORIZONS, CFG)
    a = views.latest_time(p, "tbin_target", "tbin_utc").withColumn("kind", F.lit("target"))
    return a.unionByName(views.latest_time(p, "tbin_utc").withColumn("kind", F.lit("observed")))


@query
def station_meta_view(s, d):
    """Points joined to station descriptions by id or zero-stripped id."""
    meta = stations(s, d).select(
        F.lpad("station_id", 5, "0").alias("station_id"), F.concat(F.lit(" Stop "), "station_id").alias("name"), "lat", "lon")
    return views.with_station_meta(clusters(s, d), meta)


# ---- evaluation -------------------------------------------------------------------------------------------


@query
def performance_global(s, d):
    """Errors of model and baseline per horizon."""
    return evaluate.performance_global(perf(s, d))


@query
def performance_by_day(s, d):
    """Errors per local day."""
    return evaluate.performance(perf(s, d), ("date",), CFG.tz)


@query
def performance_by_hour(s, d):
    """Errors per local hour."""
    return evaluate.performance(perf(s, d), ("hour",), CFG.tz)


@query
def performance_by_dow(s, d):
    """Errors per local weekday."""
    return evaluate.performance(perf(s, d), ("dow",), CFG.tz)


@query
def performance_by_station(s, d):
    """Errors per station."""
    return evaluate.performance(perf(s, d), ("station_id",), CFG.tz)


@query
def performance_by_cluster(s, d):
    """Errors per cluster."""
    return evaluate.performance_by_cluster(perf(s, d), clusters(s, d))


@query
def performance_cuts(s, d):
    """All cuts in one scan."""
    return evaluate.performance_cuts(perf(s, d), CFG.tz).select(
        "horizon_bins", "cut", "key", "mae_model", "mae_baseline", "rmse_model", "n")


@query
def lift_curve(s, d):
    """Daily lift of the last ten days."""
    return evaluate.lift_curve(evaluate.performance(perf(s, d), ("date",), CFG.tz), 10)


@query
def lift_extremes(s, d):
    """The 20 best and worst stations of each horizon by lift."""
    by = evaluate.performance(perf(s, d), ("station_id",), CFG.tz)
    return views.lift_extremes(by).select("side", "horizon_bins", "station_id", "lift_vs_baseline", "n")


@query
def horizons_available(s, d):
    """Requested horizons the table holds."""
    return evaluate.horizons_available(perf(s, d), (1, 2, 12))


@query
def residual_histogram(s, d):
    """Residuals within p99, integer predictions."""
    return evaluate.residual_histogram(perf(s, d), 40)


@query
def residual_histogram_float(s, d):
    """Residuals within p99, real-valued predictions."""
    return evaluate.residual_histogram(float_perf(s, d), 60)


@query
def qq_points(s, d):
    """Residual quantiles against the normal."""
    return evaluate.qq_points(perf(s, d))


@query
def residual_acf(s, d):
    """Autocorrelation of the mean residual, published pair range."""
    return evaluate.acf(perf(s, d), cfg=CFG)


@query
def residual_acf_standard(s, d):
    """Autocorrelation of the mean residual, usual estimator."""
    return evaluate.acf(perf(s, d), cfg=CFG, parity=False)


@query
def heteroscedasticity(s, d):
    """MAE per quantile bin of the truth."""
    return evaluate.heteroscedasticity(perf(s, d))


@query
def max_error_run(s, d):
    """Longest run of large errors per station and horizon."""
    return evaluate.max_error_run(perf(s, d), cfg=CFG)


@query
def error_run_map(s, d):
    """Located stations with their longest error run against the median."""
    runs = evaluate.max_error_run(perf(s, d), cfg=CFG)
    where = stations(s, d).withColumn("name", F.lit(None).cast("string"))
    return views.error_run_map(runs, where)


@query
def calibration_fit(s, d):
    """Least squares of truth on prediction."""
    return evaluate.calibration_fit(perf(s, d))


@query
def calibration_by_hour(s, d):
    """The same per local hour."""
    return evaluate.calibration_fit(perf(s, d), ("hour",), CFG.tz)


@query
def calibration_bins(s, d):
    """Mean prediction and truth per quantile bin of a real-valued prediction."""
    return evaluate.calibration_bins(float_perf(s, d))


@query
def relative_error_levels(s, d):
    """Relative error per tercile of the truth."""
    return evaluate.relative_error_levels(perf(s, d))


@query
def bias_by_station(s, d):
    """Mean residual per station with its description."""
    return evaluate.bias_by_station(perf(s, d))


@query
def top_bias(s, d):
    """The 160 largest biases of each horizon among stations with 30 rows."""
    return views.top_bias(evaluate.bias_by_station(perf(s, d))).select("horizon_bins", "station_id", "abs_bias", "n")


@query
def interval_coverage(s, d):
    """Coverage of hourly residual-quantile intervals."""
    return evaluate.interval_coverage(perf(s, d), 0.9, CFG.tz)


@query
def interval_coverage_bands(s, d):
    """Coverage of given bands, of sigma bands, and of residual quantiles where both columns are empty."""
    p = perf(s, d)
    bands = p.withColumns({"yhat_lo": F.col("y_hat") - 5.0, "yhat_hi": F.col("y_hat") + 5.0})
    sigma = p.withColumn("yhat_std", F.lit(4.0))
    none = p.withColumns({c: F.lit(None).cast("double") for c in ("yhat_lo", "yhat_hi", "yhat_std")})
    return (
        evaluate.interval_coverage(bands).unionByName(evaluate.interval_coverage(sigma, 0.92))
        .unionByName(evaluate.interval_coverage(none, 0.9, CFG.tz))
    )


@query
def station_timeseries(s, d):
    """The last ten days of one eligible station per horizon."""
    return evaluate.station_timeseries(perf(s, d), 240, 12)


@query
def importance_share(s, d):
    """Share and running share of part types by retail volume."""
    rows = A.table(s, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("feature")).agg(
        F.sum("l_quantity").alias("importance"))
    return views.importance_share(rows)


@query
def exact_quantiles(s, d):
    """Price quantiles per line status, exact, by narrowing."""
    li = A.table(s, d, "lineitem")
    q = quantiles(li, ["l_linestatus"], "l_extendedprice", [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0])
    return q.select("l_linestatus", F.posexplode("q").alias("i", "value"))


# ---- drift ------------------------------------------------------------------------------------------------


def drift_events(s, d):
    e = events(s, d)
    return e.select("station_id", "tbin_utc", "lat", "lon", "bikes", "capacity", "mechanical", "occ_ratio", "is_penury",
                    "is_saturation")


@query
def drift_bounds(s, d):
    """Edges of the reference and the current window."""
    return drift.drift_bounds(panel(s, d), DRIFT_CFG)


@query
def daily_feature_means(s, d):
    """Mean of every feature per window, local day and station."""
    return drift.daily_feature_means(drift_events(s, d), DRIFT_CFG)


@query
def drift_metrics(s, d):
    """PSI, KS and mean/variance change per feature."""
    return drift.drift_metrics(drift_events(s, d), DRIFT_CFG)


@query
def drift_by_zone(s, d):
    """PSI of occupancy per zone."""
    return drift.drift_by_zone(drift_events(s, d), DRIFT_CFG)


@query
def drift_summary(s, d):
    """Global PSI, top feature and alert level."""
    return drift.drift_summary(drift.drift_metrics(drift_events(s, d), DRIFT_CFG), DRIFT_CFG)


@query
def drift_table(s, d):
    """Searchable drift table, top 15 by PSI."""
    return views.drift_table(drift.drift_metrics(drift_events(s, d), DRIFT_CFG), "", 0.0, 15).select("feature", "psi", "ks")


@query
def occupancy_ema(s, d):
    """Moving average of the network's daily occupancy."""
    return drift.occupancy_ema(events(s, d), CFG)


@query
def quantity_drift(s, d):
    """Drift of daily shipped quantity in the dense line-status panel."""
    cfg = PanelConfig(bin_min=1440, tz="UTC", last_days=365, ref_days=730)
    return drift.drift_metrics(A.daily_panel(s, d), cfg)

