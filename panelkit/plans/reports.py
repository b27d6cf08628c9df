"""Queries over files, streams, models and whole reports.

Their inputs are the test tables, rewritten by Spark into feeds, partitioned
tables and streams below the shared folder.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelkit.config import PanelConfig
from panelkit.operators import clean, drift, evaluate, features, ml, network, quality, spatial
from panelkit.plans import catalog as C, compose
from panelkit.schema import ensure_columns as ensure
from panelkit.session import materialize, tune, work_path
from panelkit.sources import adapters as A, feeds, tables
from panelkit.streaming import late, streams

CFG = C.CFG
REPORT_QUERIES: dict[str, C.Query] = {}


def query(fn: C.Query) -> C.Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.canon(fn(tune(spark), sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    REPORT_QUERIES[fn.__name__] = run
    return fn


# ---- feeds and tables ---------------------------------------------------------------------


def _lines(df: DataFrame, name: str) -> str:
    """Documents, one per line, in a fresh folder."""
    path = work_path(df.sparkSession, name)
    df.write.text(path)
    return path


def _station_docs(rows: DataFrame, group) -> DataFrame:
    """Feed documents of at most 50 stations each."""
    return rows.groupBy(group.alias("_g")).agg(F.collect_list(F.struct(*rows.columns)).alias("s")).select(
        F.to_json(F.struct(F.struct(F.col("s").alias("stations")).alias("data"))).alias("value")
    )


@query
def gbfs_feed(s, d):
    """Station status and information documents joined into panel rows."""
    r = C.raw(s, d)
    mech = F.floor(F.col("bikes") / 2)
    types = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(
        F.create_map(F.lit("mechanical"), mech), F.create_map(F.lit("ebike"), F.col("bikes") - mech),
    ))).otherwise(F.to_json(F.create_map(F.lit("mechanical"), mech)))
    status = r.select(
        F.concat(F.lit(" "), F.col("station_id")).alias("station_id"), F.col("bikes").alias("num_bikes_available"),
        types.alias("num_bikes_available_types"), (F.col("event_id") % 2).cast("int").alias("is_renting"),
        F.unix_timestamp("ts_utc").alias("last_reported"), F.col("event_id"),
    )
    docs = _station_docs(status, F.floor(F.col("event_id") / 50))
    info = C.stations(s, d).withColumn("name", F.concat(F.lit("Stop "), F.col("station_id")))
    infos = _station_docs(info.select("station_id", "name", "lat", "lon", "capacity"), F.floor(F.col("station_id").cast("long") / 50))
    out = feeds.read_gbfs(s, _lines(docs, "status"), _lines(infos, "info"), C.NOW, 5, multi_line=False)
    return out.select("station_id", "bikes", "capacity", "mechanical", "ebike", "status", "name", "tbin_utc", "src_ts_utc")


@query
def weather_feed(s, d):
    """Hourly weather documents unpacked and cut to the wanted hours."""
    w = A.weather(s, d)
    cells = F.array_sort(F.collect_list(F.struct(
        F.date_format("hour_utc", "yyyy-MM-dd'T'HH:mm").alias("t"), "temp_C", "precip_mm", "wind_mps")))
    docs = w.groupBy(F.to_date("hour_utc")).agg(cells.alias("c")).select(F.to_json(F.struct(F.struct(
        F.col("c.t").alias("time"), F.col("c.temp_C").alias("temperature_2m"),
        F.col("c.precip_mm").alias("precipitation"), F.col("c.wind_mps").alias("wind_speed_10m"),
    ).alias("hourly"))).alias("value"))
    return feeds.read_weather(s, _lines(docs, "weather"), datetime(2024, 1, 10), datetime(2024, 1, 20), multi_line=False)


@query
def json_records(s, d):
    """Loose JSON records read with a schema: values that do not fit become null."""
    r = C.raw(s, d).select(F.to_json(F.struct(
        "station_id", F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.col("bikes").cast("string")).alias("bikes_pred"),
        F.lit(15).alias("horizon_min"))).alias("value"))
    rows = feeds.read_records(s, _lines(r, "records"), "station_id string, bikes_pred string, horizon_min int", False)
    return rows.groupBy("station_id", "horizon_min").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bikes_pred").try_cast("int")).alias("bikes"))


def _bronze(s, d) -> str:
    path = work_path(s, "bronze")
    rows = clean.enforce_schema(C.raw(s, d))
    # Some rows arrive without a bin, some off the grid.
    bin_ = F.when(F.pmod(F.unix_timestamp("ts_utc"), F.lit(7)) == 0, None).when(
        F.pmod(F.unix_timestamp("ts_utc"), F.lit(5)) == 0, F.col("ts_utc")).otherwise(F.col("tbin_utc"))
    tables.write_bronze(rows.withColumn("tbin_utc", bin_), path, CFG.bin_min)
    return path


@query
def pruned_scan(s, d):
    """A time window read from hour partitions: only the window's folders are opened."""
    lo, hi = datetime(2024, 1, 10, 6), datetime(2024, 1, 12, 18)
    w = tables.read_panel(s, _bronze(s, d), lo, hi, partitions=("date", "hour"))
    return w.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bikes").alias("bikes"))


@query
def daily_compaction(s, d):
    """One day of bronze compacted, written and read back."""
    bronze = tables.read_panel(s, _bronze(s, d), partitions=("date", "hour")).withColumn("date", F.to_date("tbin_utc"))
    path = work_path(s, "daily")
    tables.write_daily(tables.compact_daily(bronze, C.DAY, CFG), path, single_day=True)
    return tables.read_days(s, path, C.DAY, C.DAY).select("station_id", "tbin_utc", "ts_utc", "status")


def _daily(s, d) -> str:
    path = work_path(s, "daily")
    tables.write_daily(clean.clean_panel(C.raw(s, d), CFG), path)
    return path


@query
def monthly_compaction(s, d):
    """The dailies of a month compacted and written by month."""
    out = tables.compact_monthly(s.read.parquet(_daily(s, d)), date(2024, 1, 1), CFG)
    return tables.write_monthly(out, work_path(s, "monthly"))


@query
def training_base(s, d):
    """All dailies exported in the fourteen panel columns."""
    path = work_path(s, "base")
    tables.write_training_base(s.read.parquet(_daily(s, d)), path)
    return s.read.parquet(path).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("tbin_utc").alias("last_bin"), F.count("temp_C").alias("n_temp"))


@query
def date_range_scan(s, d):
    """Days of a date-partitioned table, and its newest day."""
    daily = s.read.parquet(_daily(s, d))
    rng = daily.filter(F.col("date").between(F.lit(date(2024, 1, 5)), F.lit(date(2024, 1, 9))))
    a = rng.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("days")).withColumn("scan", F.lit("range"))
    b = tables.latest_day(daily).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("days"))
    return a.unionByName(b.withColumn("scan", F.lit("latest")))


@query
def expired_partitions(s, d):
    """Daily partitions that are closed, by day and by month."""
    days = C.panel(s, d).select(F.to_date("tbin_utc").alias("date")).distinct()
    a = tables.expired_partitions(days, C.DAY).withColumn("kind", F.lit("day"))
    return a.unionByName(tables.expired_partitions(days, date(2024, 2, 10), "date").withColumn("kind", F.lit("later")))


@query
def cluster_csv(s, d):
    """Cluster labels from CSV, repeats removed."""
    path = work_path(s, "clusters")
    c = C.clusters(s, d)
    c.unionByName(c).write.option("header", True).csv(path)
    return tables.read_clusters(s, path)


@query
def document_roundtrip(s, d):
    """A report written as JSON, NaN as null, and read back."""
    t = network.station_tension_rates(C.panel(s, d), None).withColumn(
        "saturation_rate", F.when(F.col("saturation_rate") == 0, float("nan")).otherwise(F.col("saturation_rate")))
    path = work_path(s, "documents")
    tables.write_document(t, path, "tension", C.NOW)
    return s.read.schema("station_id string, penury_rate double, saturation_rate double").json(f"{path}/tension/latest")


@query
def manifest(s, d):
    """Names and sizes of a report's tables."""
    p = C.panel(s, d)
    m = tables.manifest(s, {"rates": network.station_tension_rates(p, None), "hourly": network.hourly_rates(p, CFG)}, C.NOW,
                        params={"penury": 2})
    return m.select("generated_at", F.explode("files").alias("f")).select("generated_at", "f.name", "f.rows")


# ---- streams ----------------------------------------------------------------------------------


def _stream(s, d) -> DataFrame:
    schema = A.table(s, d, "events").schema
    return A.snapshots_from(streams.file_stream(s, d, schema, "events.parquet"))


@query
def stream_bronze(s, d):
    """Snapshots streamed into hour partitions."""
    root = work_path(s, "stream-bronze")
    streams.start_bronze(_stream(s, d), f"{root}/data", f"{root}/checkpoint", CFG)
    return s.read.parquet(f"{root}/data").groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n"), F.sum("bikes").alias("bikes"))


@query
def stream_dedup(s, d):
    """The last snapshot per station and bin, for bins the watermark has passed."""
    out = streams.stream_dedup(_stream(s, d), "1 hour", CFG, ("ts_utc", "event_id"))
    return streams.collect_table(out, "stream-dedup").select("station_id", "tbin_utc", "ts_utc", "event_id", "bikes")


@query
def stream_rates(s, d):
    """State rates per tumbling day."""
    return streams.collect_table(streams.stream_rates(_stream(s, d), "1 day", "1 hour", CFG), "stream-rates")


@query
def stream_rolling(s, d):
    """Sliding daily mean of stock, every six hours."""
    return streams.collect_table(streams.stream_rolling(_stream(s, d), "1 day", "6 hours", "1 hour"), "stream-rolling")


@query
def stream_episodes(s, d):
    """Ended penury and saturation runs of at least two bins, from deduplicated stream rows."""
    rows = streams.stream_dedup(_stream(s, d), "1 hour", CFG, ("ts_utc", "event_id"))
    path = work_path(s, "stream-clean")
    streams.start_table(rows, path, f"{path}-checkpoint")
    clean_rows = streams.file_stream(s, path, rows.schema)
    return streams.collect_table(streams.stream_episodes(clean_rows, 2, CFG), "stream-episodes")


@query
def stream_sessions(s, d):
    """Penury sessions with gaps of at most two days."""
    return streams.collect_table(streams.stream_sessions(_stream(s, d), "48 hours", "1 hour", CFG), "stream-sessions")


@query
def stream_latest(s, d):
    """Latest row per station, kept by a stream."""
    root = work_path(s, "stream-latest")
    streams.start_latest(_stream(s, d), f"{root}/data", f"{root}/checkpoint")
    return streams.read_latest(s, f"{root}/data").select("station_id", "ts_utc", "bikes", "status")


@query
def stream_freshness(s, d):
    """Ages of the live state that a stream keeps."""
    root = work_path(s, "stream-freshness")
    streams.start_latest(_stream(s, d), f"{root}/data", f"{root}/checkpoint")
    return streams.latest_freshness(s, f"{root}/data", C.NOW)


@query
def late_recompaction(s, d):
    """Late rows taken into the days they belong to."""
    r = C.raw(s, d)
    early = clean.dedup_latest(r.filter("event_id % 7 != 0"), clean.KEYS, ("ts_utc", "event_id"))
    late = r.filter("event_id % 7 = 0")
    return streams.recompact(early, late, ("ts_utc", "event_id")).select("station_id", "tbin_utc", "ts_utc", "event_id")


@query
def stream_compaction(s, d):
    """Files in any order of time, compacted by day as they land: late rows rewrite their days."""
    rows, at = C.raw(s, d), work_path(s, "stream-compaction")
    rows.repartition(4, "event_id").write.parquet(f"{at}/in")
    late.start_daily(streams.file_stream(s, f"{at}/in", rows.schema, per_batch=1), f"{at}/out", f"{at}/checkpoint", CFG, ("ts_utc", "event_id"))
    return late.read_days(s, f"{at}/out", rows.schema).select("station_id", "tbin_utc", "ts_utc", "status")


# ---- models -----------------------------------------------------------------------------------------

HORIZON = 360
# Horizons that models are trained and evaluated for, multiples of the bin.
HORIZONS = (HORIZON, 2 * HORIZON)


def station_parts(s, d) -> tuple[DataFrame, dict]:
    """The panel with weather, and the station tables and mapping that features need."""
    panel = materialize(clean.enforce_schema(C.weathered(s, d)), "panel")
    st = materialize(spatial.stations_of(panel), "stations")
    return panel, {
        "static": materialize(spatial.station_static(st), "static"),
        "knn": materialize(spatial.knn_map(st, 5), "knn"),
        "mapping": materialize(clean.status_mapping(panel), "status"),
    }


# First and last day of the training rows.
TRAINED = (datetime(2024, 1, 1), date(2024, 1, 27))


def training_rows(panel: DataFrame, parts: dict, horizon: int = HORIZON) -> DataFrame:
    return materialize(ml.training_frame(panel, *TRAINED, CFG, horizon, **parts), "training-rows")


def model_parts(s, d) -> dict:
    """Panel, station tables and a fitted model with its errors for each horizon, made anew for each query."""
    panel, parts = station_parts(s, d)
    fitted = [ml.train(rows, h) for rows, h in zip(ml.training_frames(panel, *TRAINED, CFG, HORIZONS, **parts), HORIZONS)]
    return {"panel": panel, "parts": parts, "packs": [p for p, _ in fitted], "errors": [e for _, e in fitted]}


def per_horizon(frames: list[DataFrame]) -> DataFrame:
    """One table of several, in the order of HORIZONS, with the horizon as a column."""
    named = [f.withColumn("horizon_min", F.lit(h)) for h, f in zip(HORIZONS, frames)]
    return reduce(DataFrame.unionByName, named)


@query
def training_frame(s, d):
    """Feature rows with a known target, per station."""
    return training_rows(*station_parts(s, d)).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_nb").alias("y_mean"), F.avg("lag_bikes_1").alias("lag1_mean"),
        F.count("knn_mean_bikes_lag1").alias("n_knn1"), F.count("roll_std_48").alias("n_std48"))


@query
def feature_frame(s, d):
    """All model inputs of every row but the fitted cluster and its mean."""
    panel, parts = station_parts(s, d)
    fitted = {"kmeans_cluster", "te_cap_mean", "mechanical", "ebike"}
    return ml.feature_frame(panel, CFG, **parts).select("station_id", "tbin_utc", *[c for c in ml.FEATURES if c not in fitted])


@query
def ensure_columns(s, d):
    """A required column that the table lacks is filled with the value named."""
    rows = ensure(C.panel(s, d).select("station_id", "bikes"), ["bikes", "humidity"], 1.5)
    return rows.groupBy("station_id").agg(F.count("bikes").alias("n"), F.sum("humidity").alias("humidity"))


@query
def panel_apply(s, d):
    """A user's pandas function per station: rows and stock."""
    def total(pdf):
        return pdf.groupby("station_id", as_index=False).agg(n=("bikes", "size"), bikes=("bikes", "sum"))

    rows = C.panel(s, d).select("station_id", "bikes")
    return features.panel_apply(rows, total, "station_id string, n long, bikes long")


@query
def temporal_split(s, d):
    """Training and validation rows by time."""
    return ml.temporal_split(C.panel(s, d), 0.9).groupBy("is_valid").agg(
        F.count(F.lit(1)).alias("n"), F.min("tbin_utc").alias("first_bin"), F.max("tbin_utc").alias("last_bin"))


@query
def lookback(s, d):
    """Rows of the last five days, from midnight."""
    return quality.panel_span(ml.lookback(C.panel(s, d), 5))


@query
def station_static(s, d):
    """Static station features; the cluster is left out of the comparison."""
    return spatial.station_static(C.stations(s, d)).select("station_id", "dist_center_km", "grid_x", "grid_y")


@query
def station_clusters(s, d):
    """Spatial clusters with their mean capacity."""
    return station_parts(s, d)[1]["static"].groupBy("kmeans_cluster").agg(
        F.count(F.lit(1)).alias("n"), F.max("te_cap_mean").alias("te_cap_mean"))


@query
def model_errors(s, d):
    """Validation error of the trained models."""
    return per_horizon(model_parts(s, d)["errors"])


@query
def feature_importance(s, d):
    """Gain shares of the models' inputs."""
    return per_horizon([ml.feature_importance(s, p) for p in model_parts(s, d)["packs"]])


@query
def model_forecast(s, d):
    """Forecasts of every station from its last row."""
    m = model_parts(s, d)
    return reduce(DataFrame.unionByName, [ml.predict_latest(m["panel"], p, CFG, C.NOW, **m["parts"]) for p in m["packs"]])


@query
def model_performance(s, d):
    """Errors of the model's own predictions on the last days, per horizon."""
    m = model_parts(s, d)
    perf = materialize(compose.build_perf(m["panel"], date(2024, 1, 28), m["packs"], CFG, **m["parts"]), "perf")
    return evaluate.performance_global(features.pick_prediction(perf))


@query
def forecast_bundle(s, d):
    """Forecasts of all stations for every model, from the recent panel, with each horizon's status."""
    m = model_parts(s, d)
    out = compose.build_forecast(m["panel"], m["packs"], datetime(2024, 1, 30, 18), CFG, **m["parts"])
    return compose.forecast_bundle(out)


@query
def stream_forecast(s, d):
    """Forecasts issued by a stream of panel rows."""
    m = model_parts(s, d)
    root = work_path(s, "stream-forecast")
    path = work_path(s, "panel-in")
    m["panel"].write.parquet(path)
    src = s.readStream.schema(m["panel"].schema).parquet(path)
    for p in m["packs"]:  # each stream has its own state
        at = f"{root}/{p.horizon_min}"
        streams.start_forecast(src, p, f"{at}/panel", f"{at}/out", f"{at}/checkpoint", CFG, **m["parts"])
    issued = [s.read.parquet(f"{root}/{h}/out") for h in HORIZONS]
    return reduce(DataFrame.unionByName, issued).select("station_id", "horizon_min", "tbin_latest", "bikes_pred_int", "capacity_bin")


def _profiles(s, d) -> DataFrame:
    return materialize(network.station_profile(C.events(s, d), CFG), "profiles")


@query
def cluster_profiles(s, d):
    """Stations per profile cluster at the best silhouette."""
    c = ml.cluster_profiles(_profiles(s, d))
    return c.labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"k": F.lit(c.k), "silhouette": F.lit(c.silhouette).cast("double"), "davies_bouldin": F.lit(c.davies_bouldin).cast("double")})


@query
def profile_pca(s, d):
    """Two principal scores per station."""
    return ml.profile_pca(_profiles(s, d)).scores


# ---- reports -------------------------------------------------------------------------------------------


def _sizes(s, report: compose.Report) -> DataFrame:
    return tables.manifest(s, report, C.NOW).select(F.explode("files").alias("f")).select("f.name", "f.rows")


@query
def day_events(s, d):
    """Enriched rows of one day, with codes from the whole panel."""
    p = C.panel(s, d)
    e = compose.build_events(p, C.DAY, clean.status_mapping(p), CFG)
    return e.select("station_id", "tbin_utc", "bikes", "occ_ratio", "is_penury", "is_saturation", "status_code", "h", "min")


@query
def data_health_report(s, d):
    """Tables of the data-health report."""
    return _sizes(s, compose.data_health(C.raw(s, d), C.NOW, CFG))


@query
def data_drift_report(s, d):
    """Tables of the drift report."""
    return _sizes(s, compose.data_drift(C.drift_events(s, d), C.DRIFT_CFG))


@query
def model_performance_report(s, d):
    """Tables of the performance report."""
    return _sizes(s, compose.model_performance(materialize(C.perf(s, d), "perf"), CFG, C.clusters(s, d)))


def explained(s: SparkSession, perf: DataFrame, packs: list[ml.ModelPack]) -> compose.Report:
    """The explainability report with the importances of every horizon's model."""
    return compose.model_explainability(perf, CFG) | {"feature_importance": per_horizon([ml.feature_importance(s, p) for p in packs])}


@query
def model_explainability_report(s, d):
    """Tables of the explainability report."""
    return _sizes(s, explained(s, materialize(C.perf(s, d), "perf"), model_parts(s, d)["packs"]))


@query
def network_overview_report(s, d):
    """Tables of the network overview."""
    return _sizes(s, compose.network_overview(C.panel(s, d), CFG, C.DAY))


@query
def network_dynamics_report(s, d):
    """Tables of the network dynamics."""
    return _sizes(s, compose.network_dynamics(C.panel(s, d), CFG))


@query
def network_stations_report(s, d):
    """Tables of the station report."""
    return _sizes(s, compose.network_stations(C.events(s, d), CFG))


@query
def status_board(s, d):
    """The board's lights over overview, health, freshness, drift and forecast."""
    latest = features.latest_rows(C.raw(s, d).withColumnRenamed("ts_utc", "src_ts_utc"), ("src_ts_utc",))
    fc = C.perf(s, d).filter("y_hat is not null").groupBy((F.col("horizon_bins") * 360).alias("horizon_min")).agg(
        F.max("tbin_utc").alias("generated_at"), F.count(F.lit(1)).alias("rows")).withColumn("model_version", F.lit("1.0.0"))
    board = compose.status_board(
        network.snapshot_kpis(C.panel(s, d), tz=CFG.tz),
        quality.coverage_global(C.health(s, d), CFG),
        quality.feed_freshness(latest, C.NOW, A.weather(s, d)),
        drift.drift_summary(drift.drift_metrics(C.drift_events(s, d), C.DRIFT_CFG), C.DRIFT_CFG),
        fc, C.NOW, PanelConfig(),
    )
    return board.select(F.explode("statuses").alias("x")).select("x.name", "x.led", "x.value", "x.rows")


@query
def monitoring_run(s, d):
    """All reports run in order and written with their manifests; a failing step is reported."""
    out = work_path(s, "monitoring")

    def broken() -> compose.Report:
        raise ValueError("no data")

    m = model_parts(s, d)
    perf = materialize(C.perf(s, d), "perf")
    steps = {
        "health": lambda: compose.data_health(C.raw(s, d), C.NOW, CFG),
        "drift": lambda: compose.data_drift(C.drift_events(s, d), C.DRIFT_CFG),
        "performance": lambda: compose.model_performance(perf, CFG, C.clusters(s, d)),
        "explainability": lambda: explained(s, perf, m["packs"]),
        "broken": broken,
        "overview": lambda: compose.network_overview(C.panel(s, d), CFG, C.DAY),
        "dynamics": lambda: compose.network_dynamics(C.panel(s, d), CFG),
        "stations": lambda: compose.network_stations(C.events(s, d), CFG),
    }
    result = compose.run_monitoring(s, steps, out, C.NOW)
    status = s.createDataFrame([(k, "ok" if e is None else "failed") for k, e in result.items()], "step string, state string")
    step = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/manifest/", 1).alias("step")
    sizes = s.read.json(f"{out}/*/manifest/latest").select(step, F.size("files").alias("tables"))
    return status.join(sizes, "step", "left")
