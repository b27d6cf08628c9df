"""Edge cases on the dense synthetic panel."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from panelkit.config import PanelConfig
from panelkit.functions import columns as X
from panelkit.operators import clean, drift, evaluate, features, network, quality, spatial, views
from panelkit.schema import PANEL_SCHEMA, enforce_schema, ensure_columns, null_floats, resolve_columns
from panelkit.session import release_work, shared_root, work_path

CFG = PanelConfig(block_bins=50, tz="Europe/Paris")


def one(df):
    return df.first()


def test_schema_tolerates_bad_input(spark):
    df = spark.createDataFrame([("7", "x", "3.0", 1.5, "later")], "station_id string, bikes string, capacity string, lat double, extra string")
    r = one(enforce_schema(df))
    assert enforce_schema(df).columns == PANEL_SCHEMA.fieldNames()
    assert (r.bikes, r.capacity, r.lat, r.name) == (None, 3, 1.5, None)


def test_aliases(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Timestamp int, StationCode int, velos int")
    assert resolve_columns(df).columns == ["tbin_utc", "station_id", "bikes"]
    with pytest.raises(ValueError):
        resolve_columns(df.drop("Timestamp"))
    with pytest.raises(ValueError):
        resolve_columns(df, case_sensitive=True)


def test_ensure_columns(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        ensure_columns(df, ["x"])
    assert one(ensure_columns(df, ["x"], 0.0)).x == 0.0


def test_nan_is_absent(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.0)], "a double, b double, c double")
    assert tuple(one(null_floats(df))) == (None, None, 1.0)


def test_grid_repair_and_dedup(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01 00:03:10", None, 1), ("a", "2024-01-01 00:04:00", "2024-01-01 00:04:00", 2),
         ("a", "2024-01-01 00:07:00", "2024-01-01 00:05:00", 3)],
        "station_id string, ts_utc string, tbin_utc string, bikes int",
    ).select("station_id", F.col("ts_utc").cast("timestamp").alias("ts_utc"), F.col("tbin_utc").cast("timestamp").alias("tbin_utc"), "bikes")
    got = clean.clean_panel(df, CFG).orderBy("tbin_utc").collect()
    assert [(str(r.tbin_utc), r.bikes) for r in got] == [("2024-01-01 00:00:00", 2), ("2024-01-01 00:05:00", 3)]


def test_window_bounds(spark):
    df = spark.createDataFrame([(f"2024-01-0{i}",) for i in range(1, 5)], "d string").select(F.col("d").cast("timestamp").alias("t"))
    lo, hi = datetime(2024, 1, 2), datetime(2024, 1, 4)
    assert [clean.window_filter(df, "t", lo, hi, b).count() for b in ("[]", "[)", "(]", "()")] == [3, 2, 2, 1]


def test_single_day(spark, dense):
    one_day = clean.day_only(dense, date(2024, 3, 31))
    assert clean.assert_single_day(one_day).count() == one_day.count()
    with pytest.raises(Exception, match="more than one UTC day"):
        clean.assert_single_day(dense).collect()


def test_status_codes_are_stable(spark, dense):
    mapping = spark.createDataFrame([("CLOSED", 0), ("OK", 1)], "status string, status_code long")
    assert {r.status_code for r in clean.status_code(dense.limit(5), mapping).collect()} == {1}
    assert {r.status_code for r in clean.status_code(dense.limit(5), clean.status_mapping(dense)).collect()} == {0}


def test_horizon_must_be_on_grid(dense):
    with pytest.raises(ValueError):
        features.forecast_targets(dense, (7,), CFG)


def test_targets_cross_midnight_and_gaps(dense):
    t = features.forecast_targets(dense, (15, 60), CFG)
    assert t.count() == 2 * dense.count()
    truth = dense.select("station_id", F.col("tbin_utc").alias("tbin_target"), F.col("bikes").alias("want"))
    j = t.join(truth, ["station_id", "tbin_target"], "left")
    assert j.filter("not (y_true <=> want)").count() == 0
    # 3 and 12 bins at the end of 40 series, and the bins before the gap of s00
    assert j.filter("want is null and station_id != 's00'").count() == 39 * 15


def test_rows_and_time_modes_differ_only_at_gaps(dense):
    a = features.lags(dense, bins=(1, 3), cfg=CFG).select("station_id", "b", F.col("lag_bikes_3").alias("r"))
    b = features.lags(dense, bins=(1, 3), cfg=CFG, mode="time").select("station_id", "b", F.col("lag_bikes_3").alias("t"))
    diff = a.join(b, ["station_id", "b"]).filter("not (r <=> t)")
    assert {r.station_id for r in diff.collect()} == {"s00"}
    assert {r.b for r in diff.collect()} == {16, 17, 18}


def test_rolling_minimum_periods(dense):
    r = features.rolling(dense, bins=(6,), cfg=CFG).filter("station_id = 's03' and b < 4").orderBy("b").collect()
    assert [x.roll_mean_6 is None for x in r] == [True, True, True, False]
    assert [x.roll_std_6 is None for x in r] == [True, True, True, False]


def test_slope_of_a_line(spark):
    df = spark.range(30).select(
        F.lit("a").alias("station_id"), F.timestamp_seconds(F.col("id") * 300).alias("tbin_utc"),
        (F.col("id") * 2).cast("int").alias("bikes"), F.lit(100).alias("capacity"))
    r = features.trend_slope(df, cfg=CFG).orderBy("tbin_utc").collect()
    assert r[1].trend_nb_12b is None and r[20].trend_nb_12b == pytest.approx(2.0)
    assert r[20].trend_occ_12b == pytest.approx(0.02)


def test_local_calendar_over_dst(dense):
    c = features.calendar_features(dense.filter("station_id = 's00' and b = 288"))
    r = one(c)  # 2024-03-31 00:00 UTC is 01:00 in Paris, one hour before the change
    assert (r.hour, r.paris_hour, r.dow, r.paris_is_we) == (0, 1, 6, 1)
    later = one(features.calendar_features(dense.filter("station_id = 's00' and b = 312")))
    assert later.paris_hour == 4


def test_coverage(dense):
    t = {r.station_id: r for r in quality.station_health(dense, CFG).collect()}
    assert (t["s00"].missing, t["s01"].missing, t["s00"].expected) == (6, 0, 864)
    assert one(quality.coverage_active(dense, CFG)).coverage_active_pct < 100
    hours = quality.coverage_by_hour(dense, CFG).collect()
    assert len(hours) == 24 and all(r.coverage_pct <= 100 for r in hours)


def test_flat_sequences(dense):
    f = quality.flat_sequences(dense.filter("station_id in ('s01', 's02')"), CFG, 6)
    s02 = f.filter("station_id = 's02'").collect()
    assert [(r.steps, r.duration_min) for r in s02] == [(6, 30)]
    s01 = f.filter("station_id = 's01'").orderBy("start").collect()
    assert [r.steps for r in s01] == [282, 11, 105, 10, 452]


def test_flat_needs_min_steps(dense):
    s02 = dense.filter("station_id = 's02'").filter("b != 103")
    assert quality.flat_sequences(s02, CFG, 6).count() == 0


def test_anomaly_sampling(dense):
    rows = quality.duplicates(dense.unionByName(dense.filter("b < s")))
    assert quality.top_anomalies(rows, "dups", 10).count() == 10
    assert quality.top_anomalies(rows, "dups", 10, 0.5).count() == 5


def test_episode_across_midnight(dense):
    e = network.episodes(dense.filter("station_id = 's01'"), CFG).collect()
    assert [(r.type, r.steps, r.duration_min) for r in e] == [("penury", 12, 60.0)]
    assert str(e[0].start_utc) == "2024-03-30 23:30:00"


def test_full_then_empty_are_two_episodes(spark):
    v = [20] * 12 + [0] * 12
    df = spark.createDataFrame([("a", i * 300, b) for i, b in enumerate(v)], "station_id string, e long, bikes int").select(
        "station_id", F.timestamp_seconds("e").alias("tbin_utc"), "bikes", F.lit(20).alias("capacity"), F.lit(None).cast("string").alias("name"))
    e = network.episodes(df, CFG).orderBy("start_utc").collect()
    assert [(r.type, r.steps) for r in e] == [("saturation", 12), ("penury", 12)]


def test_capacity_estimate(spark):
    df = spark.createDataFrame(
        [("a", 5, 20, 1), ("a", 7, 22, 1), ("b", 0, None, 1), ("b", 9, None, 2), ("c", 4, 0, None)],
        "station_id string, bikes int, capacity int, docks int")
    got = {r.station_id: r.cap_est for r in network.capacity_estimate(df).collect()}
    assert got["a"] == 22.0 and got["b"] == pytest.approx(1 + 10 * 0.98) and got["c"] == 4.0


def test_regularity(dense):
    flat = dense.filter("station_id = 's05'").withColumn("bikes", F.lit(3)).withColumn("station_id", F.lit("flat"))
    days = dense.filter("station_id = 's04'").unionByName(flat)
    shifted = days.withColumn("tbin_utc", F.col("tbin_utc") - F.expr("interval 7 days"))
    got = {r.station_id: r[1] for r in network.regularity(days.unionByName(shifted), PanelConfig(tz="UTC")).collect()}
    assert got["s04"] == pytest.approx(1.0) and got["flat"] is None


def test_exclusive_states(dense):
    m = network.exclusive_masks(dense, CFG)
    assert m.filter("is_pen and is_sat").count() == 0
    assert m.filter("occ < 0 or occ > 1").count() == 0


def test_null_stock(spark):
    df = spark.createDataFrame([("a", None, 10), ("a", 0, 10)], "station_id string, bikes int, capacity int").withColumn(
        "tbin_utc", F.lit("2024-01-01").cast("timestamp"))
    assert one(network.station_tension_rates(df, None)).penury_rate == 1.0
    assert [r.is_penury for r in clean.stock_flags(df).orderBy("bikes").collect()] == [0, 1]
    assert network.exclusive_masks(df).filter("valid").count() == 1


def test_clip_round(spark):
    df = spark.createDataFrame([(-1.0, 5), (7.0, 5), (2.5, 5), (3.5, None), (None, 5)], "p double, c int")
    assert [r[0] for r in df.select(X.clip_round("p", "c")).collect()] == [0, 5, 2, 4, None]


# ---- neighbours --------------------------------------------------------------------------


def brute(points, k):
    import numpy as np

    out = {}
    for i, a, b in points:
        d = []
        for j, c, e in points:
            if i != j:
                la, lc = np.radians(a), np.radians(c)
                h = np.sin((lc - la) / 2) ** 2 + np.cos(la) * np.cos(lc) * np.sin(np.radians(e - b) / 2) ** 2
                d.append((2 * 6371 * np.arcsin(np.sqrt(min(1, h))), j))
        out[i] = [x[0] for x in sorted(d)[:k]]
    return out


@pytest.mark.parametrize("shape", ["clusters", "copies", "few", "single"])
def test_knn_matches_brute_force(spark, shape):
    import numpy as np

    rng = np.random.default_rng(3)
    near = [(f"n{i:03d}", 48.85 + rng.random() * 1e-4, 2.35 + rng.random() * 1e-4) for i in range(120)]
    pts = {
        # two far groups, one too small for k, and points over the date line and the pole
        "clusters": near + [("a1", -33.9, 151.2), ("a2", -33.91, 151.2), ("p1", 89.99, 10.0), ("d1", 0.0, 179.99), ("d2", 0.0, -179.99)],
        "copies": near[:60] + [(f"c{i:03d}", 48.9, 2.3) for i in range(60)],
        "few": near[:3],
        "single": near[:1],
    }[shape]
    got = spatial.knn_map(spark.createDataFrame(pts, "station_id string, lat double, lon double"), 5).collect()
    want = brute(pts, 5)
    for i, dists in want.items():
        mine = sorted((r for r in got if r.station_id == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(dists) + 1))
        assert [r.dist_km for r in mine] == pytest.approx(dists, abs=1e-9)
        assert i not in {r.neighbor_id for r in mine}


def test_static_has_one_row_per_station(dense):
    moved = dense.filter("station_id = 's03'").withColumns(
        {"capacity": F.lit(99), "tbin_utc": F.col("tbin_utc") + F.expr("interval 9 days")})
    st = spatial.stations_of(dense.unionByName(moved))
    s = spatial.station_static(st, k=4)
    assert s.count() == 40 and st.filter("station_id = 's03'").first().capacity == 99


# ---- drift and evaluation -------------------------------------------------------------------


def test_drift_undefined_cases(spark):
    base = spark.range(200).select(
        F.concat(F.lit("s"), (F.col("id") % 10).cast("string")).alias("station_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") / 10) * 86400).alias("tbin_utc"),
        (F.col("id") % 7).cast("int").alias("bikes"), F.lit(4).alias("constant"),
        F.when(F.col("id") > 196, F.col("id")).cast("int").alias("rare"))
    cfg = PanelConfig(last_days=7, ref_days=12, tz="UTC")
    got = {r.feature: r for r in drift.drift_metrics(base, cfg).collect()}
    assert "rare" not in got and got["constant"].psi is None and got["constant"].ks is None
    assert got["bikes"].psi >= 0 and 0 <= got["bikes"].ks <= 1


def test_ema_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "d int, x double")
    got = {r.d: r.x_ema for r in drift.ema(df, "x", "d", alpha=0.25).collect()}
    assert got == {1: 1.0, 2: None, 3: pytest.approx(1.25)}


@pytest.fixture(scope="module")
def perf(dense):
    p = features.rolling(dense, bins=(3,), cfg=CFG)
    t = features.forecast_targets(p, (15, 60), CFG, keep=("roll_mean_3",))
    return features.pick_prediction(t.withColumn("y_pred_int", X.clip_round("roll_mean_3"))).cache()


def test_histogram_counts(perf):
    h = evaluate.residual_histogram(perf, 40)
    assert h.groupBy("horizon_bins").count().filter("count != 40").count() == 0
    used = evaluate.scored(perf).filter("horizon_bins = 3")
    half = h.filter("horizon_bins = 3 and bin = 39").first().bin_right
    inside = used.filter(F.abs("resid") <= half).count()
    assert h.filter("horizon_bins = 3").agg(F.sum("count")).first()[0] == inside


def test_cuts_agree(perf):
    cuts = evaluate.performance_cuts(perf, "UTC")
    per = cuts.groupBy("horizon_bins", "cut").agg(F.sum("n").alias("n")).select("horizon_bins", "n").distinct()
    assert per.count() == 2


def test_all_predictions_null(perf):
    r = one(evaluate.performance_global(perf.withColumn("y_hat", F.lit(None).cast("int"))))
    assert (r.mae_model, r.coverage_pred_pct, r.lift_vs_baseline) == (None, 0.0, None)


def test_constant_prediction_has_no_slope(perf):
    r = evaluate.calibration_fit(perf.withColumn("y_hat", F.lit(5))).collect()
    assert [(x.beta, x.alpha) for x in r] == [(None, None)] * 2
    assert evaluate.qq_points(perf.withColumn("y_hat", F.col("y_true")), 5).filter("empirical != 0").count() == 0
    assert evaluate.heteroscedasticity(perf.withColumn("y_true", F.lit(3))).count() == 0


def test_acf_starts_at_one(perf):
    a = evaluate.acf(perf, 5, CFG).filter("lag = 0").collect()
    assert [r.acf for r in a] == [1.0, 1.0]


def test_z_interpolation():
    assert X.z_for_nominal(0.90) == 1.64485
    assert 1.64485 < X.z_for_nominal(0.92) < 1.95996


def test_unknown_horizon(spark):
    f = spark.createDataFrame([("a", 15)], "station_id string, horizon_min int")
    assert views.forecast_lookup(f, 15, ["a"]).count() == 1
    with pytest.raises(ValueError):
        views.forecast_lookup(f, 30)


# ---- skew -------------------------------------------------------------------------------------


def test_hot_station_gives_the_same_results(dense):
    """One station holding a third of all rows, most of them repeats."""
    hot = dense.filter("station_id = 's07'").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20))))
    hot = hot.withColumn("ts_utc", F.col("ts_utc") - F.make_dt_interval(secs=F.col("k"))).drop("k")
    skewed = dense.unionByName(hot)
    assert clean.dedup_latest(skewed).select(dense.columns).exceptAll(dense).count() == 0
    d = {r.station_id: r.dups for r in quality.duplicates(skewed).collect()}
    assert d["s07"] == 20 * 864 and d["s08"] == 0


# ---- working folder --------------------------------------------------------------------------------


def test_work_folder_follows_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    path = work_path(spark, "x")
    assert path.startswith(shared_root(spark)) and spark.sparkContext.applicationId in path
    assert callable(release_work)
