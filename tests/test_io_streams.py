"""Files, compaction, documents, streams and models."""

import json
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelkit.config import PanelConfig
from panelkit.operators import clean, features, ml, spatial
from panelkit.plans import compose
from panelkit.schema import enforce_schema
from panelkit.sources import feeds, tables
from panelkit.streaming import streams

CFG = PanelConfig(block_bins=50)


@pytest.fixture
def tmp(tmp_path):
    return str(tmp_path)


def test_gbfs_documents(spark, tmp):
    status = {"data": {"stations": [
        {"station_id": 7, "num_bikes_available": 5, "num_bikes_available_types": [{"mechanical": 3}, {"ebike": 2}], "last_reported": 1704067200},
        {"station_id": 8, "num_bikes_available": 1, "num_bikes_available_types": {"ebike": 1}, "is_renting": 0},
        {"station_id": "", "num_bikes_available": 1}, {"station_id": 9, "num_bikes_available": 1}]}}
    info = {"data": {"stations": [{"station_id": 7, "name": "A", "lat": 48.8, "lon": 2.3, "capacity": 20}, {"station_id": 8, "name": "B"}]}}
    for n, doc in (("s", status), ("i", info)):
        with open(f"{tmp}/{n}.json", "w") as f:
            json.dump(doc, f, indent=1)
    got = {r.station_id: r for r in feeds.read_gbfs(spark, f"{tmp}/s.json", f"{tmp}/i.json", datetime(2024, 1, 1, 0, 7)).collect()}
    assert set(got) == {"7", "8"}
    assert (got["7"].mechanical, got["7"].ebike, got["7"].status, str(got["7"].tbin_utc)) == (3, 2, "OK", "2024-01-01 00:05:00")
    assert (got["8"].mechanical, got["8"].ebike, got["8"].status, got["8"].capacity) == (0, 1, "CLOSED", None)


def test_weather_document(spark, tmp):
    hours = [f"2024-01-01T{h:02d}:00" for h in range(24)]
    doc = {"hourly": {"time": hours, "temperature_2m": list(range(24)), "precipitation": [0.0] * 24, "wind_speed_10m": [1.5] * 24}}
    with open(f"{tmp}/w.json", "w") as f:
        json.dump(doc, f)
    w = feeds.read_weather(spark, f"{tmp}/w.json", datetime(2024, 1, 1, 10, 20), datetime(2024, 1, 1, 11))
    assert sorted(r.hour_utc.hour for r in w.collect()) == list(range(7, 15))


def test_json_shapes(spark, tmp):
    shapes = {"list": '[{"a": 1}, {"a": 2}]', "object": '{"a": 3}', "lines": '{"a": 4}\n{"a": 5}'}
    for n, text in shapes.items():
        with open(f"{tmp}/{n}.json", "w") as f:
            f.write(text)
    read = lambda n, whole: [r.a for r in feeds.read_records(spark, f"{tmp}/{n}.json", "a int", whole).collect()]
    assert read("list", True) == [1, 2] and read("object", True) == [3] and read("lines", False) == [4, 5]
    with open(f"{tmp}/bundle.json", "w") as f:
        f.write('{"generated_at": "t", "predictions": [{"station_id": "a"}]}')
    assert feeds.read_forecast_bundle(spark, f"{tmp}/bundle.json", "station_id string").first().station_id == "a"


def test_bronze_pruning(spark, dense, tmp):
    tables.write_bronze(enforce_schema(dense), f"{tmp}/bronze")
    lo, hi = datetime(2024, 3, 30, 23), datetime(2024, 3, 31, 1)
    w = tables.read_panel(spark, f"{tmp}/bronze", lo, hi, partitions=("date", "hour"))
    assert w.count() == 40 * 24
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "isnotnull(date" in plan
    assert w.inputFiles() and tables.read_panel(spark, f"{tmp}/bronze", partitions=("date", "hour")).count() == dense.count()


def test_compaction_replaces_only_its_day(spark, dense, tmp):
    path = f"{tmp}/daily"
    tables.write_daily(enforce_schema(dense), path)
    again = dense.filter("station_id = 's00'").withColumns({"bikes": F.lit(1), "ts_utc": F.col("ts_utc") + F.expr("interval 10 seconds")})
    src = enforce_schema(dense.unionByName(again)).withColumn("date", F.to_date("tbin_utc"))
    tables.write_daily(tables.compact_daily(src, date(2024, 3, 31), CFG), path)
    out = spark.read.parquet(path)
    assert out.count() == dense.count()
    ones = out.filter("station_id = 's00' and bikes = 1")
    assert ones.filter("date = '2024-03-31'").count() == 288
    assert tables.write_monthly(tables.compact_monthly(out, date(2024, 3, 1), CFG), f"{tmp}/m", dry_run=True).first()["rows"] == 40 * 576 - 6


def test_late_rows(dense):
    late = dense.filter("station_id = 's03' and b = 300").withColumns({"bikes": F.lit(1), "ts_utc": F.col("ts_utc") + F.expr("interval 1 minute")})
    day = streams.recompact(dense, late)
    assert day.count() == 40 * 288
    assert day.filter("station_id = 's03' and b = 300").first().bikes == 1


def test_documents(spark, tmp):
    df = spark.createDataFrame([("a", float("nan"))], "k string, v double")
    tables.write_document(df, tmp, "doc", datetime(2024, 1, 1))
    line = spark.read.text(f"{tmp}/doc/latest").first().value
    assert json.loads(line) == {"k": "a", "v": None}
    assert spark.read.text(f"{tmp}/doc/2024-01-01T00-00-00Z").count() == 1


def test_monitoring_continues(spark, tmp):
    ok = lambda: {"t": spark.range(3)}

    def bad():
        raise ValueError("boom")

    r = compose.run_monitoring(spark, {"a": ok, "b": bad, "c": ok}, tmp, datetime(2024, 1, 1))
    assert [k for k, e in r.items() if e is None] == ["a", "c"]
    with pytest.raises(ValueError):
        compose.run_monitoring(spark, {"b": bad}, tmp, datetime(2024, 1, 1), continue_on_error=False)


# ---- streams -----------------------------------------------------------------------------


@pytest.fixture
def landed(spark, dense, tmp):
    """The dense panel as three files, one per day, the last with a very late row."""
    day = dense.filter("s < 4").select("station_id", "ts_utc", "tbin_utc", "bikes", "capacity", "name", "b")
    for i in range(3):
        part = day.filter(f"b between {288 * i} and {288 * i + 287}")
        if i == 2:
            part = part.unionByName(day.filter("station_id = 's03' and b = 5").withColumn("bikes", F.lit(99)))
        part.coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    return f"{tmp}/in", day.schema


def test_stream_latest_keeps_two_versions(spark, landed, tmp):
    path, schema = landed
    src = streams.file_stream(spark, path, schema, per_batch=1)
    streams.start_latest(src, f"{tmp}/two", f"{tmp}/two-cp")
    versions = [p for p in os.listdir(f"{tmp}/two") if p.startswith("version=")]
    assert len(versions) <= 2
    r = streams.latest_freshness(spark, f"{tmp}/two", datetime(2024, 4, 2)).first()
    assert r.stations == 4 and r.max_min >= r.p95_min >= r.p50_min > 0


def test_stream_dedup_drops_late_rows(spark, landed):
    path, schema = landed
    src = streams.file_stream(spark, path, schema, per_batch=1).drop("tbin_utc")
    out = streams.collect_table(streams.stream_dedup(src, "10 minutes", CFG), "t-dedup")
    assert out.groupBy("station_id", "tbin_utc").count().filter("count > 1").count() == 0
    assert out.filter("bikes = 99").count() == 0
    # everything but the bins the watermark has not passed
    assert out.count() == 4 * 864 - 6 - 4 * 3 + out.filter("tbin_utc >= '2024-04-01 23:45:00'").count()


def test_stream_episodes_equal_batch(spark, landed):
    from panelkit.operators import network

    path, schema = landed
    src = streams.file_stream(spark, path, schema, per_batch=1)
    one = src.filter("station_id = 's01'")
    got = streams.collect_table(streams.stream_episodes(one, 12, CFG), "t-episodes").collect()
    want = network.episodes(spark.read.parquet(path).filter("station_id = 's01'"), CFG).collect()
    assert [(r.type, r.start_utc, r.end_utc, r.steps) for r in got] == [(r.type, r.start_utc, r.end_utc, r.steps) for r in want]


def test_stream_latest(spark, landed, tmp):
    path, schema = landed
    src = streams.file_stream(spark, path, schema, per_batch=1)
    streams.start_latest(src, f"{tmp}/latest", f"{tmp}/cp")
    got = streams.read_latest(spark, f"{tmp}/latest")
    assert got.count() == 4 and {r.b for r in got.collect()} == {863}


def test_null_bins_reach_their_day(spark, dense, tmp):
    rows = enforce_schema(dense.filter("s < 3")).withColumn(
        "tbin_utc", F.when(F.pmod(F.unix_timestamp("ts_utc"), F.lit(7)) != 0, F.col("ts_utc")))
    tables.write_bronze(rows, f"{tmp}/bronze-null")
    bronze = tables.read_panel(spark, f"{tmp}/bronze-null", partitions=("date", "hour")).withColumn("date", F.to_date("tbin_utc"))
    want = dense.filter("s < 3 and to_date(tbin_utc) = '2024-03-31'").count()
    assert tables.compact_daily(bronze, date(2024, 3, 31), CFG).count() == want
    # rows stored elsewhere without a bin have no partition date
    loose = rows.withColumn("date", F.to_date("tbin_utc"))
    assert tables.compact_daily(loose, date(2024, 3, 31), CFG).count() == want


def test_unreadable_files_are_reported(spark, dense, tmp):
    path = f"{tmp}/some-broken"
    enforce_schema(dense.limit(10)).coalesce(1).write.parquet(path)
    with open(f"{path}/part-broken.parquet", "wb") as f:
        f.write(b"no parquet here")
    with pytest.raises(Exception):
        tables.read_panel(spark, path).collect()
    assert tables.read_panel(spark, path, skip_unreadable=True).count() == 10
    got = [r.path for r in tables.files_without_rows(spark, path).collect()]
    assert len(got) == 1 and got[0].endswith("part-broken.parquet")


def test_shared_folder_is_required_on_a_cluster():
    from panelkit.session import shared_root

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_root(Session())


# ---- models -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def fitted(spark, dense):
    panel = clean.enforce_schema(dense.filter("s < 12"))
    st = spatial.stations_of(panel)
    parts = {"static": spatial.station_static(st, k=3), "knn": spatial.knn_map(st, 5), "mapping": clean.status_mapping(panel)}
    rows = ml.training_frame(panel, datetime(2024, 3, 30), date(2024, 3, 31), CFG, 15, **parts)
    return panel, parts, rows, *ml.train(rows, 15, max_iter=5, max_depth=4)


def test_training_rows(fitted):
    _, _, rows, pack, errors = fitted
    assert len(ml.FEATURES) == 53 and set(ml.FEATURES) <= set(rows.columns)
    assert rows.count() == 12 * 576 - 6 - 12 * 3
    r = errors.first()
    assert r.n_valid > 0 and r.mae <= r.rmse
    assert pack.horizon_min == 15


def test_model_round_trip_and_forecast(spark, fitted, tmp):
    panel, parts, _, pack, _ = fitted
    pack.save(spark, f"{tmp}/m")
    again = ml.ModelPack.load(spark, f"{tmp}/m")
    now = datetime(2024, 4, 2)
    a = ml.predict_latest(panel, pack, CFG, now, **parts)
    b = ml.predict_latest(panel, again, CFG, now, **parts)
    assert a.count() == 12 and a.exceptAll(b).count() == 0
    r = a.first()
    assert r.target_ts_utc - r.tbin_latest == timedelta(minutes=15)
    assert a.filter("bikes_pred_int < 0 or bikes_pred_int > capacity_bin").count() == 0
    with pytest.raises(ValueError):
        ml.predict(panel, pack)


def test_perf_uses_predictions_at_their_target(fitted):
    panel, parts, _, pack, _ = fitted
    p = features.pick_prediction(compose.build_perf(panel, date(2024, 3, 31), [pack], CFG, **parts))
    assert p.count() == 12 * 288
    assert p.filter("y_hat is null").count() == 0 and p.filter("y_true is null").count() == 0


def test_user_function_per_station(dense):
    fn = lambda pdf: pdf.head(1)[["station_id", "bikes"]]
    assert features.panel_apply(dense.select("station_id", "bikes"), fn, "station_id string, bikes int").count() == 40


def test_clusters(spark):
    rows = [(f"a{i}", [0.2 if h < 12 else 0.8 for h in range(24)]) for i in range(5)]
    rows += [(f"b{i}", [0.8 if h < 12 else 0.2 + i * 1e-3 for h in range(24)]) for i in range(5)]
    rows += [("c0", [None] * 12 + [0.8] * 12)]
    df = spark.createDataFrame(rows, "station_id string, profile array<double>")
    c = ml.cluster_profiles(df, k_max=3)
    labels = {r.station_id: r.cluster for r in c.labels.collect()}
    assert c.k == 2 and labels["a0"] == labels["a4"] != labels["b0"] == labels["b4"]
    few = ml.cluster_profiles(df.limit(3))
    assert few.k == 1 and len(few.centroids.first().y) == 24
    p = ml.profile_pca(df)
    assert p.scores.count() == 11 and p.var_ratio[0] > p.var_ratio[1]
    s = p.scores.agg(F.avg("PC1")).first()[0]
    assert s == pytest.approx(0, abs=1e-9)
