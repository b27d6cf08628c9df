"""The model queries run the operators' own defaults, for every horizon."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from panelkit.operators import clean, features, ml, spatial
from panelkit.plans import reports

SF = "/root/testdata/sf0.001"


def test_models_use_defaults_and_two_horizons(spark, monkeypatch):
    trained, clustered = [], []
    static = spatial.station_static

    def train(rows, horizon, **options):
        trained.append((horizon, options))
        return ml.ModelPack(None, horizon, "t", ()), rows.limit(1).select("y_nb")

    monkeypatch.setattr(ml, "train", train)
    monkeypatch.setattr(spatial, "station_static", lambda st, **options: clustered.append(options) or static(st, **options))
    got = reports.model_errors(spark, SF)
    assert trained == [(360, {}), (720, {})] and clustered == [{}]
    assert {r.horizon_min for r in got.collect()} == {360, 720}


def same_rows(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_features_are_made_once_for_all_horizons(spark, monkeypatch):
    made, whole = [], ml.feature_frame
    monkeypatch.setattr(ml, "feature_frame", lambda *a, **options: made.append(a) or whole(*a, **options))
    monkeypatch.setattr(ml, "train", lambda rows, horizon: (horizon, rows))
    m = reports.model_parts(spark, SF)
    assert len(made) == 1
    for h, rows in zip(reports.HORIZONS, m["errors"]):
        one = ml.training_frame(m["panel"], *reports.TRAINED, reports.CFG, h, **m["parts"])
        assert not one.isEmpty()
        same_rows(rows, one)


def test_serving_features_are_those_of_the_last_rows(spark):
    panel, parts = reports.station_parts(spark, SF)
    want = features.latest_rows(ml.feature_frame(panel, reports.CFG, **parts))
    same_rows(ml.feature_frame(panel, reports.CFG, latest=True, **parts), want)


def test_training_reads_bounded_partitions(spark, monkeypatch):
    seen = []

    class Watched(GBTRegressor):
        def fit(self, rows):
            sizes = rows.filter("NOT is_valid").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
            seen.extend(n for n in sizes if n)
            return super().fit(rows)

    monkeypatch.setattr(ml, "GBTRegressor", Watched)
    monkeypatch.setattr(ml, "FIT_ROWS", 100, raising=False)
    rows = spark.range(4000).select(
        F.timestamp_seconds(F.col("id") * 300).alias("tbin_utc"), (F.col("id") % 7).cast("double").alias("y_nb"), (F.col("id") % 5).cast("float").alias("a"))
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    pack, errors = ml.train(rows, 360, max_iter=2, features=["a"])
    assert sum(seen) == 3600 and max(seen) <= 100
    assert errors.first().n_valid == 400 and spark.conf.get("spark.sql.files.minPartitionNum", None) == before
    scored = pack.model.transform(ml.model_input(rows, ["a"])).agg(F.count("y_pred").alias("n")).first()
    assert scored.n == 4000


class Scorer:
    """Stands for a fitted model: the capacity less a fixed number."""

    def __init__(self, less):
        self.less = less

    def transform(self, rows):
        return rows.withColumn("y_pred", F.col("capacity") - self.less)


def test_bundle_holds_what_the_models_predict(spark, monkeypatch):
    # Five stations on the six-hour grid up to 18:00 of 30 January; the last one's rows are all older than the history.
    grid = spark.range(5 * 60).select((F.col("id") % 5).alias("s"), F.floor(F.col("id") / 5).alias("b"))
    end = F.when(F.col("s") == 4, F.lit("2024-01-10 18:00:00")).otherwise("2024-01-30 18:00:00").cast("timestamp")
    bin_ = F.timestamp_seconds(F.unix_timestamp(end) - F.col("b") * 6 * 3600)
    panel = clean.enforce_schema(grid.select(
        F.concat(F.lit("s"), "s").alias("station_id"), bin_.alias("ts_utc"), bin_.alias("tbin_utc"),
        (F.col("b") % 10).cast("int").alias("bikes"), (20 + F.col("s")).cast("int").alias("capacity"), F.lit("OK").alias("status"),
        (48.8 + F.col("s") * 0.01).alias("lat"), (2.3 + F.col("s") * 0.01).alias("lon")))
    st = spatial.stations_of(panel)
    parts = {"static": spatial.station_static(st, k=2), "knn": spatial.knn_map(st, 2), "mapping": clean.status_mapping(panel)}
    packs = [ml.ModelPack(Scorer(less), h, f"v{h}", ("capacity",)) for h, less in ((360, 2.4), (720, 30.0))]
    monkeypatch.setattr(reports, "model_parts", lambda s, d: {"panel": panel, "parts": parts, "packs": packs})
    got = reports.forecast_bundle(spark, "")
    now, rows = datetime(2024, 1, 30, 18), got.collect()
    assert sorted((r.station_id, r.horizon_min, round(r.bikes_pred, 4), r.bikes_pred_int) for r in rows) == sorted(
        p for i in range(4) for p in ((f"s{i}", 360, round(17.6 + i, 4), 18 + i), (f"s{i}", 720, -10.0 + i, 0)))
    assert {(r.horizon_min, r.generated_at, r.rows, r.model_version) for r in rows} == {(360, now, 4, "v360"), (720, now, 4, "v720")}
    assert {(r.horizon_min, r.tbin_latest, r.target_ts_utc) for r in rows} == {
        (360, now, datetime(2024, 1, 31)), (720, now, datetime(2024, 1, 31, 6))}
    assert {r.capacity_bin for r in rows} == {20, 21, 22, 23}
