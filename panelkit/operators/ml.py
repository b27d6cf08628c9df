"""Forecasting and station clustering on Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelkit.config import KNN_LAGS, LAG_BINS, ROLL_BINS, PanelConfig
from panelkit.functions import columns as X
from panelkit.operators.clean import as_ts, status_code, window_filter
from panelkit.operators.evaluate import error_metrics
from panelkit.operators.features import (
    calendar_features, history_features, latest_rows, recent_history,
)
from panelkit.operators.quantiles import quantiles
from panelkit.operators.rows import small_side
from panelkit.operators.spatial import knn_map, neighbour_mean, station_static, stations_of
from panelkit.operators.trees import node_table, split_importances
from panelkit.operators.views import importance_share
from panelkit.session import materialize

CFG = PanelConfig()

# The model's input columns, in order.
TIME_FEATURES = [
    "capacity", "mechanical", "ebike", "lat", "lon", "temp_C", "precip_mm", "wind_mps", "occ_ratio",
    *[f"lag_bikes_{n}" for n in LAG_BINS],
    *[f"roll_mean_{n}" for n in ROLL_BINS],
    *[f"roll_std_{n}" for n in ROLL_BINS],
    "temp_C_lag1", "precip_mm_lag1", "wind_mps_lag1",
    "hour", "minute", "dow", "month", "is_weekend", "hod_sin", "hod_cos", "dow_sin", "dow_cos",
    "paris_hour", "paris_dow", "paris_is_we", "status_code",
]
STATIC_FEATURES = ["dist_center_km", "grid_x", "grid_y", "kmeans_cluster", "te_cap_mean"]
KNN_FEATURES = [f"knn_mean_bikes_lag{n}" for n in KNN_LAGS]
FEATURES = TIME_FEATURES + STATIC_FEATURES + KNN_FEATURES


# Missing inputs get a value below every real one, so a tree can split them off.
MISSING = -9999.0
# Training rows of one file and partition: about a kilobyte a row while trees are grown.
FIT_ROWS = 100_000


def model_input(df: DataFrame, feats: list[str] | tuple[str, ...]) -> DataFrame:
    """The inputs as doubles with missing values marked."""
    return df.withColumns({c: F.col(c).cast("double") for c in feats}).na.fill(MISSING, list(feats))


@dataclass
class ModelPack:
    """A fitted pipeline with what is needed to apply it."""

    model: PipelineModel
    horizon_min: int
    version: str = "1.0.0"
    features: tuple[str, ...] = tuple(FEATURES)

    def save(self, spark, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        meta = [(self.horizon_min, self.version, list(self.features))]
        spark.createDataFrame(meta, "horizon_min int, version string, features array<string>").coalesce(1).write.mode(
            "overwrite"
        ).json(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> ModelPack:
        m = spark.read.schema("horizon_min int, version string, features array<string>").json(f"{path}/meta").first()
        if m is None or not m.features:
            raise ValueError(f"no model description in {path}")
        return cls(PipelineModel.load(f"{path}/model"), m.horizon_min, m.version, tuple(m.features))


def feature_frame(
    df: DataFrame, cfg: PanelConfig = CFG, horizon_min: int | dict[str, int] | None = None, *, mapping: DataFrame,
    static: DataFrame | None = None, knn: DataFrame | None = None, mode: str = "rows", latest: bool = False,
) -> DataFrame:
    """All 53 features (and the target `y_nb`, or targets by name), the same for training and serving.

    `latest` keeps each station's last row, before the wide rows meet the neighbours' bins.
    """
    stations = None
    if static is None or knn is None:
        stations = materialize(stations_of(df), "stations")
    static = static if static is not None else materialize(station_static(stations), "static")
    knn = knn if knn is not None else materialize(knn_map(stations), "knn")
    if not isinstance(horizon_min, dict):
        horizon_min = {"y_nb": horizon_min} if horizon_min else {}
    targets = {name: X.strict_horizon_bins(h, cfg.bin_min) for name, h in horizon_min.items()}
    out = history_features(df, cfg, mode, targets)
    out = neighbour_mean(latest_rows(out) if latest else out, small_side(knn), KNN_LAGS, cfg, panel=df)
    out = status_code(calendar_features(out, tz=cfg.tz), mapping)
    return out.join(small_side(static.drop("lat", "lon")), "station_id", "left")


def training_frame(df: DataFrame, start, end_date, cfg: PanelConfig, horizon_min: int, **parts) -> DataFrame:
    """Features of [start, end_date + 1 day - 1 bin] with a known target, as floats."""
    return _known(_training_features(df, start, end_date, cfg, {"y_nb": horizon_min}, **parts), "y_nb")


def training_frames(df: DataFrame, start, end_date, cfg: PanelConfig, horizons_min: tuple[int, ...], **parts) -> list[DataFrame]:
    """`training_frame` for each horizon; the features are made and written once for all."""
    targets = {f"y_nb_{h}": h for h in horizons_min}
    wide = materialize(_training_features(df, start, end_date, cfg, targets, **parts), "training-rows")
    return [_known(wide, name) for name in targets]


def _training_features(df: DataFrame, start, end_date, cfg: PanelConfig, targets: dict[str, int], **parts) -> DataFrame:
    """Features as floats of the rows with some known target."""
    last = as_ts(end_date) + F.expr(f"interval {24 * 60 - cfg.bin_min} minutes")
    rows = window_filter(df, "tbin_utc", start, last, "[]")
    return feature_frame(rows, cfg, targets, **parts).filter(F.coalesce(*targets).isNotNull()).select(
        "station_id", "tbin_utc", *[F.col(c).cast("double").alias(c) for c in targets],
        *[F.col(c).cast("float").alias(c) for c in FEATURES],
    )


def _known(wide: DataFrame, target: str) -> DataFrame:
    """The rows whose target is known, as `y_nb`."""
    return wide.filter(F.col(target).isNotNull()).select("station_id", "tbin_utc", F.col(target).alias("y_nb"), *FEATURES)


def lookback(df: DataFrame, days: int, ts: str = "tbin_utc") -> DataFrame:
    """[floor_day(tmax - days), tmax]."""
    tmax = df.agg(F.max(ts)).scalar()
    return df.filter(F.col(ts) >= F.date_trunc("day", tmax - F.expr(f"interval {int(days)} days")))


def temporal_split(df: DataFrame, train_frac: float = 0.9, ts: str = "tbin_utc") -> DataFrame:
    """`is_valid` marks the rows after the time that holds the first `train_frac` of rows."""
    q = quantiles(df, [], F.unix_timestamp(ts), [train_frac], name="_q")
    cut = q.select(F.col("_q")[0].alias("c")).scalar()
    return df.withColumn("is_valid", F.unix_timestamp(ts) > cut)


@contextmanager
def partitions_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Files are read in partitions of about FIT_ROWS rows, where `rows` rows make more of these than there are cores."""
    key, least = "spark.sql.files.minPartitionNum", -(-rows // FIT_ROWS)
    before = spark.conf.get(key, None)
    if least > max(spark.sparkContext.defaultParallelism, int(before or 0)):
        spark.conf.set(key, str(least))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def train(
    df: DataFrame, horizon_min: int, *, version: str = "1.0.0", max_iter: int = 100, max_depth: int = 6,
    step_size: float = 0.1, subsample: float = 0.8, seed: int = 42, features: list[str] | None = None,
    train_frac: float = 0.9,
) -> tuple[ModelPack, DataFrame]:
    """Gradient-boosted trees with early stopping on the latest rows; returns the pack and its errors.

    Boosting reads its rows many times: they are written as assembled vectors, the validation rows in a folder of
    their own, in files that bound what one task reads and holds.
    """
    feats, spark = features or FEATURES, df.sparkSession
    assembler = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="error")
    inputs = model_input(temporal_split(df, train_frac), feats)
    vectors = inputs.select("y_nb", array_to_vector(F.array(*feats)).alias("features"), "is_valid")
    split = materialize(vectors, "training", by="is_valid", maxRecordsPerFile=FIT_ROWS)
    boosted = GBTRegressor(
        labelCol="y_nb", predictionCol="y_pred", maxIter=max_iter, maxDepth=max_depth, stepSize=step_size,
        subsamplingRate=subsample, seed=seed, validationIndicatorCol="is_valid", validationTol=0.001,
    )
    with partitions_of(spark, split.count()):
        model = boosted.fit(split)
    errors = (
        model.transform(split.filter("is_valid"))
        .agg(*error_metrics("y_nb", "y_pred"), F.count(F.lit(1)).alias("n_valid"))
    )
    return ModelPack(PipelineModel([assembler, model]), horizon_min, version, tuple(feats)), errors


def predict(df: DataFrame, pack: ModelPack, now=None) -> DataFrame:
    """Scored rows: prediction, clipped integer, horizon, times and model version."""
    missing = [c for c in pack.features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    issued = as_ts(now) if now is not None else F.current_timestamp()
    cap = F.col("_cap").cast("int")
    scored = pack.model.transform(model_input(df.withColumn("_cap", F.col("capacity")), pack.features))
    return scored.select(
        "station_id",
        F.col("tbin_utc").alias("tbin_latest"),
        F.lit(pack.horizon_min).cast("short").alias("horizon_min"),
        F.col("y_pred").cast("float").alias("bikes_pred"),
        X.clip_round("y_pred", cap).cast("short").alias("bikes_pred_int"),
        cap.alias("capacity_bin"),
        issued.alias("pred_ts_utc"),
        (F.col("tbin_utc") + F.expr(f"interval {pack.horizon_min} minutes")).alias("target_ts_utc"),
        F.lit(pack.version).alias("model_version"),
    )


def predict_latest(df: DataFrame, pack: ModelPack, cfg: PanelConfig = CFG, now=None, **parts) -> DataFrame:
    """Forecast from each station's last row, with enough history for every lag."""
    minutes = (max(*LAG_BINS, *ROLL_BINS) + 1) * cfg.bin_min
    rows = recent_history(df, minutes, bin_min=cfg.bin_min)
    return predict(feature_frame(rows, cfg, latest=True, **parts), pack, now)


def feature_importance(spark, pack: ModelPack, k: int | None = None) -> DataFrame:
    """Per model input: importance with its share, and gain, weight, cover and shares counted from the trees' nodes.

    Inputs that no tree splits on have zeros.
    """
    model = pack.model.stages[-1]
    weights = model.featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(pack.features, weights)), "feature string, importance double")
    splits = split_importances(node_table(spark, model, pack.features))
    zero = {c: F.coalesce(c, F.lit(0).cast(t)) for c, t in splits.dtypes if c != "feature"}
    # One row per model input on both sides.
    return importance_share(rows, k).join(F.broadcast(splits), "feature", "left").withColumns(zero)


# ---- clustering -----------------------------------------------------------------------------------


def profile_vectors(profiles: DataFrame) -> DataFrame:
    """(station_id, features): 24-hour profiles; a missing hour gets the network's mean of that hour."""
    means = profiles.agg(F.array(*[F.coalesce(F.avg(F.col("profile")[h]), X.dbl(0)) for h in range(24)])).scalar()
    filled = F.zip_with("profile", "_means", lambda v, m: F.coalesce(v, m))
    return profiles.withColumn("_means", means).select("station_id", array_to_vector(filled).alias("features"))


def davies_bouldin(labelled: DataFrame, model) -> float:
    """Mean over clusters of the worst (spread_i + spread_j) / centre distance."""
    spark = labelled.sparkSession
    centers = [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]
    ctr = spark.createDataFrame(centers, "cluster int, center array<double>")
    dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), X.dbl(0), lambda s, v: s + v))
    # k centres: a fixed, small side.
    spread = (
        labelled.select("cluster", vector_to_array("features").alias("f"))
        .join(F.broadcast(ctr), "cluster")
        .groupBy("cluster", "center").agg(F.avg(dist(F.col("f"), F.col("center"))).alias("s"))
    )
    rows = spread.collect()  # k rows
    worst = []
    for a in rows:
        ratios = [
            (a.s + b.s) / d for b in rows if b.cluster != a.cluster
            for d in [sum((x - y) ** 2 for x, y in zip(a.center, b.center)) ** 0.5] if d > 0
        ]
        worst.append(max(ratios, default=0.0))
    return sum(worst) / len(worst) if worst else 0.0


@dataclass
class Clustering:
    labels: DataFrame
    centroids: DataFrame
    k: int
    silhouette: float | None
    davies_bouldin: float | None


def cluster_profiles(
    profiles: DataFrame, k: int | None = None, k_min: int = 2, k_max: int = 8, seed: int = 42
) -> Clustering:
    """KMeans on the profiles; without `k` the one with the best silhouette.

    The silhouette is Spark's, on squared distances. Fewer than five stations
    give one cluster, the mean profile.
    """
    spark = profiles.sparkSession
    vec = materialize(profile_vectors(profiles), "profiles")
    n = vec.count()
    if n < 5:
        mean = profiles.select("station_id", F.posexplode("profile").alias("h", "v")).groupBy("h").agg(
            F.avg("v").alias("v")
        )
        center = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "v"))), lambda s: s["v"]).alias("y"))
        return Clustering(
            vec.select("station_id", F.lit(None).cast("int").alias("cluster")),
            center.select(F.lit(0).alias("cluster"), "y"), 1, None, None,
        )
    judge = ClusteringEvaluator(predictionCol="cluster", metricName="silhouette")
    best = None
    for kk in [k] if k else range(k_min, max(k_min, k_max) + 1):
        model = KMeans(k=kk, seed=seed, predictionCol="cluster").fit(vec)
        labelled = model.transform(vec)
        found = len(model.clusterCenters())
        score = judge.evaluate(labelled) if found > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, kk, model, labelled)
    score, kk, model, labelled = best
    centers = spark.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cluster int, y array<double>"
    )
    return Clustering(
        labelled.select("station_id", "cluster"), centers, kk, score, davies_bouldin(labelled, model)
    )


@dataclass
class ProfilePca:
    scores: DataFrame
    components: DataFrame
    var_ratio: tuple[float, float]


def profile_pca(profiles: DataFrame) -> ProfilePca:
    """First two principal components of the centred profiles; signs are arbitrary."""
    spark = profiles.sparkSession
    vec = profile_vectors(profiles)
    centred = StandardScaler(inputCol="features", outputCol="c", withMean=True, withStd=False).fit(vec).transform(vec)
    model = PCA(k=2, inputCol="c", outputCol="p").fit(centred)
    s = vector_to_array("p")
    loadings = model.pc.toArray()  # 24 x 2
    comps = spark.createDataFrame(
        [(f"{h:02d}:00", float(loadings[h][0]), float(loadings[h][1])) for h in range(24)],
        "hour string, pc1 double, pc2 double",
    )
    ratio = [float(v) for v in model.explainedVariance.toArray()]
    return ProfilePca(
        model.transform(centred).select("station_id", s[0].alias("PC1"), s[1].alias("PC2")), comps, (ratio[0], ratio[1])
    )

