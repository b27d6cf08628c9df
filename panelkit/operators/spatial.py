"""Station geometry: static features, nearest neighbours, neighbour means."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from panelkit.config import CENTER, KNN_LAGS, PanelConfig
from panelkit.functions import columns as X
from panelkit.operators.blocks import block_window, drop_halo, with_halo
from panelkit.operators.clean import dedup_latest
from panelkit.session import materialize

CFG = PanelConfig()
# Cells of 2**level * 10 m; the top one spans the globe.
BASE_KM = 0.01
MAX_LEVEL = 21
CELL_TARGET = 64


def stations_of(df: DataFrame, ts: str = "tbin_utc") -> DataFrame:
    """Last (lat, lon, capacity) of each station."""
    return dedup_latest(df.select("station_id", ts, "lat", "lon", "capacity"), ["station_id"], (ts,), unique=True).drop(ts)


def cluster_capacity_mean(df: DataFrame, cluster: str = "kmeans_cluster") -> DataFrame:
    """Mean capacity of the row's cluster: per-cluster means joined back, one small row per cluster."""
    means = df.groupBy(cluster).agg(F.avg(F.col("capacity").cast("double")).alias("te_cap_mean"))
    return df.join(means, cluster, "left")


def station_static(
    stations: DataFrame, center: tuple[float, float] = CENTER, grid_m: float = 300, k: int = 30, seed: int = 42
) -> DataFrame:
    """Distance to the centre, grid cell, KMeans cluster and its mean capacity."""
    st = materialize(stations.select("station_id", "lat", "lon", "capacity"), "stations")
    gx, gy = X.grid_cell("lat", "lon", grid_m)
    st = st.withColumns(
        {
            "dist_center_km": X.haversine_km("lat", "lon", X.dbl(center[0]), X.dbl(center[1])),
            "grid_x": gx,
            "grid_y": gy,
        }
    )
    full = VectorAssembler(inputCols=["lat", "lon", "capacity"], outputCol="_v", handleInvalid="skip").transform(
        st.withColumn("capacity", F.col("capacity").cast("double"))
    )
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="kmeans_cluster").fit(full)
    labels = model.transform(full).select("station_id", "kmeans_cluster")
    return cluster_capacity_mean(st.join(labels, "station_id", "left")).select(
        "station_id", "lat", "lon", "dist_center_km", "grid_x", "grid_y", "kmeans_cluster", "te_cap_mean"
    )


# ---- k nearest stations ---------------------------------------------------------------------------


def _cell(level):
    """The 3-D cell of (x, y, z) at a level, as three longs."""
    size = F.pow(X.dbl(2), level) * BASE_KM
    return [F.floor(F.col(a) / size) for a in ("x", "y", "z")]


def _around(cell):
    """The 27 cells around and including a cell."""
    step = F.sequence(F.lit(-1), F.lit(1))
    xs = F.transform(step, lambda i: F.transform(step, lambda j: F.transform(step, lambda k: F.struct(
        (cell[0] + i).alias("cx"), (cell[1] + j).alias("cy"), (cell[2] + k).alias("cz")))))
    return F.flatten(F.flatten(xs))


def _base_level(sites: DataFrame) -> tuple[int, int]:
    """Finest useful and coarsest needed level, from per-level cell counts (22 rows).

    At the coarsest level all sites lie in adjoining cells, so everybody sees everybody.
    """
    span = [F.max(c) - F.min(c) for c in ("cx", "cy", "cz")]
    levels = (
        sites.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(MAX_LEVEL))))
        .withColumns(dict(zip(("cx", "cy", "cz"), _cell(F.col("lv")))))
        .groupBy("lv", "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("lv").agg(F.max("c").alias("most"), F.greatest(*span).alias("span"))
        .collect()
    )
    fine = max((r.lv for r in levels if r.most <= CELL_TARGET), default=0)
    coarse = min((r.lv for r in levels if r.span <= 1), default=MAX_LEVEL)
    return min(fine, coarse), coarse


def knn_map(stations: DataFrame, k: int = 5) -> DataFrame:
    """(station_id, rank, neighbor_id, dist_km): the k nearest stations, exact.

    No all-pairs step. Co-located stations become one site that keeps its k+1
    smallest ids, enough because ties go to the smaller id. Sites are cut in
    cubes of doubling size in 3-D; each site takes the finest level whose 27
    cubes hold k others, then searches the cubes of four times that size: the
    k-th neighbour is at most 2*sqrt(3) cube edges away, and four edges are
    covered. A site in a crowded spot therefore searches small cubes, a remote
    one large cubes.
    """
    # Stations and sites are read many times below: written once, however they were derived.
    st = materialize(
        stations.select("station_id", "lat", "lon").filter("lat is not null and lon is not null").distinct(), "stations"
    )
    at = Window.partitionBy("lat", "lon").orderBy("station_id")
    kept = st.withColumn("_rn", F.row_number().over(at)).filter(F.col("_rn") <= k + 1)
    la, lo, r = F.radians("lat"), F.radians("lon"), X.EARTH_RADIUS_KM
    sites = materialize(
        kept.groupBy("lat", "lon").agg(F.array_sort(F.collect_list("station_id")).alias("ids")).select(
            "lat", "lon", "ids", F.element_at("ids", 1).alias("site"),
            (F.cos(la) * F.cos(lo) * r).alias("x"), (F.cos(la) * F.sin(lo) * r).alias("y"), (F.sin(la) * r).alias("z"),
        ),
        "sites",
    )
    fine, coarse = _base_level(sites)
    lv = F.explode(F.sequence(F.lit(fine), F.lit(coarse)))
    cell = ["lv", "cx", "cy", "cz"]
    pts = sites.select("site", "x", "y", "z", lv.alias("lv"))
    counts = (
        pts.withColumns(dict(zip(cell[1:], _cell(F.col("lv"))))).groupBy(*cell).agg(F.count(F.lit(1)).alias("_c"))
    )
    level = (
        pts.select("site", "lv", F.explode(_around(_cell(F.col("lv")))).alias("c")).select("site", "lv", "c.*")
        .join(counts, cell)
        .groupBy("site", "lv").agg(F.sum("_c").alias("_near"))
        .groupBy("site")
        .agg((F.coalesce(F.min(F.when(F.col("_near") > k, F.col("lv"))), F.lit(coarse)) + 2).alias("lv"))
    )
    wide = F.explode(F.sequence(F.lit(fine + 2), F.lit(coarse + 2)))
    seek = (
        sites.join(level, "site")
        .select("site", "lat", "lon", "lv", F.explode(_around(_cell(F.col("lv")))).alias("c"))
        .select("site", "lat", "lon", "lv", "c.*")
    )
    target = (
        sites.withColumn("lv", wide).withColumns(dict(zip(cell[1:], _cell(F.col("lv")))))
        .select(*cell, F.col("site").alias("n_site"), F.col("ids").alias("n_ids"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"))
    )
    near = Window.partitionBy("site").orderBy("d", "n_site")
    site_pairs = (
        seek.join(target, cell)
        .withColumn("d", X.haversine_km("lat", "lon", "n_lat", "n_lon"))
        .withColumn("_rn", F.row_number().over(near))
        .filter(F.col("_rn") <= k + 1)
        .select("site", "lat", "lon", "n_ids", "d")
    )
    # Back to stations: each joins its site's candidates, at most (k+1)^2 ids.
    per_site = site_pairs.groupBy("lat", "lon").agg(F.collect_list(F.struct("d", "n_ids")).alias("cand"))
    ids = F.flatten(F.transform("cand", lambda c: F.transform(c["n_ids"], lambda i: F.struct(
        c["d"].alias("dist_km"), i.alias("neighbor_id")))))
    others = F.filter(ids, lambda e: e["neighbor_id"] != F.col("station_id"))
    return (
        st.join(per_site, ["lat", "lon"])
        .select("station_id", F.posexplode(F.slice(F.array_sort(others), 1, k)).alias("_p", "_n"))
        .select("station_id", (F.col("_p") + 1).alias("rank"), "_n.neighbor_id", "_n.dist_km")
    )


def neighbour_mean(
    df: DataFrame, knn: DataFrame, lags: tuple[int, ...] = KNN_LAGS, cfg: PanelConfig = CFG,
    panel: DataFrame | None = None,
) -> DataFrame:
    """Mean stock of the neighbours L bins ago, for every lag.

    `panel` holds the neighbours' rows when `df` is already widened with features.

    The neighbour mean of a bin is computed once; the lags are looked up by time
    in the blocks of the station, together with the panel's own rows.
    """
    source = df if panel is None else panel
    means = (
        knn.select("station_id", "neighbor_id")
        .join(source.select(F.col("station_id").alias("neighbor_id"), "tbin_utc", "bikes"), "neighbor_id")
        .groupBy("station_id", "tbin_utc")
        .agg(F.avg(F.col("bikes").cast("double")).alias("_m"))
    )
    rows = df.withColumn("_row", F.lit(True)).unionByName(
        means.withColumn("_row", F.lit(False)), allowMissingColumns=True
    )
    b = with_halo(rows, ["station_id"], "tbin_utc", cfg.bin_min, before=max(lags), block_bins=cfg.block_bins, mode="time")
    w = block_window(["station_id"], "_e")
    at = lambda n: F.max("_m").over(w.rangeBetween(-n * cfg.step_s, -n * cfg.step_s))
    out = b.withColumn("_e", F.unix_timestamp("tbin_utc")).withColumns({f"knn_mean_bikes_lag{n}": at(n) for n in lags})
    return drop_halo(out).filter("_row").drop("_e", "_m", "_row")
