"""Ranked and joined views over report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.functions import columns as X
from panelkit.operators.rows import running_sum, top
from panelkit.session import materialize

MIN_N = 30


def _matches(term: str, *cols: str) -> Column:
    """Case-insensitive substring match in any of the columns; an empty term matches all."""
    t = (term or "").strip().lower()
    if not t:
        return F.lit(True)
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False))
    return hit


def lift_extremes(by_station: DataFrame, k: int = 20, min_n: int = MIN_N) -> DataFrame:
    """The k best and k worst stations of each horizon by lift; a missing lift ranks lowest."""
    ok = by_station.filter(F.col("n") >= min_n)
    best = _ranked(ok, k, F.desc_nulls_last("lift_vs_baseline")).withColumn("side", F.lit("top"))
    worst = _ranked(ok, k, F.asc_nulls_first("lift_vs_baseline")).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def _ranked(rows: DataFrame, k: int, order: Column) -> DataFrame:
    """The first k rows of each horizon; a rank limit, pruned in every map task."""
    w = Window.partitionBy("horizon_bins").orderBy(order, "station_id")
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def top_tension_rates(rates: DataFrame, k: int = 20) -> DataFrame:
    """Top k by penury and top k by saturation, in percent."""
    parts = []
    for kind in ("penury", "saturation"):
        c = f"{kind}_rate"
        rows = top(rates.filter(F.col(c).isNotNull()), k, F.desc(c), "station_id")
        parts.append(rows.select(F.lit(kind).alias("kind"), "station_id", (F.col(c) * 100.0).alias("pct")))
    return parts[0].unionByName(parts[1])


def worst_coverage(health: DataFrame, k: int = 50, term: str = "") -> DataFrame:
    return top(health.filter(_matches(term, "name", "station_id")), k, F.asc_nulls_last("coverage_pct"), "station_id")


def top_bias(bias: DataFrame, k: int = 160, min_n: int = MIN_N) -> DataFrame:
    rows = bias.filter(F.col("n") >= min_n).withColumn("abs_bias", F.abs(F.coalesce("bias", X.dbl(0))))
    return _ranked(rows, k, F.desc("abs_bias"))


def top_tension(tension: DataFrame, k: int = 200, term: str = "") -> DataFrame:
    score = F.coalesce("tension_index", X.dbl(0))
    return top(tension.filter(_matches(term, "station_id", "name")), k, score.desc(), "station_id")


def drift_table(metrics: DataFrame, term: str = "", min_psi: float = 0.0, k: int | None = None) -> DataFrame:
    """Features matching a term with PSI at or above a floor (or unknown), largest first; k for the chart."""
    rows = metrics.filter(F.col("psi").isNotNull() | F.col("ks").isNotNull()).filter(_matches(term, "feature"))
    rows = rows.filter(F.coalesce(F.col("psi") >= min_psi, F.lit(True)))
    order = (F.desc_nulls_last("psi"), F.asc("feature"))
    return top(rows, k, *order) if k else rows.orderBy(*order)


def latest_time(df: DataFrame, first: str, fallback: str | None = None) -> DataFrame:
    """Latest value of a time column, row-wise falling back to another."""
    c = F.coalesce(first, fallback) if fallback else F.col(first)
    return df.agg(F.max(c).alias("latest"))


def importance_share(rows: DataFrame, k: int | None = None) -> DataFrame:
    """Share and running share (percent) by descending importance."""
    positive = F.greatest(F.col("importance"), X.dbl(0))
    total = rows.agg(F.sum(positive)).scalar()
    shares = rows.filter("importance is not null").withColumn(
        "share", F.coalesce(F.try_divide(F.col("importance"), total) * 100.0, X.dbl(0))
    )
    out = running_sum(shares, "share", "cum", [F.desc("importance"), F.asc("feature")])
    return top(out, k, F.desc("importance"), "feature") if k else out


def top_error_runs(runs: DataFrame, k: int) -> DataFrame:
    """The k longest error runs of each horizon."""
    return _ranked(runs, k, F.desc("max_run"))


def error_run_map(runs: DataFrame, stations: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """Longest error run per located station, and whether it reaches the upper median."""
    per = (
        runs.groupBy("station_id").agg(F.max("max_run").alias("max_run"), F.sum("n").alias("n"))
        .filter(F.col("n") >= min_n)
    )
    # Upper median over a small domain: the counts of each run length.
    sizes = per.groupBy("max_run").agg(F.count(F.lit(1)).alias("c"))
    order = Window.orderBy("max_run").rowsBetween(Window.unboundedPreceding, 0)
    total = per.agg(F.count(F.lit(1))).scalar()
    med = sizes.withColumn("_cum", F.sum("c").over(order)).filter(F.col("_cum") > F.floor(total / 2)).agg(F.min("max_run")).scalar()
    return (
        per.join(stations.select("station_id", "name", "lat", "lon"), "station_id")
        .filter("lat is not null and lon is not null")
        .withColumns({"name": F.coalesce("name", "station_id"), "above_median": F.col("max_run") >= med})
    )


def forecast_map_view(stations: DataFrame, forecast: DataFrame) -> DataFrame:
    """Every station with its forecast, where there is one, and both fill levels."""
    cap = F.greatest(F.coalesce("capacity", F.lit(0)), F.lit(1))
    bikes = F.greatest(F.coalesce("num_bikes_available", F.lit(0)), F.lit(0))
    f = forecast.select("station_id", "horizon_min", "bikes_pred_int")
    return stations.join(f, "station_id", "left").withColumns(
        {"occ_now": bikes / cap, "occ_pred": F.col("bikes_pred_int") / cap}
    )


def forecast_lookup(forecast: DataFrame, horizon_min: int, station_ids: DataFrame | list[str] | None = None) -> DataFrame:
    """Rows of one horizon, optionally of some stations; an unknown horizon fails.

    The forecast is written once, so that testing for the horizon doesn't run it again.
    """
    rows = materialize(forecast.filter(F.col("horizon_min") == horizon_min), "forecast")
    if rows.isEmpty():
        raise ValueError(f"no forecast for a horizon of {horizon_min} min")
    if station_ids is None:
        return rows
    if isinstance(station_ids, DataFrame):
        return rows.join(station_ids.select("station_id").distinct(), "station_id", "left_semi")
    return rows.filter(F.col("station_id").isin(list(station_ids)))


def station_index(meta: DataFrame) -> DataFrame:
    """(key, station_id, name, lat, lon): each named station under its id and under the id without zeros."""
    clean = meta.withColumns({"name": F.trim("name"), "_code": X.trim_code("station_id")}).filter(
        "_code is not null and name != ''"
    )
    return (
        clean.withColumn("key", F.explode(F.array_distinct(F.array(F.col("station_id").cast("string"), F.col("_code")))))
        .withColumn("_own", (F.col("key") == F.col("station_id")).cast("int"))
        .groupBy("key")
        .agg(F.max_by(F.struct("station_id", "name", "lat", "lon"), F.struct("_own", "station_id")).alias("m"))
        .select("key", "m.*")
    )


def with_station_meta(points: DataFrame, meta: DataFrame) -> DataFrame:
    """Cluster points with name and position from the station index, by id or zero-stripped id."""
    idx = station_index(meta)
    by_id = idx.select(F.col("key").alias("station_id"), F.struct("name", "lat", "lon").alias("_a"))
    by_code = idx.select(F.col("key").alias("_code"), F.struct("name", "lat", "lon").alias("_b"))
    out = points.withColumn("_code", X.trim_code("station_id")).join(by_id, "station_id", "left").join(by_code, "_code", "left")
    m = lambda c: F.coalesce(F.col(f"_a.{c}"), F.col(f"_b.{c}"))
    has = set(points.columns)
    name = F.coalesce(*([F.col("name")] if "name" in has else []), m("name"))
    return out.withColumns(
        {
            "name": name,
            "lat": F.coalesce(m("lat"), *([F.col("lat")] if "lat" in has else [])),
            "lon": F.coalesce(m("lon"), *([F.col("lon")] if "lon" in has else [])),
        }
    ).filter("lat is not null and lon is not null").drop("_code", "_a", "_b")
