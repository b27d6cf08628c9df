"""Drift between a reference and a current window.

Features are handled in long form (feature, value), so one set of jobs covers
all of them and a wide table adds rows, not jobs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelkit.config import EMA_ALPHA, PanelConfig
from panelkit.functions import columns as X
from panelkit.operators.quantiles import bin_left_closed, counted, quantiles_of_counts, unique_edges
from panelkit.operators.rows import combine
from panelkit.operators.scan import ema
from panelkit.session import materialize

CFG = PanelConfig()

# Columns that are identifiers, clock or position, not features.
NOT_FEATURES = {
    "station_id", "date_local", "dow", "hour", "h", "min", "ts_local", "lat", "lon", "tbin_utc", "ts", "timestamp",
    "status", "name",
}
NOT_FEATURE_PATTERNS = (r".*_(sin|cos)$", r"^(hour|minute|dow)(_|$)")
EPS = 1e-9
MIN_VALUES = 5
DISTRICT_COLUMNS = ("arrondissement", "arr", "zone", "district")


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither identifiers nor clock nor position."""
    return sorted(
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in NOT_FEATURES
        and not any(re.match(p, f.name) for p in NOT_FEATURE_PATTERNS)
    )


def drift_bounds(df: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    """tmax and the edges of both windows, one row."""
    tmax = F.max("tbin_utc")
    cur = tmax - F.expr(f"interval {cfg.last_days} days")
    return df.agg(
        tmax.alias("tmax"),
        cur.alias("cur_start"),
        (cur - F.expr(f"interval {cfg.ref_days} days")).alias("ref_start"),
        cur.alias("ref_end"),
    )


def split_windows(df: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    """Rows of both windows with `win`: cur in [tmax-C, tmax], ref in [tmax-C-R, tmax-C)."""
    tmax = df.agg(F.max("tbin_utc")).scalar()
    age = F.unix_timestamp(tmax) - F.unix_timestamp("tbin_utc")
    day = 86_400
    return df.filter(age <= (cfg.last_days + cfg.ref_days) * day).withColumn(
        "win", F.when(age <= cfg.last_days * day, "cur").otherwise("ref")
    )


def daily_feature_means(df: DataFrame, cfg: PanelConfig = CFG, features: list[str] | None = None) -> DataFrame:
    """Mean of every feature per (window, local day, station), wide.

    Means are kept to 12 digits: the order in which a sum was merged must not
    move a value across the edge of a quantile bin.
    """
    feats = features or feature_columns(df)
    place = [c for c in ("lat", "lon") if c in df.columns]
    src = df if "win" in df.columns else split_windows(df, cfg)
    district = next((c for c in DISTRICT_COLUMNS if c in df.columns), None)
    keep = [F.max(district).alias(district)] if district else []
    return src.groupBy("win", X.local_day("tbin_utc", cfg.tz).alias("date_local"), "station_id").agg(
        *[F.round(F.avg(F.col(c).cast("double")), 12).alias(c) for c in (*feats, *place)], *keep
    )


def long_features(means: DataFrame, features: list[str]) -> DataFrame:
    """(win, date_local, station_id, feature, value)."""
    return means.unpivot(["win", "date_local", "station_id"], features, "feature", "value").filter("value is not null")


def window_stats(vc: DataFrame, groups: list[str]) -> DataFrame:
    """Per group: size, range, mean and sample variance of each window, from value counts."""
    aggs = []
    for w in ("ref", "cur"):
        here = F.col("win") == w
        v, n = F.when(here, F.col("_v")), F.when(here, F.col("_w"))
        aggs += [
            F.coalesce(F.sum(n), F.lit(0)).alias(f"n_{w}"),
            F.min(v).alias(f"min_{w}"),
            F.max(v).alias(f"max_{w}"),
            (F.sum(v * n) / F.sum(n)).alias(f"mean_{w}"),
        ]
    first = vc.groupBy(*groups).agg(*aggs)
    # Deviations from the mean, not sums of squares: no cancellation.
    dev = (
        vc.join(first.select(*groups, "mean_ref", "mean_cur"), groups)
        .withColumn("_d", F.col("_v") - F.when(F.col("win") == "ref", F.col("mean_ref")).otherwise(F.col("mean_cur")))
        .groupBy(*groups)
        .agg(*[
            F.sum(F.when(F.col("win") == w, F.col("_d") * F.col("_d") * F.col("_w"))).alias(f"ss_{w}")
            for w in ("ref", "cur")
        ])
    )
    var = lambda w: F.when(F.col(f"n_{w}") > 1, F.col(f"ss_{w}") / (F.col(f"n_{w}") - 1)).alias(f"var_{w}")
    return first.join(dev, groups).select(*first.columns, var("ref"), var("cur"))


def _enough() -> Column:
    return (F.col("n_ref") >= MIN_VALUES) & (F.col("n_cur") >= MIN_VALUES)


def _bin_shares(vc: DataFrame, groups: list[str], edges: DataFrame, small: bool) -> DataFrame:
    """Counts of both windows per (group, bin)."""
    right = F.broadcast(edges) if small else edges
    return (
        vc.join(right, groups)
        .withColumn("bin", bin_left_closed("_v", "_edges"))
        .filter("bin is not null")
        .groupBy(*groups, "bin")
        .agg(
            F.sum(F.when(F.col("win") == "ref", F.col("_w")).otherwise(0)).alias("c_ref"),
            F.sum(F.when(F.col("win") == "cur", F.col("_w")).otherwise(0)).alias("c_cur"),
        )
    )


def _distinct(q: Column) -> Column:
    """Distinct quantile edges, to 12 digits like the values.

    Interpolation can miss a value it should hit by one rounding, which would
    leave two edges where there is one.
    """
    return unique_edges(F.transform(q, lambda e: F.round(e, 12)))


def window_edges(vc: DataFrame, groups: list[str], bins: int, points: int, more: DataFrame | None = None) -> DataFrame:
    """Per group `_ref` (edges of reference quantile bins) and `_pooled` (quantile points of both windows), one rank pass.

    `more` adds value counts (groups, _kind, _v, _w); their medians come as `_medians`, a map by kind.
    """
    ref = vc.filter("win = 'ref'").select(*groups, F.lit("_ref").alias("_kind"), "_v", "_w")
    pooled = vc.groupBy(*groups, "_v").agg(F.sum("_w").alias("_w")).select(*groups, F.lit("_pooled").alias("_kind"), "_v", "_w")
    counts = ref.unionByName(pooled)
    if more is not None:
        counts = counts.unionByName(more.select(*groups, "_kind", "_v", "_w"))
    probs = [i / bins for i in range(bins + 1)] + [i / (points - 1) for i in range(points)] + [0.5]
    q = quantiles_of_counts(counts, [*groups, "_kind"], probs, name="_q")
    part = lambda kind, at, n: F.max(F.when(F.col("_kind") == kind, F.slice("_q", at, n)))
    out = q.groupBy(*groups).agg(
        part("_ref", 1, bins + 1).alias("_ref"), part("_pooled", bins + 2, points).alias("_pooled"),
        F.map_from_entries(F.collect_list(F.struct("_kind", F.element_at("_q", -1)))).alias("_medians"))
    return materialize(out.select(*groups, _distinct(F.col("_ref")).alias("_ref"), _distinct(F.col("_pooled")).alias("_pooled"), "_medians"), "window-edges")


def psi(vc: DataFrame, groups: list[str], stats: DataFrame, edges: DataFrame, small: bool = True) -> DataFrame:
    """Population stability index on reference quantile bins; null when undefined.

    Bins empty in both windows add nothing, so only occupied bins are built.
    """
    edges = edges.select(*groups, F.col("_ref").alias("_edges"))
    c = _bin_shares(vc, groups, edges, small)
    tot = c.groupBy(*groups).agg(F.sum("c_ref").alias("t_ref"), F.sum("c_cur").alias("t_cur"))
    p = F.try_divide("c_ref", "t_ref") + EPS
    q = F.try_divide("c_cur", "t_cur") + EPS
    raw = c.join(tot, groups).groupBy(*groups).agg(F.sum((p - q) * F.log(p / q)).alias("_psi"))
    ok = (
        _enough()
        & (F.col("min_ref") < F.col("max_ref"))
        & (F.col("min_cur") < F.col("max_cur"))
        & (F.size("_edges") >= 3)
    )
    return (
        stats.join(edges, groups, "left").join(raw, groups, "left")
        .select(*groups, F.when(ok, F.col("_psi")).alias("psi"))
    )


def ks(vc: DataFrame, groups: list[str], stats: DataFrame, edges: DataFrame, small: bool = True) -> DataFrame:
    """Largest gap of the two distribution functions on pooled quantiles."""
    edges = edges.select(*groups, F.col("_pooled").alias("_edges"))
    c = _bin_shares(vc, groups, edges, small)
    upto = Window.partitionBy(*groups).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    tot = c.groupBy(*groups).agg(F.sum("c_ref").alias("t_ref"), F.sum("c_cur").alias("t_cur"))
    gap = F.abs(F.try_divide("_cr", "t_ref") - F.try_divide("_cc", "t_cur"))
    raw = (
        c.withColumns({"_cr": F.sum("c_ref").over(upto), "_cc": F.sum("c_cur").over(upto)})
        .join(tot, groups)
        .groupBy(*groups)
        .agg(F.max(gap).alias("_ks"))
    )
    spread = F.least("min_ref", "min_cur") < F.greatest("max_ref", "max_cur")
    ok = _enough() & spread & (F.size("_edges") >= 3)
    return (
        stats.join(edges, groups, "left").join(raw, groups, "left")
        .select(*groups, F.when(ok, F.col("_ks")).alias("ks"))
    )


def mean_var_delta(stats: DataFrame, groups: list[str]) -> DataFrame:
    """Standardised change of mean and relative change of variance."""
    sd = F.sqrt("var_ref")
    ok = _enough() & (F.col("var_ref") > 0)
    return stats.select(
        *groups,
        F.when(ok, (F.col("mean_cur") - F.col("mean_ref")) / (sd + EPS)).alias("delta_mean"),
        F.when(ok, (F.col("var_cur") - F.col("var_ref")) / (F.col("var_ref") + EPS)).alias("delta_var"),
    )


def drift_metrics(
    df: DataFrame, cfg: PanelConfig = CFG, features: list[str] | None = None, means: DataFrame | None = None
) -> DataFrame:
    """PSI, KS and mean/variance change per feature, one row each."""
    feats = features or feature_columns(df)
    if means is None:
        means = daily_feature_means(df, cfg, feats)
    vc = materialize(counted(long_features(means, feats), ["feature", "win"], "value"), "feature-counts")
    g = ["feature"]
    stats = materialize(window_stats(vc, g), "feature-stats")
    # One row per feature: bounded by the table's columns.
    out = stats.filter(_enough()).select("feature", "n_ref", "n_cur")
    edges = window_edges(vc, g, cfg.psi_bins, cfg.ks_points)
    for part in (psi(vc, g, stats, edges), ks(vc, g, stats, edges), mean_var_delta(stats, g)):
        out = out.join(F.broadcast(part), "feature", "left")
    return out


def drift_by_zone(df: DataFrame, cfg: PanelConfig = CFG, means: DataFrame | None = None) -> DataFrame:
    """PSI of occupancy (else of bikes) per coordinate zone, with the zone's median position."""
    metric = next(c for c in ("occ_ratio", "bikes") if c in df.columns)
    if means is None:
        means = daily_feature_means(df, cfg, [metric])
    district = next((c for c in DISTRICT_COLUMNS if c in means.columns), None)
    z = means.withColumn("zone", X.zone_label("lat", "lon", 2, ",", district=district)).filter("zone is not null")
    vc = materialize(counted(z, ["zone", "win"], metric), "zone-counts")
    stats = window_stats(vc, ["zone"]).filter(_enough())
    place = z.filter("win = 'ref'").unpivot(["zone"], ["lat", "lon"], "_kind", "_value")
    edges = window_edges(vc, ["zone"], cfg.psi_bins, 2, counted(place, ["zone", "_kind"], "_value"))
    at = edges.select("zone", F.col("_medians")["lat"].alias("lat"), F.col("_medians")["lon"].alias("lon"))
    return psi(vc, ["zone"], stats, edges, small=False).join(at, "zone", "left")


def occupancy_ema(df: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    """EMA of the network's mean occupancy per local day."""
    daily = df.groupBy(X.local_day("tbin_utc", cfg.tz).alias("date_local")).agg(F.avg("occ_ratio").alias("occ_ratio"))
    return ema(daily, "occ_ratio", "date_local", alpha=EMA_ALPHA)


def drift_summary(metrics: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    """Global PSI (occupancy's, else the median), top feature and alert level, one row."""
    occ = F.max(F.when(F.col("feature") == "occ_ratio", F.col("psi")))
    has_occ = F.coalesce(F.bool_or(F.col("feature") == "occ_ratio"), F.lit(False))
    g = F.col("psi_global")
    level = F.when(g >= cfg.psi_high, "high").when(g >= cfg.psi_medium, "medium")
    return metrics.agg(
        F.when(has_occ, occ).otherwise(F.percentile("psi", 0.5)).alias("psi_global"),
        F.max_by("feature", "psi").alias("top_feature"),
        F.max("psi").alias("top_feature_psi"),
    ).withColumns({"alert_level": level, "alert_code": F.concat(F.lit("psi_global_"), level)})


def drift_report_row(df: DataFrame, metrics: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    return combine(drift_summary(metrics, cfg), drift_bounds(df, cfg))
