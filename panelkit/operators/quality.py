"""Data quality: freshness, coverage, latency, duplicates, flat sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelkit.config import PanelConfig
from panelkit.functions import columns as X
from panelkit.operators.blocks import runs
from panelkit.operators.clean import KEYS, as_ts, dedup_latest, last_non_null
from panelkit.operators.quantiles import quantiles
from panelkit.operators.rows import combine, top
from panelkit.session import materialize

CFG = PanelConfig()
HUNDRED = 100.0


# ---- freshness --------------------------------------------------------------------


def feed_freshness(df: DataFrame, now, weather: DataFrame | None = None, ts: str = "src_ts_utc") -> DataFrame:
    """Age quantiles of the source timestamps, station count and weather age, one row."""
    age = X.minutes_between(as_ts(now), ts)
    out = [
        df.agg(F.count_distinct("station_id").alias("stations"), F.max(age).alias("max_min")),
        quantiles(df, [], age, [0.5, 0.95], name="_q").select(
            F.col("_q")[0].alias("p50_min"), F.col("_q")[1].alias("p95_min")
        ),
    ]
    if weather is not None:
        out.append(weather.agg(X.minutes_between(as_ts(now), F.max("hour_utc")).alias("weather_min")))
    return combine(*out)


def oldest_stations(df: DataFrame, now, k: int = 50, ts: str = "src_ts_utc") -> DataFrame:
    """The k rows with the oldest source timestamp."""
    aged = df.select("station_id", X.minutes_between(as_ts(now), ts).alias("freshness_min"))
    return top(aged.filter("freshness_min is not null"), k, F.desc("freshness_min"), "station_id")


def station_bins(df: DataFrame) -> DataFrame:
    """Per station: rows, distinct bins, first and last bin.

    Counted per (station, bin) first, so a repeated or hot station collapses
    before the per-station shuffle.
    """
    return (
        df.groupBy("station_id", "tbin_utc")
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy("station_id")
        .agg(
            F.sum("_c").alias("rows"),
            F.count("tbin_utc").alias("obs"),
            F.min("tbin_utc").alias("first_bin"),
            F.max("tbin_utc").alias("last_bin"),
        )
    )


def panel_freshness(
    df: DataFrame, now, slo_min: float = CFG.freshness_slo_min, bins: DataFrame | None = None
) -> DataFrame:
    """Age of every station's last bin: p50, p95 and whether p95 meets the objective."""
    last = bins if bins is not None else df.groupBy("station_id").agg(F.max("tbin_utc").alias("last_bin"))
    # Ages sit on the grid, so there are at most as many as bins in the window.
    q = quantiles(last, [], X.minutes_between(as_ts(now), "last_bin"), [0.5, 0.95], name="_q")
    p50, p95 = F.col("_q")[0], F.col("_q")[1]
    return q.select(
        p50.alias("freshness_age_p50_min"),
        p95.alias("freshness_age_p95_min"),
        X.dbl(slo_min).alias("freshness_slo_min"),
        (p95 <= slo_min).alias("freshness_p95_ok"),
    )


# ---- coverage ---------------------------------------------------------------------


def days_present(df: DataFrame) -> Column:
    """Distinct UTC days in the frame, as a scalar."""
    return df.agg(F.count_distinct(F.to_date("tbin_utc"))).scalar()


def coverage_table(df: DataFrame, cfg: PanelConfig = CFG, bins: DataFrame | None = None) -> DataFrame:
    """Per station: observed and expected bins over the days present in the data.

    Here and below `bins` is a prepared `station_bins` table, so that several
    reports share its scan.
    """
    return (bins if bins is not None else station_bins(df)).withColumn("_exp", days_present(df) * F.lit(cfg.bins_per_day)).select(
        "station_id",
        F.least("obs", "_exp").alias("obs"),
        F.col("_exp").alias("expected"),
        (F.least("obs", "_exp") / F.col("_exp") * HUNDRED).alias("coverage_pct"),
        F.greatest(F.col("_exp") - F.col("obs"), F.lit(0)).alias("missing"),
    )


def coverage_global(df: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    return coverage_table(df, cfg).agg(F.avg("coverage_pct").alias("coverage_global_pct"))


def station_health(df: DataFrame, cfg: PanelConfig = CFG, bins: DataFrame | None = None) -> DataFrame:
    """Coverage table with the latest non-null station name."""
    names = last_non_null(df, ["name"], ["station_id"])
    return coverage_table(df, cfg, bins).join(names, "station_id", "left").select(
        "station_id", "name", "obs", "expected", "coverage_pct", "missing"
    )


def presence_table(df: DataFrame, cfg: PanelConfig = CFG, bins: DataFrame | None = None) -> DataFrame:
    """Per station: bins expected only between its first and last sighting."""
    span = F.unix_timestamp("last_bin") - F.unix_timestamp("first_bin")
    return (
        (bins if bins is not None else station_bins(df))
        .withColumn("expected", F.floor(span / F.lit(cfg.step_s)) + 1)
        .withColumn("seen", F.least("obs", "expected"))
        .select("station_id", "obs", "expected", "seen", (F.col("seen") / F.col("expected") * HUNDRED).alias("coverage_pct"))
    )


def coverage_active(
    df: DataFrame, cfg: PanelConfig = CFG, min_frac: float | None = None, weighted: bool = False,
    bins: DataFrame | None = None,
) -> DataFrame:
    t = presence_table(df, cfg, bins)
    if min_frac is not None and 0 < min_frac <= 1:
        t = t.filter(F.col("seen") >= X.dbl(min_frac) * F.col("expected"))
    pct, w = F.col("coverage_pct"), F.col("expected").cast("double")
    value = F.try_divide(F.sum(pct * w), F.sum(w)) if weighted else F.avg(pct)
    return t.agg(value.alias("coverage_active_pct"))


def coverage_by_hour(df: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    """Mean over stations of the bins seen in a local hour on the days seen in that hour."""
    cells = (
        df.select("station_id", "tbin_utc").distinct()
        .withColumns({"hour": X.local_hour("tbin_utc", cfg.tz), "_day": X.local_day("tbin_utc", cfg.tz)})
        .groupBy("station_id", "hour", "_day")
        .agg(F.count(F.lit(1)).alias("_bins"))
        .groupBy("station_id", "hour")
        .agg(F.sum("_bins").alias("_obs"), (F.count(F.lit(1)) * max(1, cfg.bins_per_hour)).alias("_exp"))
    )
    pct = F.least("_obs", "_exp") / F.col("_exp") * HUNDRED
    return cells.groupBy("hour").agg(F.avg(pct).alias("coverage_pct"))


# ---- latency, duplicates, flat sequences --------------------------------------------


def ingest_latency(df: DataFrame, cap_min: float | None = CFG.latency_cap_min, ts: str = "tbin_utc") -> DataFrame:
    """p50/p95 of ingestion delay in minutes, negative and capped-out delays left out."""
    lat = X.minutes_between("ingested_at", ts)
    keep = (lat >= 0) if cap_min is None else lat.between(X.dbl(0), X.dbl(cap_min))
    return quantiles(df.filter(keep), [], lat, [0.5, 0.95], name="_q").select(
        F.col("_q")[0].alias("latency_p50_min"), F.col("_q")[1].alias("latency_p95_min")
    )


def duplicates(df: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """Extra rows per (station, bin), summed per station."""
    return (bins if bins is not None else station_bins(df)).select("station_id", (F.col("rows") - F.col("obs")).alias("dups"))


def duplicates_pct(df: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    return (bins if bins is not None else station_bins(df)).agg(
        (F.try_divide(F.sum(F.col("rows") - F.col("obs")), F.sum("rows")) * HUNDRED).alias("dups_pct")
    )


def _unchanged(prev: Column, cur: Column) -> Column:
    """A missing reading on either side counts as no change."""
    return F.coalesce(prev == cur, F.lit(True))


def one_per_bin(df: DataFrame) -> DataFrame:
    """The last row per station and bin, for reports that follow the order of rows."""
    return dedup_latest(df, KEYS, tuple(c for c in ("ts_utc",) if c in df.columns))


def flat_sequences(df: DataFrame, cfg: PanelConfig = CFG, min_steps: int | None = None) -> DataFrame:
    """Stretches without change. A run's first row is a change, except a station's very first."""
    r = runs(df, ["station_id"], "tbin_utc", F.col("bikes"), cfg.bin_min, cfg.block_bins, _unchanged)
    steps = F.when(F.col("leading"), F.col("n")).otherwise(F.col("n") - 1)
    start = F.when(F.col("leading"), F.col("start")).otherwise(F.col("second"))
    return (
        r.select("station_id", steps.alias("steps"), start.alias("start"), "end")
        .filter(F.col("steps") >= (min_steps or cfg.flat_steps))
        .withColumn("duration_min", F.col("steps") * cfg.bin_min)
    )


# ---- anomalies and alerts -----------------------------------------------------------


def top_anomalies(df: DataFrame, key: str, k: int = CFG.anomaly_topk, sample: float = 0.0) -> DataFrame:
    """The k worst rows of one kind; `sample` < 1 keeps every (1/sample)-th of them."""
    ties = [c for c in ("station_id", "start") if c in df.columns]
    out = top(df.filter(F.col(key) > 0), k, F.desc(key), *ties)
    if 0.0 < sample < 1.0:
        step = max(1, round(1.0 / sample))
        # At most k rows: the ranking list is bounded by the report size.
        entry = F.struct((-F.col(key)).alias("_k"), *ties, F.struct(*df.columns).alias("_r"))
        out = out.agg(F.array_sort(F.collect_list(entry)).alias("_l"))
        out = out.select(F.posexplode("_l").alias("_pos", "_e")).filter(F.col("_pos") % step == 0).select("_e._r.*")
    return out


# The figure that ranks each kind of anomaly.
SEVERITY = {"flat_sequence": "duration_min", "duplicates": "dups", "missing_bins": "missing"}


def anomalies(
    df: DataFrame, cfg: PanelConfig = CFG, bins: DataFrame | None = None, flats: DataFrame | None = None
) -> DataFrame:
    """All flat, duplicate and missing-bin anomalies in one table."""
    kinds = {
        "flat_sequence": flats if flats is not None else flat_sequences(one_per_bin(df), cfg),
        "duplicates": duplicates(df, bins),
        "missing_bins": coverage_table(df, cfg, bins).select("station_id", "missing", "expected"),
    }
    out = None
    for kind, rows in kinds.items():
        rows = rows.filter(F.col(SEVERITY[kind]) > 0).withColumn("type", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.join(last_non_null(df, ["name"], ["station_id"]), "station_id", "left").select(
        "type", "station_id", "name", "start", "end", "steps", "duration_min", "dups", "missing", "expected"
    )


def worst_anomalies(found: DataFrame, k: int = CFG.anomaly_topk, sample: float = 0.0) -> DataFrame:
    """The list view: the k worst of each kind."""
    out = None
    for kind, key in SEVERITY.items():
        rows = top_anomalies(found.filter(F.col("type") == kind), key, k, sample)
        out = rows if out is None else out.unionByName(rows)
    return out


def anomaly_counts(found: DataFrame) -> DataFrame:
    """Number of anomalies of each kind, from the whole table."""
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def panel_span(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("station_id").alias("stations"),
        F.min("tbin_utc").alias("span_start"),
        F.max("tbin_utc").alias("span_end"),
    )


def health_kpis(
    df: DataFrame, now, cfg: PanelConfig = CFG, bins: DataFrame | None = None, flats: DataFrame | None = None
) -> DataFrame:
    """All health figures in one row; everything per station comes from one scan."""
    bins = bins if bins is not None else materialize(station_bins(df), "station-bins")
    flats = flats if flats is not None else flat_sequences(one_per_bin(df), cfg)
    span = bins.agg(
        F.sum("rows").alias("rows"), F.count("station_id").alias("stations"),
        F.min("first_bin").alias("span_start"), F.max("last_bin").alias("span_end"),
    )
    cov = coverage_table(df, cfg, bins).agg(
        F.avg("coverage_pct").alias("coverage_global_pct"),
        F.count_if(F.col("missing") > 0).alias("missing_stations"),
    )
    parts = [span, panel_freshness(df, now, cfg.freshness_slo_min, bins), cov, coverage_active(df, cfg, bins=bins)]
    if "ingested_at" in df.columns:
        parts.append(ingest_latency(df, cfg.latency_cap_min))
    parts += [duplicates_pct(df, bins), flats.agg(F.count(F.lit(1)).alias("flat_sequences"))]
    return combine(*parts)


def health_alerts(kpis: DataFrame, cfg: PanelConfig = CFG) -> DataFrame:
    return kpis.select(
        "freshness_p95_ok",
        F.coalesce(F.col("coverage_global_pct") >= cfg.coverage_alert_pct, F.lit(False)).alias("coverage_ok"),
        F.coalesce(F.col("dups_pct") >= cfg.duplicate_alert_pct, F.lit(False)).alias("duplication_alert"),
        (F.col("flat_sequences") > 0).alias("flat_sequences_found"),
    )
