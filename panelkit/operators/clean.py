"""Cleaning: grid repair, last-writer dedup, windows, enrichment."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.config import PanelConfig
from panelkit.functions import columns as X
from panelkit.operators.rows import small_side
from panelkit.schema import PANEL_SCHEMA, enforce_schema

KEYS = ["station_id", "tbin_utc"]


def repair_grid(df: DataFrame, bin_min: int = 5, ts: str = "ts_utc", tbin: str = "tbin_utc") -> DataFrame:
    """A null bin is floored from `ts`, an off-grid bin from itself; on-grid rows stay."""
    source = F.coalesce(F.col(tbin), F.col(ts)) if tbin in df.columns else F.col(ts)
    return df.withColumn(tbin, X.floor_bin(source, bin_min))


def dedup_latest(
    df: DataFrame, keys: list[str] = KEYS, order: tuple[str, ...] = ("ts_utc",), unique: bool = False
) -> DataFrame:
    """The last row per key.

    A rank limit of one: Spark prunes to one row per key in every map task, so a
    key with a third of all rows sends one row per task. Ties go to the largest
    row, so a retried task picks the same one; `unique` says that `order` leaves
    no ties, which lets Spark read only the columns used later.
    """
    rest = [] if unique else [c for c in df.columns if c not in keys and c not in order]
    latest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in (*order, *rest)])
    return (
        df.filter(" and ".join(f"`{k}` is not null" for k in keys))
        .withColumn("_rn", F.row_number().over(latest))
        .filter(F.col("_rn") == 1)
        .drop("_rn")
    )


def last_non_null(df: DataFrame, cols: list[str], keys: list[str], ts: str = "tbin_utc") -> DataFrame:
    """Latest non-null value of each column per key."""
    return df.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in cols]
    )


def as_ts(x) -> Column:
    """A timestamp expression; naive Python times mean UTC."""
    if isinstance(x, Column):
        return x
    return F.lit(x if isinstance(x, str) else f"{x:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp")


def window_filter(df: DataFrame, ts: str, start=None, end=None, bounds: str = "[]") -> DataFrame:
    """Keep start..end with the given bounds, e.g. "[)" or "(]"; None leaves a side open."""
    cond = F.lit(True)
    if start is not None:
        s = as_ts(start)
        cond = cond & (F.col(ts) >= s if bounds[0] == "[" else F.col(ts) > s)
    if end is not None:
        e = as_ts(end)
        cond = cond & (F.col(ts) <= e if bounds[1] == "]" else F.col(ts) < e)
    return df.filter(cond)


def last_ts(df: DataFrame, ts: str = "tbin_utc") -> Column:
    """Latest timestamp as a scalar subquery."""
    return df.select(ts).agg(F.max(ts)).scalar()


def last_days(df: DataFrame, days: int, tz: str | None = None, ts: str = "tbin_utc") -> DataFrame:
    """Rows of the last `days` days before the latest timestamp, in local time, closed."""
    loc = X.local_ts(ts, tz)
    floor = df.agg(F.max(loc)).scalar() - F.expr(f"interval {int(days)} days")
    return df.filter(loc >= floor)


def health_window(df: DataFrame, now: datetime, days: int, bin_min: int, ts: str = "tbin_utc") -> DataFrame:
    """(end - days, end] with end = the last bin of yesterday, UTC."""
    start, end = health_bounds(now, days, bin_min)
    return window_filter(df, ts, start, end, "(]")


def health_bounds(now: datetime, days: int, bin_min: int) -> tuple[datetime, datetime]:
    end = datetime(now.year, now.month, now.day) - timedelta(minutes=bin_min)
    return end - timedelta(days=days), end


def local_days_window(
    df: DataFrame, now: datetime, days: int, bin_min: int, tz: str, ts: str = "tbin_utc"
) -> DataFrame:
    """The same window in local time: N local days ending with yesterday's last bin."""
    end = F.date_trunc("day", F.from_utc_timestamp(as_ts(now), tz)) - F.expr(f"interval {bin_min} minutes")
    loc = X.local_ts(ts, tz)
    return df.filter((loc <= end) & (loc > end - F.expr(f"interval {int(days)} days")))


def today_window(df: DataFrame, tz: str | None, ts: str = "tbin_utc") -> DataFrame:
    """Rows of the local day of the latest timestamp."""
    day = X.local_day(ts, tz)
    return df.filter(day == df.agg(F.max(day)).scalar())


def assert_single_day(df: DataFrame, ts: str = "tbin_utc") -> DataFrame:
    """The same rows; the plan fails when they span more than one UTC day."""
    days = df.agg(F.count_distinct(F.to_date(ts))).scalar()
    guard = F.when(days > 1, F.raise_error(F.lit("more than one UTC day in a daily batch"))).otherwise(F.lit(True))
    return df.filter(F.coalesce(guard.cast("boolean"), F.lit(True)))


def best_day(df: DataFrame, anchor: date, day: str = "date") -> DataFrame:
    """One row `day`: the latest day up to the anchor, else the first after it, else null."""
    d, a = F.to_date(day), F.lit(anchor)
    return df.agg(
        F.coalesce(F.max(F.when(d <= a, d)), F.min(F.when(d > a, d))).alias("day")
    )


def status_mapping(df: DataFrame) -> DataFrame:
    """(status, status_code): alphabetical codes; write it once and reuse it."""
    return (
        df.select("status").filter("status is not null").distinct()
        .withColumn("status_code", (F.row_number().over(Window.orderBy("status")) - 1).cast("long"))
    )


def status_code(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Codes looked up in a stored mapping; a status that it lacks has none.

    A mapping of checked size is broadcast, so the status that holds most rows
    stays spread; beyond that the join is adaptive execution's to split.
    """
    codes = small_side(mapping.select(F.col("status").alias("_status"), F.col("status_code").cast("long").alias("status_code")))
    return df.join(codes, F.col("status") == F.col("_status"), "left").drop("_status")


def stock_flags(df: DataFrame, penury: float = 2, saturation: float = 2) -> DataFrame:
    """Byte flags on raw counts; null counts give 0."""
    return df.withColumns(
        {
            "is_penury": X.flag(F.col("bikes") <= penury),
            "is_saturation": X.flag((F.col("capacity") - F.col("bikes")) <= saturation),
        }
    )


def prev_day_tail(df: DataFrame, day: date, minutes: int = 240, ts: str = "tbin_utc") -> DataFrame:
    """The day plus the last `minutes` of the day before."""
    start = datetime(day.year, day.month, day.day)
    return window_filter(df, ts, start - timedelta(minutes=minutes), start + timedelta(days=1), "[)")


def day_only(df: DataFrame, day: date, ts: str = "tbin_utc") -> DataFrame:
    start = datetime(day.year, day.month, day.day)
    return window_filter(df, ts, start, start + timedelta(days=1), "[)")


def clean_panel(df: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Schema, grid and dedup: the contract every other operator relies on."""
    return dedup_latest(repair_grid(enforce_schema(df), cfg.bin_min))


def enrich_events(df: DataFrame, mapping: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Occupancy, flags, status code by the stored mapping, and clock columns on a clean panel."""
    out = stock_flags(status_code(df, mapping), cfg.penury_threshold, cfg.saturation_threshold)
    return out.withColumns(
        {
            "occ_ratio": X.occ_ratio(),
            "h": F.hour("tbin_utc").cast("byte"),
            "min": F.minute("tbin_utc").cast("byte"),
        }
    ).select(
        "tbin_utc", "station_id", "bikes", "capacity", "mechanical", "ebike", "status", "lat", "lon", "name",
        "temp_C", "precip_mm", "wind_mps", "status_code", "occ_ratio", "is_penury", "is_saturation", "h", "min",
    )


def panel_columns() -> list[str]:
    return PANEL_SCHEMA.fieldNames()
