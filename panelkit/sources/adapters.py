"""Panels built from the star-schema test tables.

`events` becomes a sparse station panel on a 6-hour grid, `lineitem` dense and
gappy daily panels, `events` by hour a weather table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelkit.config import PanelConfig
from panelkit.functions import columns as X
from panelkit.operators.clean import dedup_latest

EVENTS_CFG = PanelConfig(bin_min=360, block_bins=64, min_bins_keep=20)
DAILY_CFG = PanelConfig(bin_min=1440, block_bins=365)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: repeats of a (station, bin) included."""
    return snapshots_from(table(spark, sf_dir, "events"))


def snapshots_from(e: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    bikes = (F.floor("value") % 31).cast("int")
    u = F.col("user_id")
    return e.select(
        "event_id",
        ts.alias("ts_utc"),
        X.floor_bin(ts, EVENTS_CFG.bin_min).alias("tbin_utc"),
        u.cast("string").alias("station_id"),
        bikes.alias("bikes"),
        (20 + u % 11).cast("int").alias("capacity"),
        F.floor(bikes / 2).cast("int").alias("mechanical"),
        (bikes - F.floor(bikes / 2)).cast("int").alias("ebike"),
        F.col("event_type").alias("status"),
        (48.80 + (u % 13) * 0.008).alias("lat"),
        (2.25 + ((u * 7) % 17) * 0.01).alias("lon"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("Station "), u.cast("string"))).alias("name"),
        (ts + F.make_dt_interval(mins=(F.col("event_id") % 7).cast("int"))).alias("ingested_at"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly table (hour_utc, temp_C, precip_mm, wind_mps) from the events of each hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour_utc")).agg(
        F.avg("value").alias("temp_C"), F.max("value").alias("precip_mm"), F.min("value").alias("wind_mps")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deduplicated 6-hour station panel."""
    return dedup_latest(raw_snapshots(spark, sf_dir), ["station_id", "tbin_utc"], ("ts_utc", "event_id"), unique=True)


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense daily panel: six stations (return flag x line status), measure = shipped quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("station_id"),
        F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("tbin_utc"),
    ).agg(F.sum("l_quantity").cast("int").alias("bikes"), F.count(F.lit(1)).cast("int").alias("capacity"))


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide, gappy daily panel: one station per supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").cast("string").alias("station_id"),
        F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("tbin_utc"),
    ).agg(F.sum("l_quantity").cast("int").alias("bikes"), F.count(F.lit(1)).cast("int").alias("capacity"))
