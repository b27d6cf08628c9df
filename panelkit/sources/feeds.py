"""Readers for the JSON feeds a collector drops into a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelkit.functions import columns as X
from panelkit.operators.clean import as_ts

# The feed documents' fields.
STATUS_DOC = (
    "data struct<stations:array<struct<station_id:string,stationCode:string,num_bikes_available:int,"
    "num_bikes_available_types:string,num_docks_available:int,status:string,is_renting:int,is_returning:int,"
    "last_reported:bigint>>>"
)
INFO_DOC = "data struct<stations:array<struct<station_id:string,name:string,lat:double,lon:double,capacity:int>>>"
WEATHER_DOC = (
    "hourly struct<time:array<string>,temperature_2m:array<double>,precipitation:array<double>,wind_speed_10m:array<double>>"
)


def bike_types(types: Column, key: str) -> Column:
    """Count of one bike type from a list of one-key objects or a plain object; 0 when absent.

    The feeds use both shapes, so the column is the JSON text of the field.
    """
    is_list = F.ltrim(types).startswith("[")
    entries = F.when(is_list, F.from_json(types, "array<map<string,int>>")).otherwise(
        F.array(F.from_json(types, "map<string,int>"))
    )
    # Later entries win, as when one-key objects are merged.
    value = F.aggregate(entries, F.lit(None).cast("int"), lambda acc, m: F.coalesce(F.try_element_at(m, F.lit(key)), acc))
    return F.coalesce(value, F.lit(0))


def _stations(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    doc = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    rows = doc.select(F.explode("data.stations").alias("s")).select("s.*")
    return rows.withColumn("station_id", F.trim("station_id")).filter("station_id != ''")


def read_gbfs(
    spark: SparkSession, status_path: str, info_path: str, observed_at, bin_min: int = 5, multi_line: bool = True
) -> DataFrame:
    """One panel row per station from a status and an information document.

    `ts_utc` is the observation time; the station's own report time stays in
    `src_ts_utc`.
    """
    status = _stations(spark, status_path, STATUS_DOC, multi_line)
    info = _stations(spark, info_path, INFO_DOC, multi_line)
    seen = as_ts(observed_at)
    return status.join(info, "station_id").select(
        seen.alias("ts_utc"),
        X.floor_bin(seen, bin_min).alias("tbin_utc"),
        "station_id",
        F.col("num_bikes_available").alias("bikes"),
        "capacity",
        bike_types(F.col("num_bikes_available_types"), "mechanical").alias("mechanical"),
        bike_types(F.col("num_bikes_available_types"), "ebike").alias("ebike"),
        X.station_status().alias("status"),
        "lat", "lon", "name",
        F.timestamp_seconds("last_reported").alias("src_ts_utc"),
    )


def read_weather(
    spark: SparkSession, path: str, lo=None, hi=None, margin_hours: int = 3, multi_line: bool = True
) -> DataFrame:
    """(hour_utc, temp_C, precip_mm, wind_mps) near the data's hours."""
    doc = spark.read.schema(WEATHER_DOC).option("multiLine", multi_line).json(path)
    rows = doc.select(
        F.explode(
            F.arrays_zip(
                F.col("hourly.time").alias("t"), F.col("hourly.temperature_2m").alias("a"),
                F.col("hourly.precipitation").alias("b"), F.col("hourly.wind_speed_10m").alias("c"),
            )
        ).alias("z")
    ).select(
        F.date_trunc("hour", F.try_to_timestamp("z.t")).alias("hour_utc"),
        F.col("z.a").alias("temp_C"), F.col("z.b").alias("precip_mm"), F.col("z.c").alias("wind_mps"),
    ).filter("hour_utc is not null")
    around = F.expr(f"interval {margin_hours} hours")
    if lo is not None:
        rows = rows.filter(F.col("hour_utc") >= F.date_trunc("hour", as_ts(lo)) - around)
    if hi is not None:
        rows = rows.filter(F.col("hour_utc") <= F.date_trunc("hour", as_ts(hi)) + around)
    return rows


def read_records(spark: SparkSession, path: str, schema: str, whole_document: bool = True) -> DataFrame:
    """Records from a JSON list, a single object (both whole documents) or one object per line.

    Values that do not fit the schema become null.
    """
    return spark.read.schema(schema).option("multiLine", whole_document).option("mode", "PERMISSIVE").json(path)


def read_forecast_bundle(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of a bundle document, under `data` or `predictions`, with its stamp."""
    doc = spark.read.schema(
        f"generated_at string, horizon_min int, data array<struct<{record}>>, predictions array<struct<{record}>>"
    ).option("multiLine", True).json(path)
    return doc.select("generated_at", F.explode(F.coalesce("data", "predictions")).alias("r")).select(
        "generated_at", "r.*"
    )
