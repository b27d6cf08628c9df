"""Panel schema, tolerant coercion and column aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Column names and order of the station panel.
PANEL_SCHEMA = T.StructType(
    [
        T.StructField("ts_utc", T.TimestampType()),
        T.StructField("tbin_utc", T.TimestampType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("bikes", T.IntegerType()),
        T.StructField("capacity", T.IntegerType()),
        T.StructField("mechanical", T.IntegerType()),
        T.StructField("ebike", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("name", T.StringType()),
        T.StructField("temp_C", T.DoubleType()),
        T.StructField("precip_mm", T.DoubleType()),
        T.StructField("wind_mps", T.DoubleType()),
    ]
)

PERF_SCHEMA = T.StructType(
    [
        T.StructField("tbin_utc", T.TimestampType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("horizon_bins", T.IntegerType()),
        T.StructField("y_true", T.IntegerType()),
        T.StructField("y_baseline_persist", T.IntegerType()),
        T.StructField("y_pred_int", T.IntegerType()),
        T.StructField("bikes", T.IntegerType()),
        T.StructField("capacity", T.IntegerType()),
        T.StructField("occ_ratio", T.DoubleType()),
        T.StructField("h", T.ByteType()),
        T.StructField("min", T.ByteType()),
    ]
)

# Accepted source names per logical column, first match wins.
ALIASES = {
    "tbin_utc": ("tbin_utc", "ts", "ts_utc", "timestamp", "datetime"),
    "station_id": ("station_id", "stationcode", "id", "station"),
    "bikes": ("bikes", "nb_velos_bin", "num_bikes_available", "velos", "velos_disponibles"),
    "docks": ("docks", "docks_avail", "nb_docks_bin", "num_docks_available", "free_docks", "places_disponibles"),
    "capacity": ("capacity", "num_docks_total", "dock_count", "cap", "capacity_src", "capacity_est"),
    "ingested_at": ("ingested_at", "ingest_ts", "ingest_time", "received_at", "etl_ts", "load_ts", "created_at"),
    "name": ("name", "station_name", "nom", "stationnom"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "lng", "longitude"),
    "is_penury": ("is_penury", "penury", "pen"),
    "is_saturation": ("is_saturation", "saturation", "sat"),
    "y_true": ("y_true", "y", "target", "bikes_true", "nb_velos_bin"),
    "y_pred_int": ("y_pred_int", "bikes_pred_int"),
    "y_pred": ("y_pred", "yhat", "prediction", "pred", "bikes_pred"),
    "y_baseline_persist": ("y_baseline_persist", "y_pred_baseline", "baseline", "persist", "y_baseline"),
    "yhat_lo": ("yhat_lo", "y_pred_lo", "y_pred_lower", "pred_lo", "pi_lo", "lo", "lower"),
    "yhat_hi": ("yhat_hi", "y_pred_hi", "y_pred_upper", "pred_hi", "pi_hi", "hi", "upper"),
    "yhat_std": ("yhat_std", "pred_std", "sigma", "std_pred"),
    "horizon_bins": ("horizon_bins", "hbin", "h_bins"),
    "horizon_min": ("horizon_min", "hmin", "h_min", "horizonmin"),
}


def coerce(col_name: str, source: T.DataType, target: T.DataType):
    """`col_name` as `target`; values that do not parse become null."""
    c = F.col(col_name)
    if isinstance(target, T.IntegerType) and isinstance(source, (T.StringType, T.DoubleType, T.FloatType)):
        c = F.rint(c.try_cast("double"))
    elif isinstance(target, T.TimestampType) and isinstance(source, (T.LongType, T.IntegerType)):
        c = F.timestamp_seconds(c)
    elif isinstance(target, T.StringType) and isinstance(source, T.StringType):
        return c
    c = c.try_cast(target)
    if isinstance(target, T.DoubleType):
        c = F.when(~F.isnan(c), c)
    return c


def enforce_schema(df: DataFrame, schema: T.StructType = PANEL_SCHEMA, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the columns of `schema` (plus `keep`), typed, in order; absent ones are null."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in schema.fields:
        if f.name in types:
            out.append(coerce(f.name, types[f.name], f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out, *[c for c in keep if c in types])


def resolve_columns(
    df: DataFrame,
    required: tuple[str, ...] = ("tbin_utc", "station_id"),
    aliases: dict[str, tuple[str, ...]] = ALIASES,
    case_sensitive: bool = False,
) -> DataFrame:
    """Rename known aliases to the logical names; fail when a required one is missing."""
    fold = (lambda s: s) if case_sensitive else str.lower
    present = {}
    for c in df.columns:
        present.setdefault(fold(c), c)
    renames = {}
    for logical, names in aliases.items():
        hit = next((present[fold(n)] for n in names if fold(n) in present), None)
        if hit is None:
            if logical in required:
                raise ValueError(f"no column for {logical!r}; tried {', '.join(names)}")
        elif hit != logical and hit not in renames:
            renames[hit] = logical
    return df.withColumnsRenamed(renames)


def ensure_columns(df: DataFrame, cols: list[str], fill: float | None = None) -> DataFrame:
    """Require `cols`; absent ones raise unless the caller names a fill value."""
    missing = [c for c in cols if c not in df.columns]
    if missing and fill is None:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: F.lit(float(fill)) for c in missing}) if missing else df


def null_floats(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, so aggregates and JSON treat them as absent."""
    fixes = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            fixes[f.name] = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return df.withColumns(fixes) if fixes else df
