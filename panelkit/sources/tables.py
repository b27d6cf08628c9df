"""Panel tables: scans, partitioned writes, compaction, documents.

Bronze is partitioned by (date, hour), dailies by date, monthlies by month, so
every time window below is a partition filter.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelkit.config import PanelConfig
from panelkit.operators.clean import KEYS, assert_single_day, clean_panel, repair_grid, window_filter
from panelkit.schema import PANEL_SCHEMA, enforce_schema, null_floats

PART_DATE = T.StructField("date", T.DateType())
PART_HOUR = T.StructField("hour", T.IntegerType())


def with_partitions(df: DataFrame, hour: bool = False) -> DataFrame:
    out = df.withColumn("date", F.to_date("tbin_utc"))
    return out.withColumn("hour", F.hour("tbin_utc")) if hour else out


def write_bronze(df: DataFrame, path: str, bin_min: int = PanelConfig().bin_min) -> None:
    """Append snapshots below date=/hour= of the repaired bin; an hour with much data is split over several tasks."""
    (
        with_partitions(repair_grid(df, bin_min), hour=True)
        .hint("rebalance", "date", "hour")
        .sortWithinPartitions("date", "hour", *KEYS[::-1])
        .write.mode("append")
        .partitionBy("date", "hour")
        .parquet(path)
    )


def read_panel(
    spark: SparkSession, path: str, start=None, end=None, *, bounds: str = "[)",
    schema: T.StructType = PANEL_SCHEMA, partitions: tuple[str, ...] = (), skip_unreadable: bool = False,
) -> DataFrame:
    """Panel rows in [start, end); absent columns are null.

    `partitions` names the table's partition columns ("date", "hour"): the
    window then prunes folders before any file is opened. An unreadable file
    fails the read unless `skip_unreadable`; `files_without_rows` lists such files.
    """
    extra = [f for f in (PART_DATE, PART_HOUR) if f.name in partitions]
    df = (
        spark.read.schema(T.StructType([*schema.fields, *extra]))
        .option("ignoreCorruptFiles", skip_unreadable)
        .option("recursiveFileLookup", not extra)
        .parquet(path)
    )
    df = prune(df, start, end, partitions)
    return window_filter(df, "tbin_utc", start, end, bounds).select(*schema.fieldNames())


def files_without_rows(spark: SparkSession, path: str, schema: T.StructType = PANEL_SCHEMA) -> DataFrame:
    """(path) of the files below `path` that give no row: unreadable or empty ones."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    some = (
        spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path)
        .select(F.col("_metadata.file_path").alias("path")).distinct()
    )
    name = lambda c: F.regexp_replace(c, "^file:/+", "/").alias("path")
    return every.select(name("path")).join(some.select(name("path")), "path", "left_anti")


def prune(df: DataFrame, start, end, partitions: tuple[str, ...]) -> DataFrame:
    """Partition filters that cover a time window given as Python datetimes."""
    if "date" in partitions:
        if start is not None:
            df = df.filter(F.col("date") >= F.lit(_as_date(start)))
        if end is not None:
            df = df.filter(F.col("date") <= F.lit(_as_date(end)))
        if "hour" in partitions and start is not None and end is not None:
            first = (F.col("date") > F.lit(_as_date(start))) | (F.col("hour") >= start.hour)
            last = (F.col("date") < F.lit(_as_date(end))) | (F.col("hour") <= end.hour)
            df = df.filter(first & last)
    return df


def _as_date(x) -> date:
    return x.date() if isinstance(x, datetime) else x


def serving_window(now: datetime, cfg: PanelConfig = PanelConfig(), hours: int = 4, bins: int = 49):
    """[start, end] of the recent history serving needs."""
    end = now - timedelta(seconds=now.timestamp() % cfg.step_s)
    return end - timedelta(minutes=max(hours * 60, bins * cfg.bin_min)), end


def read_days(spark: SparkSession, path: str, first: date, last: date) -> DataFrame:
    """Days first..last of a table partitioned by date."""
    return spark.read.parquet(path).filter(F.col("date").between(F.lit(first), F.lit(last)))


def latest_day(df: DataFrame) -> DataFrame:
    """Rows of the newest `date` partition."""
    return df.filter(F.col("date") == df.agg(F.max("date")).scalar())


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("station_id string, cluster int").option("header", True).csv(path).distinct()


# ---- compaction ---------------------------------------------------------------------


def _write_partition(df: DataFrame, path: str, part: str) -> None:
    """Replace the partitions present in `df`, in time order, split by size not by station."""
    (
        df.repartitionByRange(part, *KEYS[::-1])
        .sortWithinPartitions(part, *KEYS[::-1])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(part)
        .parquet(path)
    )


def compact_daily(bronze: DataFrame, day: date, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """The clean rows of one UTC day; rows whose bin was null when they were stored are repaired first."""
    start = datetime(day.year, day.month, day.day)
    src = bronze.filter((F.col("date") == F.lit(day)) | F.col("date").isNull()) if "date" in bronze.columns else bronze
    return window_filter(clean_panel(src, cfg), "tbin_utc", start, start + timedelta(days=1), "[)")


def write_daily(df: DataFrame, path: str, *, single_day: bool = False) -> None:
    """Write day partitions; with `single_day` a batch that spans more than one day fails before it replaces any."""
    _write_partition(with_partitions(assert_single_day(df) if single_day else df), path, "date")


def month_bounds(month: date) -> tuple[datetime, datetime]:
    start = datetime(month.year, month.month, 1)
    return start, datetime(start.year + start.month // 12, start.month % 12 + 1, 1)


def compact_monthly(daily: DataFrame, month: date, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """The clean rows of one UTC month; grid repair is row-wise, as for days."""
    start, end = month_bounds(month)
    src = daily
    if "date" in daily.columns:
        inside = F.col("date").between(F.lit(start.date()), F.lit((end - timedelta(days=1)).date()))
        src = daily.filter(inside | F.col("date").isNull())
    return window_filter(clean_panel(src, cfg), "tbin_utc", start, end, "[)")


def write_monthly(df: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Write month partitions; a dry run only reports what would be written."""
    out = df.withColumn("month", F.date_format("tbin_utc", "yyyy-MM"))
    if not dry_run:
        _write_partition(out, path, "month")
    return out.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("station_id").alias("stations"))


def expired_partitions(parts: DataFrame, today: date, by: str = "date") -> DataFrame:
    """Source partitions whose period is closed: day before today, or month before this one."""
    limit = today if by == "date" else today.replace(day=1)
    return parts.filter(F.to_date(by) < F.lit(limit))


def training_base(daily: DataFrame) -> DataFrame:
    """All rows in the 14 panel columns, typed."""
    return enforce_schema(daily)


def write_training_base(daily: DataFrame, path: str) -> None:
    training_base(daily).repartitionByRange(*KEYS[::-1]).sortWithinPartitions(*KEYS[::-1]).write.mode(
        "overwrite"
    ).parquet(path)


# ---- documents ------------------------------------------------------------------------


def write_document(df: DataFrame, path: str, name: str, stamp: datetime | None = None) -> None:
    """A report table as JSON under <name>/latest and, with a stamp, a dated copy; NaN becomes null."""
    rows = null_floats(df)
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}/latest")
    if stamp is not None:
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(
            f"{path}/{name}/{stamp:%Y-%m-%dT%H-%M-%SZ}"
        )


def manifest(
    spark: SparkSession, outputs: dict[str, DataFrame], generated_at: datetime, window=None,
    params: dict[str, float] | None = None,
) -> DataFrame:
    """One row: the tables written with their counts, the window and the thresholds."""
    counts = None
    for name, df in outputs.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        counts = row if counts is None else counts.unionByName(row)
    lo, hi = window or (None, None)
    files = counts.agg(F.array_sort(F.collect_list(F.struct("name", "rows"))).alias("files"))
    knobs = [x for k, v in (params or {}).items() for x in (F.lit(k), F.lit(float(v)))]
    return files.select(
        F.lit(f"{generated_at:%Y-%m-%dT%H:%M:%SZ}").alias("generated_at"),
        F.lit(None if lo is None else f"{lo:%Y-%m-%dT%H:%M:%SZ}").cast("string").alias("start_utc"),
        F.lit(None if hi is None else f"{hi:%Y-%m-%dT%H:%M:%SZ}").cast("string").alias("end_utc"),
        (F.create_map(*knobs) if knobs else F.lit(None).cast("map<string,double>")).alias("params"),
        "files",
    )
