"""Daily compaction as a stream: late rows rewrite the days that they belong to.

No watermark drops anything here. A batch reads the present version of the days it
touches, takes its rows in, and writes those days as a version of its own:

    path/batch=N/date=D/...

A version counts once its `_SUCCESS` is there; a day is read from its newest version. A
batch that is repeated reads versions before its own and overwrites itself, so it gives
the same table. Versions that two newer ones of a day have replaced are deleted.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from panelkit.config import PanelConfig
from panelkit.operators.clean import KEYS, dedup_latest, repair_grid
from panelkit.session import materialize
from panelkit.streaming.streams import run_to_end

CFG = PanelConfig()


def _folders(spark: SparkSession, path: str) -> dict[str, list[tuple[int, str]]]:
    """Per day its complete versions (batch, folder), oldest first."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = {f.getPath().getParent().getName() for f in fs.globStatus(jvm.Path(f"{path}/batch=*/_SUCCESS")) or []}
    out = defaultdict(list)
    for f in fs.globStatus(jvm.Path(f"{path}/batch=*/date=*")) or []:
        batch, day = f.getPath().getParent().getName(), f.getPath().getName()
        if batch in done:
            out[day.split("=")[1]].append((int(batch.split("=")[1]), f"{path}/{batch}/{day}"))
    return {day: sorted(versions) for day, versions in out.items()}


def read_days(spark: SparkSession, path: str, schema, days: set[str] | None = None, before: int | None = None) -> DataFrame:
    """The newest version of every day (or of `days`), of batches below `before` where given."""
    folders = []
    for day, versions in _folders(spark, path).items():
        fit = [f for n, f in versions if before is None or n < before]
        if fit and (days is None or day in days):
            folders.append(fit[-1])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def start_daily(df: DataFrame, path: str, checkpoint: str, cfg: PanelConfig = CFG, order: tuple[str, ...] = ("ts_utc",)) -> StreamingQuery:
    """Compact a stream of raw rows, in any order of time, into days below `path`: the last row per station and bin."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = materialize(repair_grid(batch, cfg.bin_min).withColumn("date", F.to_date("tbin_utc")), "late-rows")
        days = {str(r["date"]) for r in rows.select("date").distinct().collect()}  # a batch touches few days
        if not days:
            return
        schema = rows.drop("date").schema
        old = read_days(spark, path, schema, days, before=number).withColumn("date", F.to_date("tbin_utc"))
        merged = dedup_latest(rows.unionByName(old), KEYS, order)
        merged.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date").parquet(f"{path}/batch={number}")
        jvm = spark._jvm.org.apache.hadoop.fs
        fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for day, versions in _folders(spark, path).items():
            for _, folder in versions[:-2] if day in days else []:
                fs.delete(jvm.Path(folder), True)

    return run_to_end(df.writeStream.foreachBatch(write), checkpoint)
