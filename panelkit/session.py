"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings every plan in this library relies on.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot station's join partition even where that costs a later shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "panelkit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: the cluster's `spark.checkpoint.dir`.

    A temporary folder stands in for it in local mode only; on a cluster each
    machine would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir isn't set: {master} needs a folder that all executors share")
        root = tempfile.mkdtemp(prefix="panelkit-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{_app_root(spark)}/{name}-{uuid.uuid4().hex}"


def _app_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/panelkit-{spark.sparkContext.applicationId}"


def materialize(df, name: str, by: str | None = None, **options):
    """Write `df` once to the shared folder and read it back; `by` names a column with a folder for each value.

    Used where several actions reuse one frame: it cuts the lineage, and unlike
    a cached block the files survive the loss of an executor.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("errorifexists").options(**options).parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def release_work(spark: SparkSession) -> None:
    """Delete the intermediate tables; only when no frame built on them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_app_root(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path, True)
