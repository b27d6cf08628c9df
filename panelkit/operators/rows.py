"""Small helpers for report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelkit.session import materialize


def combine(*frames: DataFrame) -> DataFrame:
    """One row from several one-row frames, each a scalar subquery."""
    spark = frames[0].sparkSession
    parts = {
        f"_{i}": f.select(F.struct(*[F.col(f"`{c}`") for c in f.columns]).alias("s")).scalar()
        for i, f in enumerate(frames)
    }
    return spark.range(1).select(*[p.alias(n) for n, p in parts.items()]).select(*[f"{n}.*" for n in parts])


SMALL_ROWS = 200_000


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `max_rows` rows, else as it is.

    For tables that are cheap to count (written tables, dimensions). Beyond the
    limit the join is left to the optimizer: a shuffle join with skew handling.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """Top-k by the given order; Spark keeps k rows per task, then merges."""
    return df.orderBy(*order).limit(k)


def running_sum(df: DataFrame, value: str, name: str, order: list) -> DataFrame:
    """`df` with the running sum of `value` in a total order, in two levels: no task holds all rows.

    Rows are range-partitioned and written with their partition's number; partition
    totals are summed up (one row per partition), rows only within their partition.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "running-sum")
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_p").agg(F.sum(value).alias("_s")).select(
        "_p", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(starts, "_p").withColumn(name, F.col("_base") + F.sum(value).over(inside)).drop("_p", "_base")


def hours(spark) -> DataFrame:
    """The 24 hours of a day."""
    return spark.range(24).select(F.col("id").cast("int").alias("hour"))


def day_bins(spark, bin_min: int) -> DataFrame:
    """The HH:mm labels of one day's grid."""
    return spark.range(24 * 60 // bin_min).select(
        F.format_string("%02d:%02d", F.floor(F.col("id") * bin_min / 60), (F.col("id") * bin_min) % 60).alias("hhmm")
    )


def week_hours(spark) -> DataFrame:
    """The 7 x 24 cells of a week."""
    return spark.range(168).select(
        F.floor(F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour")
    )
