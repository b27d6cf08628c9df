"""A fitted tree ensemble as a table of nodes, and importances counted from it in Spark."""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelkit.session import work_path


def node_table(spark: SparkSession, model: MLWritable, features: tuple[str, ...]) -> DataFrame:
    """(tree, node, feature, threshold, gain, n, left, right) of a tree or an ensemble; leaves have no feature.

    The model's own stored form is read as a table, so nothing is walked on the driver.
    `n` counts the training rows that reached the node, `gain` is the split's fall of
    impurity per row.
    """
    path = work_path(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    single = "nodeData" not in data.columns
    tree = F.lit(0).alias("tree") if single else F.col("treeID").alias("tree")
    at = (lambda c: F.col(c)) if single else (lambda c: F.col(f"nodeData.{c}"))
    inner = at("leftChild") >= 0
    names = F.array(*[F.lit(f) for f in features])
    return data.select(
        tree, at("id").alias("node"),
        F.when(inner, F.get(names, at("split.featureIndex"))).alias("feature"),
        F.when(inner, F.get(at("split.leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"),
        F.when(inner, at("gain")).alias("gain"), at("rawCount").cast("long").alias("n"),
        at("leftChild").alias("left"), at("rightChild").alias("right"),
    )


def split_importances(nodes: DataFrame) -> DataFrame:
    """Per feature that splits: weight (splits), gain and cover (means over its splits), and shares of gain and cover.

    The gain of a split is its whole fall of squared error: per row, times its rows.
    """
    per = nodes.filter("feature IS NOT NULL").groupBy("feature").agg(
        F.count(F.lit(1)).alias("weight"), F.avg(F.col("gain") * F.col("n")).alias("gain"), F.avg("n").alias("cover"))
    total = per.agg(F.sum("gain").alias("_gain"), F.sum("cover").alias("_cover"))
    return per.crossJoin(F.broadcast(total)).select(
        "feature", "weight", "gain", "cover", F.try_divide("gain", "_gain").alias("gain_share"), F.try_divide("cover", "_cover").alias("cover_share"))
