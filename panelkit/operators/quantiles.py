"""Exact quantiles and quantile bins that no single task has to hold.

Values are first counted (value, frequency), which collapses a hot group in every
map task. The counts are range-partitioned by group and value and written once, with
the number of their partition. Weight sums per partition tell in which partitions the
wanted ranks lie; only those are ranked inside. One way for every size and type, two
passes over the counts, whatever the values; infinities are ordinary ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelkit.functions.columns import col, dbl
from panelkit.session import materialize


def is_count(df: DataFrame, *names: str) -> bool:
    """True for integer columns, whose sums are exact in any order."""
    ints = (T.ByteType, T.ShortType, T.IntegerType)
    return all(isinstance(df.schema[n].dataType, ints) for n in names)


def counted(df: DataFrame, groups: list[str], value, weight: Column | None = None) -> DataFrame:
    """(groups, _v, _w): distinct values with their frequency; null and NaN left out."""
    v = col(value).cast("double")
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        df.select(*groups, v.alias("_v"), *([] if weight is None else [weight.alias("_wt")]))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*groups, "_v")
        .agg((F.count(F.lit(1)) if weight is None else F.sum("_wt")).alias("_w"))
    )


def quantiles(df: DataFrame, groups: list[str], value, probs: list[float], *, name: str = "q") -> DataFrame:
    """Linear-interpolation quantiles per group: (groups, `name` array, n)."""
    return quantiles_of_counts(counted(df, groups, value), groups, probs, name=name)


def quantiles_of_counts(vc: DataFrame, groups: list[str], probs: list[float], *, name: str = "q") -> DataFrame:
    """The same from value counts (see `counted`)."""
    if not groups:
        return quantiles_of_counts(vc.withColumn("_all", F.lit(0)), ["_all"], probs, name=name).drop("_all")
    # The partition number must not change between the two passes: the counts are written.
    ranged = materialize(vc.repartitionByRange(*groups, "_v").withColumn("_p", F.spark_partition_id()), "value-ranks")
    group = Window.partitionBy(*groups)
    before = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        ranged.groupBy(*groups, "_p").agg(F.sum("_w").alias("_s"))
        .withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0)))
        .withColumn("n", F.sum("_s").over(group))
    )
    at = F.transform(F.array(*[dbl(p) for p in probs]), lambda p: p * (F.col("n") - 1).cast("double"))
    ranks = F.array_distinct(F.concat(F.transform(at, lambda r: F.floor(r)), F.transform(at, lambda r: F.ceil(r))))
    wanted = (
        sums.withColumn("_want", _inside(ranks, F.col("_base"), F.col("_base") + F.col("_s")))
        .filter(F.size("_want") > 0)
        .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate((*groups, "_p"))], "_base", "_want", "n")
    )
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate((*groups, "_p"))])
    order = Window.partitionBy(*groups, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        ranged.join(wanted, same)
        .withColumn("_upto", F.col("_base") + F.sum("_w").over(order))
        .withColumn("_hit", _inside(F.col("_want"), F.col("_upto") - F.col("_w"), F.col("_upto")))
        .filter(F.size("_hit") > 0)
        .groupBy(*groups)
        .agg(
            F.map_from_entries(F.flatten(F.collect_list(
                F.transform("_hit", lambda r: F.struct(r.alias("r"), F.col("_v").alias("v")))))).alias("_map"),
            F.first("n").alias("n"),
        )
    )

    def between(r: Column) -> Column:
        lo, hi = F.element_at(F.col("_map"), F.floor(r)), F.element_at(F.col("_map"), F.ceil(r))
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (r - F.floor(r)))

    return found.select(*groups, F.transform(at, between).alias(name), "n")


def _inside(ranks: Column, lo: Column, hi: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= lo) & (r < hi))


def unique_edges(q) -> Column:
    return F.array_distinct(col(q))


def bin_right_closed(v, edges) -> Column:
    """Zero-based bin in (a, b], the lowest edge included; null outside."""
    x, e = col(v), col(edges)
    below = F.size(F.filter(e, lambda t: t < x))
    inside = (x >= F.element_at(e, 1)) & (x <= F.element_at(e, -1))
    return F.when(inside & (F.size(e) > 1), F.greatest(below - 1, F.lit(0)))


def bin_left_closed(v, edges) -> Column:
    """Zero-based bin in [a, b), the top edge included; null outside."""
    x, e = col(v), col(edges)
    upto = F.size(F.filter(e, lambda t: t <= x))
    inside = (x >= F.element_at(e, 1)) & (x <= F.element_at(e, -1))
    return F.when(inside & (F.size(e) > 1), F.least(upto - 1, F.size(e) - 2))


def equal_width_bin(v, half_width, bins: int) -> Column:
    """Zero-based bin of [-h, h] cut in equal parts, the top edge included; null outside."""
    x, h = col(v), col(half_width)
    b = F.floor((x + h) / (h * dbl(2)) * dbl(bins))
    return F.when(F.abs(x) <= h, F.least(b, F.lit(bins - 1))).cast("int")
