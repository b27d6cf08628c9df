"""Opt-in sketches: quantiles and distinct counts from mergeable states, one per day and group.

A day's state is written once; a window merges the states of its days and reads no rows. A
KLL sketch of parameter k ranks a value within about `rank_error(k)` of its true rank, with
99 % confidence; a HyperLogLog sketch of 2^b registers counts within about 1.04 / 2^(b / 2).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from panelkit.functions import columns as X

K, REGISTERS = 400, 12


def rank_error(k: int = K) -> float:
    """Normalised two-sided rank error of a KLL sketch at 99 % confidence (a published fit)."""
    return 2.446 / k ** 0.9433


def distinct_error(b: int = REGISTERS) -> float:
    """Relative standard error of the distinct count."""
    return 1.04 / 2 ** (b / 2)


def day_sketches(
    df: DataFrame, groups: list[str], value: str, distinct: str, *, ts: str = "tbin_utc", tz: str = "UTC", k: int = K, b: int = REGISTERS
) -> DataFrame:
    """Per group and local day: (groups, day, n, kll, hll); nulls and NaN are left out of the quantiles."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    return df.groupBy(*groups, X.local_day(ts, tz).alias("day")).agg(
        F.count(v).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("kll"), F.hll_sketch_agg(F.col(distinct), F.lit(b)).alias("hll"))


def window_figures(days: DataFrame, groups: list[str], first: date, last: date, probs: list[float]) -> DataFrame:
    """(groups, n, q, distinct) of the days from `first` to `last`, from their states."""
    merged = days.filter(F.col("day").between(F.lit(first), F.lit(last))).groupBy(*groups).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("kll").alias("_kll"), F.hll_union_agg("hll").alias("_hll"))
    at = F.array(*[F.kll_sketch_get_quantile_double("_kll", F.lit(float(p))) for p in probs])
    return merged.select(*groups, "n", F.when(F.col("n") > 0, at).alias("q"), F.hll_sketch_estimate("_hll").alias("distinct"))
