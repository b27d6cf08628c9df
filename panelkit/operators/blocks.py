"""Ordered work on long stations: cut by time, stitched exactly.

A window over a whole station runs in one task. Here the rows of a station are
cut into blocks of `block_bins` grid bins and windows run per (station, block):

* `with_halo` also hands every block the rows just outside it, so lags, leads
  and rolling windows see the same rows as over the whole station;
* `runs` finds maximal runs per block and then joins the runs that touch a
  block edge; only those (at most two per block) meet per station;
* `positions` numbers rows from per-block counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.functions.columns import epoch_s

BLK, HALO = "_blk", "_halo"


def block_of(ts: str, bin_min: int, block_bins: int, shift_bins: int = 0) -> Column:
    return F.floor((epoch_s(ts) + F.lit(shift_bins * bin_min * 60)) / F.lit(bin_min * 60 * block_bins))


def block_window(keys: list[str], ts: str):
    return Window.partitionBy(*keys, BLK).orderBy(ts)


def with_halo(
    df: DataFrame,
    keys: list[str],
    ts: str,
    bin_min: int,
    before: int = 0,
    after: int = 0,
    block_bins: int = 4096,
    mode: str = "rows",
) -> DataFrame:
    """`df` with `_blk`, plus copies (`_halo`) of the neighbouring rows each block needs.

    mode="time": the rows within `before`/`after` bins of time; one shuffle.
    mode="rows": the `before`/`after` nearest rows however far away they are.
    """
    own = block_of(ts, bin_min, block_bins)
    if mode == "time":
        lo = block_of(ts, bin_min, block_bins, -after)
        hi = block_of(ts, bin_min, block_bins, before)
        return (
            df.withColumn("_own", own)
            .withColumn(BLK, F.explode(F.sequence(lo, hi)))
            .withColumn(HALO, F.col(BLK) != F.col("_own"))
            .drop("_own")
        )
    base = df.withColumn(BLK, own)
    out = base.withColumn(HALO, F.lit(False))
    for n, outward, inward in ((before, F.asc(ts), F.desc(ts)), (after, F.desc(ts), F.asc(ts))):
        if n:
            out = out.unionByName(_copies(base, keys, n, outward, inward))
    return out


def _copies(base: DataFrame, keys: list[str], n: int, outward: Column, inward: Column) -> DataFrame:
    """The last `n` rows of every block, sent to each block that follows within `n` rows.

    The per-block ranking is a group limit (map-side pruned), so only n rows per
    block reach the station-wide window.
    """
    edge = (
        base.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, BLK).orderBy(inward)))
        .filter(F.col("_rn") <= n)
        .drop("_rn")
    )
    ahead = Window.partitionBy(*keys).orderBy(outward).rowsBetween(1, n)
    return (
        edge.withColumn("_dst", F.collect_set(BLK).over(ahead))
        .withColumn("_dst", F.explode(F.array_remove("_dst", F.col(BLK))))
        .withColumn(BLK, F.col("_dst"))
        .drop("_dst")
        .withColumn(HALO, F.lit(True))
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(BLK, HALO)


def same_value(prev: Column, cur: Column) -> Column:
    return prev.eqNullSafe(cur)


def runs(
    df: DataFrame,
    keys: list[str],
    ts: str,
    state: Column,
    bin_min: int,
    block_bins: int = 4096,
    same: Callable[[Column, Column], Column] = same_value,
) -> DataFrame:
    """Maximal runs per key: (keys, state, start, second, end, n, leading).

    `same(prev, cur)` says whether a row continues the run of the row before it.
    `second` is the time of the run's second row, `leading` marks a key's first run.
    """
    local = (
        df.select(*keys, F.col(ts).alias("_ts"), state.alias("_s"), block_of(ts, bin_min, block_bins).alias(BLK))
        .withColumn("_prev", F.lag(F.struct("_s")).over(block_window(keys, "_ts")))
        .withColumn(
            "_new",
            F.when(F.col("_prev").isNull(), F.lit(1))
            .when(same(F.col("_prev._s"), F.col("_s")), F.lit(0))
            .otherwise(F.lit(1)),
        )
        .withColumn("_run", F.sum("_new").over(block_window(keys, "_ts")))
        .groupBy(*keys, BLK, "_run")
        .agg(
            F.min_by("_s", "_ts").alias("_first"),
            F.max_by("_s", "_ts").alias("_last"),
            F.min("_ts").alias("start"),
            F.min(F.when(F.col("_new") == 0, F.col("_ts"))).alias("second"),
            F.max("_ts").alias("end"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("_runs", F.max("_run").over(Window.partitionBy(*keys, BLK)))
    )
    edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_runs"))
    # Edge runs of a key meet in one partition, inner runs stay with their block.
    placed = local.withColumn("_home", F.when(edge, F.lit(None).cast("long")).otherwise(F.col(BLK)))
    along = Window.partitionBy(*keys, "_home").orderBy("start")
    joins = (F.col(BLK) != F.lag(BLK).over(along)) & same(F.lag("_last").over(along), F.col("_first"))
    return (
        placed.withColumn("_cut", F.when(F.lag(BLK).over(along).isNull(), 1).when(joins, 0).otherwise(1))
        .withColumn("_gid", F.sum("_cut").over(along))
        .groupBy(*keys, "_home", "_gid")
        .agg(
            F.min_by("_first", "start").alias("state"),
            F.min("start").alias("start"),
            F.min(F.when(F.col("_cut") == 1, F.col("second")).otherwise(F.col("start"))).alias("second"),
            F.max("end").alias("end"),
            F.sum("n").alias("n"),
        )
        .select(
            *keys, "state", "start", "second", "end", "n",
            (F.col("_home").isNull() & (F.col("_gid") == 1)).alias("leading"),
        )
    )


def positions(
    df: DataFrame, ts: str, bin_min: int, block_bins: int = 4096, keys: list[str] | None = None, name: str = "pos"
) -> DataFrame:
    """Zero-based row number in `ts` order, from per-block counts and ranks."""
    keys = keys or []
    b = df.withColumn(BLK, block_of(ts, bin_min, block_bins))
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offset = (
        b.groupBy(*keys, BLK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_off",
            F.coalesce(
                F.sum("_n").over(before.orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .drop("_n")
    )
    ranked = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, BLK).orderBy(ts)))
    return (
        ranked.join(offset, [*keys, BLK])
        .withColumn(name, F.col("_off") + F.col("_rn") - 1)
        .drop("_off", "_rn", BLK)
    )
