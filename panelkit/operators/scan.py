"""Linear recurrences as scans of affine maps, for series that no task has to hold.

A moving average e' = (1 - a) e + a x is an affine map of e, and such maps compose. Rows
are range-partitioned by series and time; each partition folds its rows as if nothing came
before them and keeps what a value from before would weigh. One map per partition and
series is composed in order, which gives every partition the value to start from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelkit.session import materialize


def decayed(u: np.ndarray, first: np.ndarray, b: float) -> np.ndarray:
    """y[i] = u[i] + b y[i - 1] within runs that begin at `first`, by doubling: maps over 1, 2, 4, ... rows."""
    y, at, step, weight = u.copy(), np.arange(len(u)), 1, b
    start = np.repeat(first, np.diff(np.append(first, len(u))))
    while step < len(u) and abs(weight) > 1e-300:
        more = np.zeros(len(u))
        more[step:] = np.where(at[step:] - step >= start[step:], y[:-step], 0.0)
        y = y + weight * more
        step, weight = step * 2, weight * weight
    return y


def ema(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = (), alpha: float = 0.3) -> DataFrame:
    """(keys, order, `value`_ema): e = x for a series' first value, then (1 - alpha) e + alpha x.

    Null inputs give null and leave the state. Rows of equal order take any order.
    """
    b, x = 1.0 - alpha, F.col(value).cast("double")
    names = [f"_k{i}" for i in range(len(keys))]
    known = df.filter(x.isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(order).alias("_at"), x.alias("_x"))
    dealt = known.repartitionByRange(*names, "_at").sortWithinPartitions(*names, "_at").withColumn("_p", F.spark_partition_id())
    fields = ["_y", "_f", "_from", "_n"]

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y_last, n_last, x_first = None, 0.0, 0, 0.0
        for f in frames:
            if not f.num_rows:
                continue
            v = f.column("_x").to_numpy(zero_copy_only=False)
            series = list(zip(*(f.column(n).to_pylist() for n in names))) if names else [()] * len(v)
            first = np.array([i for i in range(len(v)) if i == 0 or series[i] != series[i - 1]])
            size = np.diff(np.append(first, len(v)))
            u = alpha * v
            goes_on = last is not None and series[0] == last
            if goes_on:
                u[0] += b * y_last
            y = decayed(u, first, b)
            n = np.arange(len(v)) - np.repeat(first, size) + 1
            begin = np.repeat(v[first], size)
            if goes_on:
                n[:size[0]] += n_last
                begin[:size[0]] = x_first
            last, y_last, n_last, x_first = series[-1], float(y[-1]), int(n[-1]), float(begin[-1])
            yield pa.RecordBatch.from_arrays(
                [*f.columns, pa.array(y), pa.array(np.power(b, n.astype(float))), pa.array(begin), pa.array(n)], [*f.schema.names, *fields])

    schema = ", ".join([*(f"{c.name} {c.dataType.simpleString()}" for c in dealt.schema.fields), "_y double, _f double, _from double, _n long"])
    rows = materialize(dealt.mapInArrow(fold, schema), "ema-rows")
    # One map per partition and series: its last row's.
    maps = rows.groupBy(*names, "_p").agg(F.max_by(F.struct("_y", "_f", "_from"), "_n").alias("_m"))
    steps = maps.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_p", "_m"))).alias("_maps"))
    begin = F.struct(F.get("_maps", F.lit(0))["_m"]["_from"].alias("e"), F.array().cast("array<double>").alias("before"))
    carried = F.aggregate("_maps", begin, lambda a, s: F.struct(
        (s["_m"]["_y"] + s["_m"]["_f"] * a["e"]).alias("e"), F.concat(a["before"], F.array(a["e"])).alias("before")), lambda a: a["before"])
    starts = steps.select(
        *[F.col(n).alias(f"{n}s") for n in names], F.explode(F.arrays_zip(F.transform("_maps", lambda s: s["_p"]).alias("p"), carried.alias("e"))).alias("_z")
    ).select(*[f"{n}s" for n in names], F.col("_z.p").alias("_ps"), F.col("_z.e").alias("_e"))
    same = F.col("_p") == F.col("_ps")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}s"))
    label = [F.col(n).alias(k) for k, n in zip(keys, names)]
    out = rows.join(starts, same).select(*label, F.col("_at").alias(order), (F.col("_y") + F.col("_f") * F.col("_e")).alias(f"{value}_ema"))
    return out.unionByName(df.filter(x.isNull()).select(*keys, order, F.lit(None).cast("double").alias(f"{value}_ema")))
