"""Scans of recurrences, and importances recounted by routing rows through the trees."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from panelkit.operators import scan, trees


@pytest.mark.parametrize("parts", ["3", "16"])
def test_ema_equals_a_loop(spark, parts):
    rnd = random.Random(4)
    rows = [(s, t, None if rnd.random() < 0.1 else rnd.random()) for s in ("a", "b", None, "d") for t in range(rnd.choice([1, 40, 300]))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "s string, t int, x double").repartition(5)
        got = {(r.s, r.t): r.x_ema for r in scan.ema(df, "x", "t", ("s",), 0.2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    state, want = {}, {}
    for s, t, x in rows:
        if x is not None:
            state[s] = x if s not in state else 0.8 * state[s] + 0.2 * x
        want[s, t] = None if x is None else state[s]
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] if want[k] is None else abs(got[k] - want[k]) < 1e-12 for k in want)


def test_one_long_series_spreads_over_tasks(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("t"), (F.sin("id") + F.col("id") % 7).alias("x"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scan.ema(df, "x", "t", alpha=0.1)
        at = {r.t: r.x_ema for r in out.filter("t % 99991 = 0").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    import math

    e = None
    for t in range(1_000_000):
        x = math.sin(t) + t % 7
        e = x if e is None else 0.9 * e + 0.1 * x
        if t in at:
            assert abs(at[t] - e) < 1e-9
    assert len(at) == 11


def test_no_rows(spark):
    assert scan.ema(spark.createDataFrame([], "t int, x double"), "x", "t").count() == 0


def test_cover_by_routing_rows(spark):
    rnd = random.Random(7)
    data = [(rnd.random(), rnd.random(), rnd.random()) for _ in range(400)]
    rows = [(a, b, c, 3 * (a > 0.5) + (b > 0.3) * a + 0.01 * c) for a, b, c in data]
    names = ("a", "b", "c")
    df = VectorAssembler(inputCols=list(names), outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, c double, y double"))
    model = GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, subsamplingRate=1.0, seed=1).fit(df)
    nodes = trees.node_table(spark, model, names).collect()
    by = {(n.tree, n.node): n for n in nodes}
    reached = dict.fromkeys(by, 0)
    for row in rows:
        for tree in range(4):
            n = by[tree, 0]
            while True:
                reached[tree, n.node] += 1
                if n.feature is None:
                    break
                n = by[tree, n.left if row[names.index(n.feature)] <= n.threshold else n.right]
    assert all(reached[k] == n.n for k, n in by.items())
    got = {r.feature: r for r in trees.split_importances(trees.node_table(spark, model, names)).collect()}
    splits = [n for n in nodes if n.feature]
    for f in {n.feature for n in splits}:
        mine = [n for n in splits if n.feature == f]
        assert got[f].weight == len(mine)
        assert abs(got[f].cover - sum(reached[n.tree, n.node] for n in mine) / len(mine)) < 1e-9
        assert abs(got[f].gain - sum(n.gain * n.n for n in mine) / len(mine)) < 1e-9
    assert abs(sum(r.gain_share for r in got.values()) - 1) < 1e-9 and abs(sum(r.cover_share for r in got.values()) - 1) < 1e-9
