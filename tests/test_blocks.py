"""Block-wise results equal whole-station results, whatever the block size."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from panelkit.operators.blocks import block_window, drop_halo, positions, runs, with_halo
from panelkit.operators.quantiles import bin_left_closed, bin_right_closed, quantiles


@pytest.fixture(scope="module")
def gappy(spark):
    random.seed(1)
    data = []
    for st in "ab":
        t = 0
        for _ in range(400):
            t += random.choice([1, 1, 1, 2, 7, 40])
            data.append((st, t * 300, random.choice([0, 0, 1, 2, None])))
    return spark.createDataFrame(data, "k string, e long, v int").withColumn("ts", F.timestamp_seconds("e")).cache()


@pytest.mark.parametrize("block", [4, 16, 100_000])
def test_rows_halo(gappy, block):
    def features(df, w):
        return df.withColumns(
            {"lag6": F.lag("v", 6).over(w), "lead3": F.lead("v", 3).over(w), "avg6": F.avg("v").over(w.rowsBetween(-6, -1))}
        )

    got = drop_halo(features(with_halo(gappy, ["k"], "ts", 5, 6, 3, block), block_window(["k"], "ts")))
    want = features(gappy, Window.partitionBy("k").orderBy("ts"))
    assert got.count() == want.count()
    assert want.exceptAll(got.select(want.columns)).count() == 0


@pytest.mark.parametrize("block", [4, 16, 100_000])
def test_time_halo(gappy, block):
    w = lambda keys: Window.partitionBy(*keys).orderBy("e").rangeBetween(-1800, -300)
    got = drop_halo(with_halo(gappy, ["k"], "ts", 5, 6, 0, block, "time").withColumn("s", F.sum("v").over(w(["k", "_blk"]))))
    want = gappy.withColumn("s", F.sum("v").over(w(["k"])))
    assert want.exceptAll(got.select(want.columns)).count() == 0


@pytest.mark.parametrize("block", [4, 16])
def test_runs_do_not_depend_on_blocks(gappy, block):
    a = runs(gappy, ["k"], "ts", F.col("v"), 5, block)
    b = runs(gappy, ["k"], "ts", F.col("v"), 5, 10**6)
    assert a.agg(F.sum("n")).first()[0] == 800
    assert a.count() == b.count()
    assert b.exceptAll(a.select(b.columns)).count() == 0


def test_runs_by_hand(spark):
    v = [1, 1, 2, 2, 2, None, None, 1]
    df = spark.createDataFrame([("a", i * 300, x) for i, x in enumerate(v)], "k string, e long, v int")
    df = df.withColumn("ts", F.timestamp_seconds("e"))
    got = runs(df, ["k"], "ts", F.col("v"), 5, 3).orderBy("start").collect()
    assert [(r.state, r.n, r.leading) for r in got] == [(1, 2, True), (2, 3, False), (None, 2, False), (1, 1, False)]


def test_positions(gappy):
    got = positions(gappy, "ts", 5, 8, ["k"])
    want = F.row_number().over(Window.partitionBy("k").orderBy("ts")) - 1
    assert got.withColumn("w", want).filter("pos != w").count() == 0


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.lognormal(size=2000), np.full(1000, 0.5), [1e9, -1e9]])
    g = np.arange(len(x)) % 2
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double")
    df = df.unionByName(spark.createDataFrame([(0, float("nan")), (1, None)], "g int, x double"))
    probs = [0, 0.01, 0.33, 0.5, 0.95, 1]
    for r in quantiles(df, ["g"], "x", probs).collect():
        np.testing.assert_allclose(r.q, np.quantile(x[g == r.g], probs), rtol=1e-12)
        assert r.n == (g == r.g).sum()
    np.testing.assert_allclose(quantiles(df, [], "x", probs).first().q, np.quantile(x, probs), rtol=1e-12)


def test_quantiles_with_infinities_and_null_groups(spark):
    rows = [(None, float(v)) for v in range(20)] + [(None, float("inf")), ("b", 3.0), ("c", float("-inf")), ("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.q, r.n) for r in quantiles(df, ["g"], "x", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert got[None] == ([0.0, 5.0, 10.0, float("inf")], 21)
    assert got["b"] == ([3.0] * 4, 1)
    assert got["c"][0][0] == float("-inf") and got["c"][0][-1] == 1.0


def test_quantiles_of_wide_integers(spark):
    x = (np.arange(5000, dtype=np.int64) * 7919) % 1_000_003
    df = spark.createDataFrame([(int(v),) for v in x], "x int")
    np.testing.assert_allclose(quantiles(df, [], "x", [0.1, 0.5, 0.9]).first().q, np.quantile(x, [0.1, 0.5, 0.9]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "g int, x double")
    assert quantiles(df, ["g"], "x", [0.5]).count() == 0


def test_bin_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1.0, 1.5, 2.0, 3.0, 3.1)], "v double")
    e = F.array(*[F.lit(x) for x in (0.0, 1.0, 2.0, 3.0)])
    got = df.select(bin_left_closed("v", e).alias("a"), bin_right_closed("v", e).alias("b")).collect()
    assert [r.a for r in got] == [None, 0, 1, 1, 2, 2, None]
    assert [r.b for r in got] == [None, 0, 0, 1, 1, 2, None]
