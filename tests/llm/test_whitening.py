"""Whitening against numpy's eigenvectors of the whole covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from panelkit.llm import whitening
from panelkit.llm.frames import table

SCHEMA = "vec_id long, embedding array<float>, component int"


def plain(vectors):
    """(n, deviations, whitened up to sign, explained) from float32 vectors."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], np.int64)
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    c = x - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, deviation, c @ vectors[:, :8] / np.sqrt(values[:8]), values[:8] / values.sum()


def same(got, ids, want):
    n, deviation, white, explained = want
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(rows) == len(got) == len(ids) * white.shape[1]
    for j in range(white.shape[1]):
        mine = np.array([rows[i, j + 1].whitened for i in ids])
        sign = np.sign(mine @ white[:, j])
        assert np.abs(mine * sign - white[:, j]).max() < 1e-8
    for i, dev in zip(ids, deviation):
        r = rows[i, 1]
        assert (r.n, r.deviation) == (n, dev) and abs(r.explained / explained[0] - 1) < 1e-9 and r.identity_error < 1e-9


def test_equals_full_eigenvectors(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = df.collect()
    got = whitening.whiten(df).collect()
    same(got, [r.vec_id for r in rows], plain([r.embedding for r in rows]))


@pytest.mark.parametrize("d", [3, 24, 40])
def test_left_out_rows_and_repeats(spark, d):
    rng = np.random.default_rng(d)
    base = rng.normal(size=(120, d)) @ np.diag(1.15 ** -np.arange(d))
    good = [(i, [float(x) for x in np.float32(v)], 0) for i, v in enumerate(base)]
    good += [(500, good[0][1], 1)]
    bad = [(900, None, 0), (901, [None] + [1.0] * (d - 1), 0), (902, [float("nan")] * d, 0), (903, [float("-inf")] + [0.0] * (d - 1), 0), (904, [], 0), (905, [1.0] * (d + 1), 0)]
    got = whitening.whiten(spark.createDataFrame(good + bad, SCHEMA).repartition(3)).collect()
    same(got, [r[0] for r in good], tuple(x if i in (0, 1) else x[..., :8] for i, x in enumerate(plain([r[1] for r in good]))))


def test_nothing_to_whiten(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(4)], SCHEMA)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 0) for i in range(4)], SCHEMA)).collect()
    assert {r.component for r in line} == {1} and len(line) == 4


def test_residual_is_certified(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64)) * np.linspace(2, 1, 64)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    held = whitening.quantised(df)
    found = whitening.spectrum(whitening._packed(held, 64), 2000, whitening._sums(held, 64))
    assert found.residual <= 1e-12 * found.values[0] and np.abs(found.vectors.T @ found.vectors - np.eye(8)).max() < 1e-12
    full = np.linalg.eigvalsh(np.cov(np.array([[math.floor(1024 * float(np.float32(c))) for c in v] for v in x]).T, bias=True))[::-1][:8]
    assert np.abs(found.values / full - 1).max() < 1e-11
