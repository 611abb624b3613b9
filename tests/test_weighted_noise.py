"""Noise by weight."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import sgns, sharded


def test_shares_and_inverse(spark):
    weights = [(0, 0.0), (1, 50.0), (2, 1.0), (3, 1.0), (4, 7.5)] + [(k, 0.25) for k in range(5, 45)]
    t = sgns.NoiseTable(spark.createDataFrame(weights, "idx int, weight double"))
    assert t.total == sum(w for _, w in weights)
    ends = np.cumsum([w for _, w in weights])
    us = [i / 997 for i in range(997)]
    got = {r.u: r.neg for r in t.drawn(spark.createDataFrame([(u,) for u in us], "u double"), F.col("u")).collect()}
    assert got == {u: int(np.searchsorted(ends, u * t.total, side="right")) for u in us}
    assert max(len(r[1]) for r in t.cells.collect()) <= 9
    e = spark.createDataFrame([([1], 2, 3000), ([2], 3, 1)], "inputs array<int>, target int, n long")
    noisy = sgns.with_weighted_noise(e, 4, t, 1, 0).collect()
    drawn = Counter(x for r in noisy for x in r.neg)
    assert all(len(r.neg) == 4 * r.n for r in noisy) and sum(drawn.values()) == 4 * 3001 and drawn[0] == 0
    for k, w in weights[1:5]:
        share = w / t.total
        assert abs(drawn[k] / 12004 - share) < 4.5 * math.sqrt(share * (1 - share) / 12004)
    with pytest.raises(ValueError):
        sgns.NoiseTable(spark.createDataFrame([(0, 0.0)], "idx int, weight double"))


def test_sums_are_exact(spark):
    """A running sum of doubles would lose every weight after the first."""
    weights = [(0, 2.0**53)] + [(k, 1.0) for k in range(1, 3001)]
    t = sgns.NoiseTable(spark.createDataFrame(weights, "idx int, weight double"))
    assert t.total == math.fsum(w for _, w in weights)
    r = np.random.default_rng(1).uniform(0.1, 3, 5000)
    assert sgns.NoiseTable(spark.createDataFrame([(k, float(w)) for k, w in enumerate(r)], "idx int, weight double")).total == math.fsum(r)


def test_both_trainers_take_a_table(spark):
    t = sgns.NoiseTable(spark.createDataFrame([(k, 1.0 + k) for k in range(12)], "idx int, weight double"))
    e = spark.createDataFrame([([k % 12], (5 * k + 1) % 12, 1 + k % 3) for k in range(12)], "inputs array<int>, target int, n long")
    kind = dict(lr=0.1, negatives=2, epochs=1, steps_per_epoch=1, seed=2, noise_table=t)
    whole = sgns.Trainer(12, 3, **kind)
    parts = sharded.ShardedTrainer(12, 3, **kind, spark=spark, rows=5).resume(whole.checkpoint(spark)).fit(e)
    whole.fit(e)
    for r in parts.vectors().collect():
        assert np.allclose(r.vec, whole.params[r.side][r.idx], rtol=0, atol=1e-9)
