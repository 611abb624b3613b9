"""Gradients by blocks of examples: vectors travel by blocks, not by draws."""

import numpy as np
from vecloom.operators import sgns


def _written(spark):
    """Bytes of shuffles that the session has written so far."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_blocks_agree_and_vectors_travel_once_a_block(spark):
    n, dims = 600, 64
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(n, dims)))], "idx int, vec array<double>").cache()
    ex = spark.createDataFrame([([i, (i + 1) % n, i], (7 * i) % n, 1 + i % 40) for i in range(n)], "inputs array<int>, target int, n long")
    noisy = sgns.with_noise(ex, 2, n, 4, 0).cache()
    v.count(), noisy.count()
    rule = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _written(spark)
        one = {(r.side, r.idx, r.at): r.grad for r in sgns.gradients(noisy, v, v).collect()}
        wrote = _written(spark) - before
        many = {(r.side, r.idx, r.at): r.grad for r in sgns.gradients(noisy, v, v, block_bytes=16 * dims * 50).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", rule)
    # 25,000 draws of 512 bytes each would be 12 MB one way alone
    assert wrote < 6 << 20
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-12


def test_outputs_without_a_vector_move_nothing(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [0.5, -1.0])], "idx int, vec array<double>")
    ex = spark.createDataFrame([([0], 2, 0, 1, [1, 2]), ([1], 0, 0, 1, [2, 2])], "inputs array<int>, target int, piece long, n long, neg array<int>")
    got = {(r.side, r.idx, r.at): r.grad for r in sgns.gradients(ex, v, v).collect()}
    assert got["output", 1, 0] == got["output", 1, 1] == 0
    # z = -1.5; the second example has no mean and counts in the total alone
    p, q = 1 / (1 + np.exp(1.5)), 1 / (1 + np.exp(-1.5))
    assert abs(got["output", 2, 0] - (p - 1 + 1 - q) / 2) < 1e-12 and {k[:2] for k in got} == {("output", 1), ("output", 2), ("input", 0)}
