"""t-SNE through neighbours and a grid against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import nearest, similarity, tsne
from vecloom.operators.storage import written


def _table(spark, m):
    return spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in enumerate(m)], "idx int, vec array<double>")


def _clusters(n=200, dims=6, groups=5, seed=1):
    g = np.random.default_rng(seed)
    of = g.integers(groups, size=n)
    return g.normal(size=(groups, dims))[of] * 4 + g.normal(size=(n, dims)), of


def _dense(m, perplexity):
    """Shares by brute force over the nearest, one point after the other."""
    n = len(m)
    p = min(perplexity, max(2.0, (n - 1) / 3))
    k, out = min(n - 1, int(3 * p)), np.zeros((n, n))
    for i in range(n):
        d = ((m - m[i]) ** 2).sum(1)
        near = [j for j in np.lexsort((np.arange(n), d)) if j != i][:k]
        lo, hi = 1e-12, 1e12
        for _ in range(200):
            beta = np.sqrt(lo * hi)
            w = np.exp(-(d[near] - d[near].min()) * beta)
            w /= w.sum()
            h = -(w[w > 0] * np.log(w[w > 0])).sum()
            lo, hi = (beta, hi) if h > np.log(p) else (lo, beta)
        out[i, near] = w
    return out


@pytest.mark.parametrize("pivots, rows, group", [(1, 7, 7), (12, 16, 32), (60, 1, 4)])
def test_euclidean_nearest(spark, pivots, rows, group):
    m, _ = _clusters(150)
    m[3] = 0.0
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    found = nearest.every_nearest(_table(spark, m), 4, pivots=pivots, block_rows=rows, group_rows=group, metric="euclidean").matches.orderBy("query", "rank").collect()
    assert [r.idx for r in found] == [int(j) for q in range(150) for j in np.lexsort((np.arange(150), d[q]))[:4]]
    assert max(abs(-r.sim - d[r.query, r.idx]) for r in found) < 1e-6
    with pytest.raises(ValueError, match="metric"):
        nearest.every_nearest(_table(spark, m), 4, metric="none")


def test_affinities(spark):
    m, _ = _clusters()
    want, got = _dense(m, 10.0), np.zeros((200, 200))
    arcs = tsne.affinities(_table(spark, m), 10.0).cache()
    for r in arcs.collect():
        got[r.idx, r.to] = r.p
    assert np.abs(got - want).max() < 1e-6
    joint = np.zeros((200, 200))
    for r in tsne.symmetric(arcs).collect():
        joint[r.idx, r.to] = r.p
    assert np.abs(joint - (want + want.T) / 400).max() < 1e-9 and abs(joint.sum() - 1) < 1e-9


@pytest.mark.parametrize("span", [1e-4, 5.0, 60.0])
def test_repulsion_through_the_grid(spark, span):
    y = np.random.default_rng(2).normal(size=(400, 2)) * span / 6
    state = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(y)], "idx long, x double, y double")
    gap = y[:, None] - y[None]
    near = 1 / (1 + (gap**2).sum(-1))
    want = (near[:, :, None] ** 2 * gap).sum(1)
    away, total = tsne.repulsion(state)
    got = np.array([(r.rx, r.ry) for r in away.orderBy("idx").collect()])
    assert abs(total / (near.sum() - len(y)) - 1) < 2e-3
    assert np.abs(got - want).max() < 1e-2 * np.abs(want).max()


def test_rounds_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(tsne, "BLOCK", 32)
    m, _ = _clusters(120)
    p = _dense(m, 10.0)
    p = (p + p.T) / (2 * len(m))
    v = _table(spark, m)
    arcs = tsne.Arcs(tsne.affinities(v, 10.0), len(m))
    # spread out, so that forces tell points apart
    state = written(tsne.start(v).select("idx", (F.col("x") * 2e4).alias("x"), (F.col("y") * 2e4).alias("y"), "ux", "uy"), "points")
    y = np.array([(r.x, r.y) for r in state.orderBy("idx").collect()])
    u = np.zeros_like(y)
    for number in (98, 99, 100):
        gap = y[:, None] - y[None]
        w = 1 / (1 + (gap**2).sum(-1))
        np.fill_diagonal(w, 0)
        g = 4 * ((p * (4 if number < 100 else 1) - w / w.sum())[:, :, None] * w[:, :, None] * gap).sum(1)
        u = (0.5 if number < 100 else 0.8) * u - 50 * g
        y = y + u
        state = written(tsne.advance(state, arcs, len(m), number), "points")
    got = np.array([(r.x, r.y) for r in state.orderBy("idx").collect()])
    assert np.abs(got - y).max() < 1e-2 * np.abs(y).max()


def test_a_hub_nulls_copies_and_few_points(spark):
    # sixty copies: the first of them are everyone's neighbours
    m = [[1.0, 2.0, 3.0]] * 60 + [[0.0, 0.0, 0.0], None, [5.0, 5.0, 5.0]]
    out = tsne.embed(_table(spark, m), 5.0, rounds=3).collect()
    assert sorted(r.idx for r in out) == [i for i in range(63) if i != 61]
    assert all(np.isfinite([r.x, r.y]).all() for r in out)
    assert [r.idx for r in tsne.embed(_table(spark, m[:1]), rounds=3).collect()] == [0]
    assert tsne.embed(_table(spark, m).where("idx > 100"), rounds=3).count() == 0
    two = tsne.embed(_table(spark, [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0]]), rounds=3).collect()
    assert len(two) == 2 and two[0].x != two[1].x


def test_projection_of_many_words(spark, monkeypatch):
    monkeypatch.setattr(similarity, "DRIVER_WORDS", 50)
    m, _ = _clusters(80)
    v = _table(spark, m).withColumn("token", F.concat(F.lit("w"), F.col("idx")))
    out = similarity.project(v, None, method="tsne", rounds=2).collect()
    assert sorted(r.idx for r in out) == list(range(1, 80)) and all(r.token == f"w{r.idx}" for r in out)
