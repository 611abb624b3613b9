"""Pivot-pruned search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import nearest


def _table(spark, m, ids=None):
    rows = [(int(i), None if x is None else [float(y) for y in x]) for i, x in zip(ids if ids is not None else range(len(m)), m)]
    return spark.createDataFrame(rows, "idx int, vec array<double>")


def _brute(m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = u @ u.T
    return {q: [int(j) for j in np.lexsort((np.arange(len(m)), -sim[q]))[:k]] for q in range(len(m))}


def _lists(found):
    out = {}
    for r in found.matches.orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append(r.idx)
    return out


def test_clusters_are_exact_and_pruned(spark):
    g = np.random.default_rng(4)
    centres = g.normal(size=(24, 8))
    m = centres[g.integers(24, size=1500)] + 0.05 * g.normal(size=(1500, 8))
    found = nearest.every_nearest(_table(spark, m), 5, pivots=48, block_rows=32, group_rows=32)
    assert _lists(found) == _brute(m, 5)
    met = found.met.first()
    assert met.all_pairs == 1500 * 1500 and met.pairs < met.all_pairs / 3


@pytest.mark.parametrize("pivots, rows, group", [(1, 7, 7), (5, 64, None), (60, 1, 4), (9, 3, None)])
def test_no_structure_is_exact(spark, pivots, rows, group):
    m = np.random.default_rng(5).normal(size=(60, 5))
    found = nearest.every_nearest(_table(spark, m), 4, pivots=pivots, block_rows=rows, group_rows=group)
    assert _lists(found) == _brute(m, 4)


def test_copies_ties_and_vectors_without_an_angle(spark):
    m = [[1.0, 0.0]] * 40 + [[0.0, 1.0]] * 3 + [[0.0, 0.0], None, [1.0, 1.0]]
    found = nearest.every_nearest(_table(spark, m), 4)
    got = _lists(found)
    assert sorted(got) == [*range(43), 45]
    assert all(got[q] == [0, 1, 2, 3] for q in range(40))
    assert all(got[q] == [40, 41, 42, 45] for q in (40, 41, 42))
    assert got[45] == [45, 0, 1, 2]
    assert found.met.first().all_pairs == 9


def test_fewer_than_k_and_none(spark):
    found = nearest.every_nearest(_table(spark, [[1.0, 0.0], [0.5, 0.5]]), 5)
    assert _lists(found) == {0: [0, 1], 1: [1, 0]}
    none = nearest.every_nearest(_table(spark, []).where(F.lit(False)), 5)
    assert none.matches.count() == 0 and none.met.first().pairs == 0
