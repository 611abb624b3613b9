"""The search for similar vectors holds few similarities at a time, whatever the queries, and finds the same."""

import numpy as np

from vecloom.operators import similarity


def test_blocks_find_what_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELLS", 40)
    monkeypatch.setattr(similarity, "QUERIES", 8)
    x = np.random.default_rng(3).integers(-2, 3, (60, 4)).astype(float)  # many ties, some of norm zero
    x[::9] = x[0] = [1, 2, 0, 1]
    x[5] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)]
    v = spark.createDataFrame(rows, "idx int, vec array<double>").coalesce(1)
    got = {}
    for r in similarity.top_similar(v.where("idx % 3 = 0 AND vec IS NOT NULL"), v, 4).collect():
        got.setdefault(r.query, []).append((r["rank"], r.idx))
    norm = np.linalg.norm(x, axis=1)
    for q in range(0, 60, 3):
        sims = [round(float(x[q] @ x[i] / (norm[q] * norm[i])), 9) if norm[q] and norm[i] else -9.0 for i in range(60)] + [-9.0]
        want = sorted(range(61), key=lambda i: (-sims[i], i))[:4]
        assert [round(sims[i], 9) for _, i in sorted(got[q])] == [sims[i] for i in want]


def test_top_ties_and_nan():
    sim = np.array([[1.0, np.nan, 1.0, 0.5, 1.0], [np.nan] * 5])
    idx = np.array([[9, 1, 3, 4, 5], [5, 4, 3, 2, 1]])
    ids, best = similarity._top(idx, sim, 3)
    assert ids.tolist() == [[3, 5, 9], [1, 2, 3]]
    assert best[0].tolist() == [1, 1, 1] and np.isnan(best[1]).all()


def test_similarities_held_are_bounded():
    """4 million for all queries of a block at once, with copies, before."""
    assert similarity.CELLS <= 1 << 20 and similarity.QUERIES <= 1024
