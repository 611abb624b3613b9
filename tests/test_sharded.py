"""Sharded training against the trainer that holds whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import sgns, sharded


def _examples(spark, width):
    r = np.random.default_rng(width)
    rows = {}
    for _ in range(300):
        key = (tuple(int(x) for x in r.integers(0, 30, width)), int(r.integers(0, 30)))
        rows[key] = rows.get(key, 0) + int(r.integers(1, 4))
    rows[((3,) * width, 4)] = 2500  # over two pieces of noise
    return spark.createDataFrame([(list(i), t, n) for (i, t), n in rows.items()], "inputs array<int>, target int, n long").repartition(3)


@pytest.mark.parametrize("width, optimizer, cap", [(1, "adam", None), (3, "adam", 0.4), (1, "sgd", None)])
def test_same_as_whole_matrices(spark, width, optimizer, cap):
    kind = dict(lr=0.05, negatives=2, epochs=2, steps_per_epoch=2, seed=3, optimizer=optimizer, max_norm=cap, gamma=0.5)
    whole = sgns.Trainer(31, 5, **kind)
    parts = sharded.ShardedTrainer(31, 5, **kind, spark=spark, rows=7)
    parts.resume(whole.checkpoint(spark))
    e = _examples(spark, width).cache()
    whole.fit(e)
    parts.fit(e)
    got, want = ([(h["epoch"], h["step"], h["name"], h["value"]) for h in t.history] for t in (parts, whole))
    assert [x[:3] for x in got] == [x[:3] for x in want] and len(got) > 10
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=0, atol=1e-9)
    for r in parts.vectors().collect():
        assert np.allclose(r.vec, whole.params[r.side][r.idx], rtol=0, atol=1e-9)
    assert abs(parts.validate(e)["loss"] - whole.validate(e)["loss"]) < 1e-9


def test_resume_and_first_vectors(spark):
    kind = dict(lr=0.1, negatives=1, seed=5, steps_per_epoch=1, spark=spark, rows=4)
    e = _examples(spark, 1)
    once = sharded.ShardedTrainer(30, 3, epochs=3, **kind).fit(e)
    first = sharded.ShardedTrainer(30, 3, epochs=2, **kind).fit(e)
    again = sharded.ShardedTrainer(30, 3, epochs=3, **kind).resume(first.checkpoint()).fit(e)
    a, b = ({(r.side, r.idx): r.vec for r in t.vectors().collect()} for t in (once, again))
    assert a.keys() == b.keys() and len(a) == 60 and all(np.allclose(a[k], b[k], atol=1e-12) for k in a)
    drawn = {(r.side, r.idx): r.vec for s in ("input", "output") for r in sgns.xavier(spark, 30, 3, 5, s).collect()}
    fresh = {(r.side, r.idx): r.vec for r in sharded.ShardedTrainer(30, 3, **kind).vectors().collect()}
    assert all(np.allclose(fresh[k], drawn[k], atol=1e-12) for k in drawn)
    with pytest.raises(ValueError):
        sharded.ShardedTrainer(29, 3, **kind).resume(first.checkpoint())
    tokens = spark.range(30).select(F.col("id").cast("int").alias("idx"), F.concat(F.lit("t"), "id").alias("token"))
    assert first.embeddings(tokens).count() == 60


def test_all_noise_is_drawn(spark):
    e = spark.createDataFrame([([1], 2, 2500), ([1], 3, 1)], "inputs array<int>, target int, n long")
    got = sgns.with_noise(e, 5, 40, 1, 0).collect()
    assert sum(len(r.neg) for r in got) == 5 * 2501 and sum(r.n for r in got) == 2501
    assert sorted((r.target, r.piece, r.n) for r in got) == [(2, 0, 1024), (2, 1, 1024), (2, 2, 452), (3, 0, 1)]
    counts = np.bincount(np.concatenate([r.neg for r in got]), minlength=40)
    assert counts.min() > 220 and counts.max() < 410


def test_documents_beyond_the_whole_trainers_limit(spark, monkeypatch):
    from vecloom.functions import text
    from vecloom.operators import vocabulary
    from vecloom.sources.datasets import document_lines

    lines = text.sentences(document_lines(spark, "/root/testdata/sf0.001"), radius=1, max_length=64).drop("text").withColumn("k", F.struct("doc_id", "line"))
    v = vocabulary.build_vocab(lines, 20).cache()
    e = vocabulary.examples(vocabulary.encode(lines, v, "k"), 1).cache()
    n = v.count()
    monkeypatch.setattr(sgns.Trainer, "SENT", n * 8 * 16 - 1)
    with pytest.raises(ValueError):
        sgns.Trainer(n, 8)
    t = sharded.ShardedTrainer(n, 8, lr=0.05, negatives=2, epochs=4, steps_per_epoch=1, spark=spark, rows=-(-n // 5)).fit(e)
    losses = [h["value"] for h in t.history if h["name"] == "train/loss"]
    assert len(losses) == 4 and losses[-1] < losses[0] - 0.05
    assert t.shards == 5 and t.vectors().count() == 2 * n


@pytest.mark.parametrize("width", [1, 3])
def test_groups_of_shards_and_pieces_of_cells(spark, monkeypatch, width):
    """Terms are packed, shards meet in groups, and a cell of many terms comes apart: the same step."""
    sizes = []
    packer = sharded._packer
    monkeypatch.setattr(sharded, "_packer", lambda *a: sizes.append(a[3]) or packer(*a))
    monkeypatch.setattr(sharded, "MOST_TERMS", 100)
    monkeypatch.setattr(sharded, "HELD", 200)
    kind = dict(lr=0.05, negatives=2, epochs=1, steps_per_epoch=1, seed=3)
    whole = sgns.Trainer(31, 5, **kind)
    parts = sharded.ShardedTrainer(31, 5, **kind, spark=spark, rows=7).resume(whole.checkpoint(spark))
    e = _examples(spark, width).cache()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        parts.fit(e)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    whole.fit(e)
    assert sizes[0] > 1
    got, want = ([h["value"] for h in t.history] for t in (parts, whole))
    assert np.allclose(got, want, rtol=0, atol=1e-9) and len(got) > 3
    for r in parts.vectors().collect():
        assert np.allclose(r.vec, whole.params[r.side][r.idx], rtol=0, atol=1e-9)
