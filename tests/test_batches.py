"""Steps by batches of sentences, exact and with local steps."""

import numpy as np
import pytest

from vecloom.operators import sgns, sharded, vocabulary
from vecloom.operators.local_steps import LocalTrainer
from vecloom.plans import config

KIND = dict(lr=0.05, negatives=2, epochs=2, seed=3)


def _sentences(spark, n=45, words=20):
    g = np.random.default_rng(8)
    rows = [(i, [int(x) for x in g.integers(0, words, g.integers(3, 12))]) for i in range(n)]
    return spark.createDataFrame(rows, "id int, ids array<int>").repartition(3), rows


def _by_hand(rows, size, radius):
    rows = [ids for _, ids in rows if len(ids) >= 2 * radius + 1]
    out = {}
    for at, ids in enumerate(rows):
        for c in range(radius, len(ids) - radius):
            for t in [*ids[c - radius : c], *ids[c + 1 : c + 1 + radius]]:
                key = (at // size, ids[c], t)
                out[key] = out.get(key, 0) + 1
    return out, -(-len(rows) // size)


@pytest.fixture(scope="module")
def examples(spark):
    s, rows = _sentences(spark)
    return vocabulary.batch_examples(s, ["id"], 8, 2).cache(), rows


def test_batches_by_hand(examples):
    found, rows = examples
    want, _ = _by_hand(rows, 8, 2)
    assert {(r.batch, r.inputs[0], r.target): r.n for r in found.collect()} == want


def _same(a, b, tol=1e-9):
    return all(np.allclose(a.params[s], b.params[s], rtol=0, atol=tol) for s in a.params)


def test_one_step_a_batch(spark, examples):
    found, rows = examples
    count = _by_hand(rows, 8, 2)[1]
    t = sgns.Trainer(20, 4, **KIND).fit(found)
    assert t.state.t == 2 * count and count > 4
    # the same by single steps
    by_hand = sgns.Trainer(20, 4, **KIND)
    for epoch in range(2):
        for b in range(count):
            by_hand.state.lr = 0.05
            by_hand._step(found.where(f"batch = {b}").drop("batch"), epoch * count + b)
    assert _same(t, by_hand)
    parts = sharded.ShardedTrainer(20, 4, **{**KIND, "epochs": 1}, spark=spark, rows=7).resume(sgns.Trainer(20, 4, **KIND).checkpoint(spark))
    few = found.where("batch < 2")
    parts.fit(few)
    whole = sgns.Trainer(20, 4, **{**KIND, "epochs": 1}).fit(few)
    assert all(np.allclose(r.vec, whole.params[r.side][r.idx], rtol=0, atol=1e-9) for r in parts.vectors().collect())


@pytest.mark.parametrize("optimizer, cap, steps", [("adam", 0.4, 3), ("sgd", None, 100)])
def test_one_task_takes_the_exact_steps(spark, examples, optimizer, cap, steps):
    kind = dict(KIND, optimizer=optimizer, max_norm=cap)
    exact = sgns.Trainer(20, 4, **kind).fit(examples[0])
    local = LocalTrainer(20, 4, **kind, tasks=1, local_steps=steps).fit(examples[0])
    assert local.state.t == exact.state.t and _same(local, exact)


def test_tasks_are_averaged_by_their_steps(spark, examples, monkeypatch):
    from vecloom.operators import local_steps

    monkeypatch.setattr(local_steps, "ROWS", 7)
    found, rows = examples
    count = _by_hand(rows, 8, 2)[1]
    local = LocalTrainer(20, 4, **{**KIND, "epochs": 1}, tasks=3, local_steps=100).fit(found)
    copies, taken = [], []
    for task in range(3):
        t = sgns.Trainer(20, 4, **KIND)
        t.state.lr = 0.05
        for b in range(task, count, 3):
            t._step(found.where(f"batch = {b}").drop("batch"), b)
        copies.append(t)
        taken.append(t.state.t)
    assert len(set(taken)) > 1 or count % 3 == 0
    for s in ("input", "output"):
        for get, have in ((lambda t: t.params[s], local.params[s]), (lambda t: t.state.m[s], local.state.m[s]), (lambda t: t.state.v[s], local.state.v[s])):
            assert np.allclose(sum(n * get(t) for n, t in zip(taken, copies)) / count, have, rtol=0, atol=1e-12)
    # goes on from a checkpoint
    again = LocalTrainer(20, 4, **KIND, tasks=3, local_steps=2).resume(local.checkpoint(spark)).fit(found)
    assert again.epoch == 2 and np.isfinite(again.params["input"]).all()


def test_without_batches(spark, examples):
    with pytest.raises(ValueError, match="batch"):
        LocalTrainer(20, 4, **KIND).fit(examples[0].drop("batch"))
    none = examples[0].where("batch < 0")
    assert sgns.Trainer(20, 4, **KIND).fit(none).state.t == 0
    assert LocalTrainer(20, 4, **KIND).fit(none).state.t == 0


def test_settings(spark, tmp_path):
    from vecloom.plans import train

    text = "{data: {dataset: abcde, context_radius: 1, batch_size: 2}, train: {max_epochs: 1, local_tasks: %d, local_steps: 1}, embedding_dim: 2}"
    exact = train.train(spark, config.load(text % 1), str(tmp_path / "a")).trainer
    found = exact.state.t
    local = train.train(spark, config.load(text % 2), str(tmp_path / "b")).trainer
    assert type(exact) is sgns.Trainer and isinstance(local, LocalTrainer)
    assert found > local.state.t >= found / 2
    with pytest.raises(ValueError, match="batch_size"):
        config.load("{train: {local_tasks: 2}}").make_trainer(5)
    a, b = (config.load("{data: {context_radius: 1, batch_size: 3}}").make_examples(_tokens(spark), _vocab(spark), e) for e in (0, 1))
    of = lambda e: sorted((r.batch, r.inputs[0], r.target, r.n) for r in e.collect())
    assert of(a) != of(b) and sorted(x[1:3] for x in of(a)) == sorted(x[1:3] for x in of(b))


def _tokens(spark):
    return spark.createDataFrame([([f"w{3 * i}", f"w{3 * i + 1}", f"w{3 * i + 2}"],) for i in range(12)], "tokens array<string>")


def _vocab(spark):
    return vocabulary.build_vocab(_tokens(spark), 0)
