"""What steps leave on disk: draws stay in their rows, tables and shuffles go with the step that made them."""

import os
from collections import Counter

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from vecloom.functions import rng, text
from vecloom.operators import filters, graph, sgns, storage, triangles, vocabulary
from vecloom.operators.splits import ranks


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_weighted_draws_stay_in_their_rows(spark, monkeypatch):
    weights = spark.createDataFrame([(k, 0.25 + k % 7) for k in range(300)], "idx int, weight double")
    e = spark.createDataFrame([([k % 12], k, 1 + 700 * (k % 3)) for k in range(40)], "inputs array<int>, target int, n long")
    rows = lambda df: sorted((*r.inputs, r.target, r.piece, r.n, *r.neg) for r in df.collect())
    found = sgns.with_weighted_noise(e, 2, sgns.NoiseTable(weights), 3, 1)
    assert _exchanges(found) == 0
    monkeypatch.setattr(sgns, "SENT_WEIGHTS", 10)
    joined = sgns.with_weighted_noise(e, 2, sgns.NoiseTable(weights), 3, 1)
    assert rows(found) == rows(joined) and found.schema["neg"].dataType == joined.schema["neg"].dataType


def test_a_step_leaves_its_result_alone(spark):
    made = []

    def step():
        made.append(storage.cut_lineage(spark.range(1000)))
        made.append(storage.written(made[0].groupBy(F.pmod("id", F.lit(7)).alias("k")).count(), "counts"))
        return made[1].join(made[0], F.col("k") == F.col("id"))

    out = storage.settled(step)
    assert out.count() == 7
    assert not any(os.path.exists(t._vecloom_path.removeprefix("file://")) for t in made)
    assert os.path.exists(out._vecloom_path.removeprefix("file://"))
    storage.drop(out)


def _shuffled(spark, made):
    """Rows shuffled while made() is worked out and read."""
    store = spark.sparkContext._jsc.sc().statusStore()
    args = (None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    before = {store.stageList(*args).apply(i).stageId() for i in range(store.stageList(*args).size())}
    rows = made().collect()
    stages = store.stageList(*args)
    return rows, sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()) if stages.apply(i).stageId() not in before)


def test_draws_and_pairs_are_not_shuffled(spark, monkeypatch):
    arcs = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(200) for j in range(200) if (i * 7 + j) % 40 == 1 and i != j], "src string, dst string").cache()
    near = {tuple(r) for r in arcs.collect()}
    plain = {tuple(r) for r in graph.negative_edges(arcs, 6000, seed=4).collect()}
    assert len(plain) == 6000 and not any((u, v) in near for _, u, v in plain)
    others = graph.NonEdges(arcs)
    monkeypatch.setattr(graph, "SENT_ROWS", 20)  # so that filters tell the draws, and let few pairs meet them
    others.drawn(50).count()
    rows, shuffled = _shuffled(spark, lambda: others.drawn(6000, seed=4))
    assert {tuple(r) for r in rows} == plain
    assert shuffled < 3000
    monkeypatch.setattr(graph, "SENT_NODES", 10)  # names by joins
    assert {tuple(r) for r in graph.negative_edges(arcs, 6000, seed=4).collect()} == plain


@pytest.mark.parametrize("ratio", [0.0, 0.01, 0.5, 0.77, 1.0])
def test_the_cut_of_edges_is_that_of_ranks(spark, ratio):
    edges = spark.createDataFrame([(f"a{i}", f"b{i * i % 91}") for i in range(701)] + [("a1", "b1")] * 40, "src string, dst string")
    got = sorted(tuple(r) for r in graph.train_edges(edges, ratio, seed=2).collect())
    n = 741
    want = ranks(edges, rng.bits(2, F.col("src"), F.col("dst")), ["src", "dst"], n=n).select("src", "dst", F.col("__r") <= round(ratio * n))
    assert got == sorted(tuple(r) for r in want.collect())


def test_edges_are_not_ranked_as_a_whole(spark):
    edges = storage.written(spark.range(20000).select(F.col("id").cast("string").alias("src"), F.lit("x").alias("dst")), "edges")
    rows, shuffled = _shuffled(spark, lambda: graph.train_edges(edges, 0.5, seed=1))
    assert sum(r.train for r in rows) == 10000 and shuffled < 3000
    storage.drop(edges)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_batches_count_their_own_pairs(spark, size):
    texts = [[(i * i + k * (i % 5)) % 11 for k in range(i % 17)] for i in range(90)]
    t = pa.table({"batch": [i // 8 for i in range(90)], "t": pa.array(texts, pa.list_(pa.int64()))})
    want = Counter()
    for i, x in enumerate(texts):
        for at in range(2, len(x) - 2):
            want.update((i // 8, x[at], x[at + d]) for d in (-2, -1, 1, 2))
    got = [(r["batch"], r["input"], r["target"], r["n"]) for b in vocabulary._batch_pairs(iter(t.to_batches(max_chunksize=size)), 2) for r in b.to_pylist()]
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want
    assert list(vocabulary._batch_pairs(iter([]), 2)) == []
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, ids array<int>")
    as_text = rows.select("id", F.col("ids").cast("array<string>").alias("ids"))  # goes by windows
    found = [sorted((r.batch, int(r.inputs[0]), int(r.target), r.n) for r in vocabulary.batch_examples(x, ["id"], 8, 2).collect()) for x in (rows, as_text)]
    assert found[0] == found[1] and len(found[0]) > 100


def test_wedges_are_tested_in_rounds(spark, monkeypatch):
    """Where one filter can't hold all edges well, each round has its share of them, and no triangle is lost or found twice."""
    full = spark.createDataFrame([(a, b, float(100 * a + b)) for a in range(24) for b in range(a + 1, 24) if (a + b) % 5], "lo long, hi long, w double")
    n = full.count()
    once = sorted(tuple(r) for r in triangles.triangles(full, n).collect())
    monkeypatch.setattr(filters, "MOST_BITS", 1 << 20)
    monkeypatch.setattr(triangles, "LEAST_BITS", (4 << 20) // n)
    made = []
    plain = filters.pair_filter
    monkeypatch.setattr(filters, "pair_filter", lambda *a: made.append(a[2]) or plain(*a))
    assert sorted(tuple(r) for r in triangles.triangles(full, n).collect()) == once and len(once) > 100
    assert len(made) > 2


def test_names_of_figures_by_list_and_by_join(spark, monkeypatch):
    e = spark.createDataFrame([(f"n{i}", f"n{(i * j) % 31 + 40}", float(j)) for i in range(20) for j in range(1, 9)], "src string, dst string, weight double").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    rows = lambda: sorted(tuple(r) for r in triangles.second_order_figures(e, 4.0, 0.5).collect())
    sent = rows()
    monkeypatch.setattr(triangles, "SENT_NODES", 3)
    assert rows() == sent and len(sent) == 2 * e.count()


def test_walks_do_not_shuffle_all_arcs_at_each_step(spark, monkeypatch):
    arcs = storage.written(spark.createDataFrame([(f"n{i}", f"n{j}", float(1 + (i * j) % 4)) for i in range(160) for j in range(160) if i != j and (i * i + j * j) % 3 == 0], "src string, dst string, weight double"), "arcs")
    nodes = spark.createDataFrame([(f"n{i}",) for i in (0, 3, 7, 9)], "node string")
    walk = lambda: graph.node2vec(arcs, 6, 2, 1.0, 0.5, seed=3, nodes=nodes)
    rows, shuffled = _shuffled(spark, walk)
    assert shuffled < 4 * arcs.count()  # once to the nodes; before, twice for each round of each step
    plain = sorted(tuple(map(str, r)) for r in rows)
    assert len(plain) == 8 and any(len(r.path) == 6 for r in rows)
    monkeypatch.setattr(graph, "SENT_ROWS", 2)  # so that pairs go by a filter
    monkeypatch.setattr(graph, "SPOKES", 16)  # draws of a walk fall in several blocks
    assert sorted(tuple(map(str, r)) for r in walk().collect()) == plain


def test_texts_move_once_and_changed_words_are_counted(spark, monkeypatch):
    forms = spark.createDataFrame([(f"w{k}s", f"w{k}") for k in range(300)], "word string, final string")
    texts = [(i, None if i == 5 else " ".join(f"W{(i * k) % 350}{'s' if k % 3 else ''}" for k in range(i % 40)) + " " * (i % 3)) for i in range(120)]
    df = storage.written(spark.createDataFrame(texts, "id int, text string"), "texts")
    table = {f"w{k}s": f"w{k}" for k in range(300)}
    # texts once, and of each of four pieces its distinct words
    for size, most in ((1 << 17, 120 + 4 * 300 + 300), (64, 10000)):
        monkeypatch.setattr(text, "PIECE_WORDS", size)
        rows, shuffled = _shuffled(spark, lambda: text._replaced(df, forms, "text", "n"))
        for r in rows:
            x = texts[r.id][1]
            words = None if x is None else x.lower().split(" ")
            assert r.text == (None if x is None else " ".join(table.get(w, w) for w in words))
            assert r.n == (None if x is None else sum(w in table for w in words))
        assert len(rows) == 120 and shuffled < most
