import pytest
from pyspark.sql import functions as F

from vecloom.functions import text, vectors
from vecloom.operators import graph, metrics, sgns, splits, vocabulary
from vecloom.plans import config
from vecloom.sources.datasets import dataset, sentences


def _tokens(spark, name):
    return dataset(spark, name).withColumn("tokens", text.tokenize("text"))


def test_tokenizer(spark):
    df = sentences(spark, ["don't stop 2nd 3.14 <unk> e^x ÀÉ l'été ²x x² naïve_a 'tis 42 _ __a", "."]).withColumn("t", text.tokenize("text"))
    got = {r.sent_id: r.t for r in df.collect()}
    assert got[0] == ["don't", "stop", "2nd", "<unk>", "e^x", "l'été", "²x", "x²", "naïve_a", "'tis", "__a"]
    assert got[1] == []


def test_vocabulary(spark):
    got = {r.token: (r.idx, r.freq) for r in vocabulary.build_vocab(_tokens(spark, "abcde"), 0).collect()}
    assert got == {"<unk>": (0, 0), "a": (1, 14), "b": (2, 14), "e": (3, 11), "c": (4, 10), "d": (5, 10)}


def test_windows(spark):
    row = spark.createDataFrame([(list(range(8)),)], "tokens array<int>")
    got = {r.inputs[0]: r.targets for r in vocabulary.windows(row, 3).collect()}
    assert got == {3: [0, 1, 2, 4, 5, 6], 4: [1, 2, 3, 5, 6, 7]}
    pairs = {(r.center, r.ctx): r.n for r in vocabulary.pair_counts(_tokens(spark, "abcde"), 1).collect()}
    assert pairs == {("a", "b"): 20, ("b", "a"): 20, ("c", "d"): 14, ("d", "c"): 14, ("e", "e"): 14}
    with pytest.raises(ValueError):
        text.clip("tokens", 4, 2)


def test_second_order(spark):
    edges = spark.createDataFrame([("t", "v", 1.0), ("v", "x", 1.0), ("t", "x", 1.0), ("v", "y", 1.0)], "src string, dst string, weight double")
    arcs = graph.symmetric(edges)
    for variant, want in (("reference", {"t": 0.047619, "x": 0.761905, "y": 0.190476}), ("paper", {"t": 0.047619, "x": 0.190476, "y": 0.761905})):
        got = graph.second_order(arcs, 4.0, 0.25, variant).where("prev = 't' AND here = 'v'").collect()
        assert {r.dst: round(r.prob, 6) for r in got} == want


def test_walks(spark):
    g = dataset(spark, "graph_triplets")
    rows = graph.deepwalk(graph.symmetric(g.edges), 4, 2, seed=1).collect()
    assert len(rows) == 18 and all(len(r.path) == 4 and len({n[0] for n in r.path}) == 1 for r in rows)
    dead = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    assert graph.deepwalk(dead, 5).first().path == ["a", "b"]
    with pytest.raises(ValueError):
        graph.walk_generator("nope")


def test_edge_operators(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -4.0])], "a array<double>, b array<double>")
    want = {"average": [2, -1], "hadamard": [3, -8], "weighted_l1": [2, 6], "weighted_l2": [4, 36]}
    assert {k: df.select(vectors.edge_operator(k.upper())("a", "b")).first()[0] for k in want} == want


def test_loss(spark):
    df = spark.createDataFrame([(2.0, [0.5, -0.5]), (-1.0, [1.0, -20.0])], "pos double, neg array<double>")
    r = sgns.loss(df).first()
    assert [round(x, 6) for x in r] == [2.100803, 0.720095, 1.380708, 0.5, 0.5]


def test_splits(spark):
    df = spark.range(100)
    got = {r.split: r["count"] for r in splits.train_val_test(df, "id", 0.6, 0.8).groupBy("split").count().collect()}
    assert got == {"train": 60, "val": 20, "test": 20}
    rows = df.withColumn("c", F.when(F.col("id") < 70, "a").when(F.col("id") < 99, "b").otherwise("c"))
    parts = {}
    for r in splits.train_val_test(rows, "id", 0.6, 0.8, label="c").collect():
        parts[r.c, r.split] = parts.get((r.c, r.split), 0) + 1
    # exact shares of the rest: 28, 11.6, 0.4; of test: 14, 6
    assert parts == {("a", "train"): 42, ("a", "val"): 14, ("a", "test"): 14, ("b", "train"): 17, ("b", "val"): 6, ("b", "test"): 6, ("c", "train"): 1}
    assert [splits.test_size(n, r) for n, r in ((9, 0.5), (34, 0.5), (2708, 0.75), (10, 0.8))] == [5, 17, 677, 2]


def test_meter_and_schedule():
    m = metrics.MetricMeter()
    m.push("a", 1)
    m.push("a", 3)
    assert m.get("a") == 2 and dict(m.get_all()) == {"a": 2} and m.is_empty()
    with pytest.raises(metrics.UnknownMetricException):
        m.get("a")
    assert [round(sgns.step_lr(0.1, 20, 0.1, e), 6) for e in (0, 19, 20, 39, 40)] == [0.1, 0.1, 0.01, 0.01, 0.001]


def test_config():
    c = config.load("train: {lr: 1e-3}\ndata: {dataset: test, p: 1e0}")
    assert c.train.lr == 0.001 and c.data.p == 1.0 and config.load(config.dump(c)) == c


@pytest.mark.parametrize("mode", ["sg", "cbow"])
def test_training_lowers_the_loss(spark, mode):
    s = dataset(spark, "abcde").withColumn("tokens", text.tokenize("text"))
    v = vocabulary.build_vocab(s).cache()
    ids = vocabulary.encode(s.where(text.long_enough("tokens", 1)), v, "sent_id")
    t = sgns.Trainer(v.count(), 4, lr=0.1, negatives=2, epochs=10, steps_per_epoch=1).fit(vocabulary.examples(ids, 1, mode))
    means = {(h["epoch"], h["name"]): h["value"] for h in t.history}
    assert means[9, "train-epoch/positive-loss"] < means[0, "train-epoch/positive-loss"] and {"train/loss", "epoch/lr", "train-metrics/recall", "train-metrics/precision"} <= {n for _, n in means}


@pytest.mark.parametrize("mode", ["sg", "cbow"])
def test_gradients_by_joins(spark, mode):
    import numpy as np

    s = dataset(spark, "test").withColumn("tokens", text.tokenize("text"))
    v = vocabulary.build_vocab(s).cache()
    ids = vocabulary.encode(s.where(text.long_enough("tokens", 1)), v, "sent_id")
    ex = vocabulary.examples(ids, 1, mode).cache()
    t = sgns.Trainer(v.count(), 3, negatives=2, seed=5)
    want, _ = t._gradient(ex, 7)
    sides = {k: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "idx int, vec array<double>") for k, m in t.params.items()}
    got = {k: np.zeros_like(m) for k, m in t.params.items()}
    for r in sgns.gradients(sgns.with_noise(ex, 2, t.vocab, 5, 7), sides["input"], sides["output"]).collect():
        got[r.side][r.idx, r.at] = r.grad
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_training_end_to_end(spark, tmp_path):
    from vecloom.plans import train

    settings = f"""
train: {{max_epochs: 4, steps_per_epoch: 5, lr: 0.2, experiment: one}}
loss: {{negatives: 1}}
data: {{dataset: graph_triplets, is_graph: true, walk_length: 5, walks_per_node: 8, context_radius: 2}}
downstream: {{n_experiments: 2, test_all: true}}
embedding_dim: 2
"""
    c = config.load(settings)
    run = train.train(spark, c, str(tmp_path))
    first, second = (train.tokens_of(c, run.data, e).collect() for e in (0, 1))
    assert first != second and len(first) == c.n_walks(run.data) == 72
    names = {(r.epoch, r.name) for r in train.scalars(spark, run.layout).collect()}
    assert {(e, "train-epoch/loss") for e in range(3)} <= names
    assert train.node_task(c, run).first().best >= 0.6 and 0 <= train.edge_task(c, run).first().mean <= 1
    with pytest.raises(FileExistsError):
        train.train(spark, c, str(tmp_path))
    c.train.max_epochs = 5
    more = train.train(spark, c, str(tmp_path), resume=True)
    assert more.trainer.epoch == 5 and more.trainer.state.t == 25 and {h["epoch"] for h in more.trainer.history} == {4}


def test_numbers_of_a_large_table(spark):
    df = spark.range(300_000).select(F.pmod(F.col("id") * 7919, F.lit(300_007)).alias("k"), F.concat(F.lit("some text that rides along "), "id").alias("text"))
    got = vocabulary.batches(df, ["k"], 64).cache()
    assert {(r["count"]) for r in got.groupBy("batch").count().where("batch < 4687").collect()} == {64}
    assert got.select("batch").distinct().count() == 4688


def test_negative_edges_of_dense_graphs(spark):
    nodes = [f"n{k:02d}" for k in range(12)]
    edges = [(a, b, None) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a, b) != ("n00", "n01")]
    arcs = graph.symmetric(spark.createDataFrame(edges, "src string, dst string, weight double"), False)
    rows = graph.negative_edges(arcs, 40, seed=2, tries=2, self_loops=False).collect()
    assert len(rows) == 40 and {(r.u, r.v) for r in rows} == {("n00", "n01"), ("n01", "n00")}
    assert graph.negative_edges(arcs, 40, seed=2, tries=2).count() == 40


def test_closest_pairs_text(spark, tmp_path):
    from vecloom.operators import similarity

    v = spark.createDataFrame([(0, "<unk>", 0), (1, "x", 5), (2, "y", 3)], "idx int, token string, freq long")
    m = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.6, 0.8])], "idx int, vec array<double>")
    pairs = similarity.closest_pairs(v, m, m, max_words=2, k=2)
    similarity.save_closest_pairs(pairs, str(tmp_path / "closest_pairs"))
    assert [r.value for r in spark.read.text(str(tmp_path / "closest_pairs")).collect()] == ['Closest pairs in format "{word}:{closest_word_pairs}"', "x: x, y", "y: y, x"]


def test_settings_that_name_classes():
    with pytest.raises(ValueError):
        config.instantiate({"_target_": "os.system", "command": "true"})
    made = config.instantiate({"opt": {"_target_": "vecloom.operators.sgns.Adam", "lr": 0.5}, "rest": [1, {"a": 2}]})
    assert made["opt"].lr == 0.5 and made["rest"] == [1, {"a": 2}]
    assert "  train:" in config.tree(config.load("")) and "    lr: 0.01" in config.tree(config.load(""))


def test_files(spark, tmp_path):
    (tmp_path / "wikitext-2").mkdir()
    (tmp_path / "wikitext-2" / "wiki.train.tokens").write_text("one line\n = Head = \n")
    (tmp_path / "Shakespeare_data.csv").write_text('Dataline,PlayerLine\n1,"So shaken, as we are"\n2,\n')
    (tmp_path / "cora").mkdir()
    (tmp_path / "cora" / "cora.cites").write_text("35\t1033\n1033\t35\n35\t103482\n")
    (tmp_path / "cora" / "cora.content").write_text("".join("\t".join([i, *["0"] * 1432, "1", s]) + "\n" for i, s in (("35", "Theory"), ("1033", "Theory"), ("103482", "Case_Based"))))
    a = str(tmp_path)
    assert [r.text for r in dataset(spark, "wiki-text-2", assets=a).collect()] == ["one line", " = Head = "]
    assert [r.text for r in dataset(spark, "shakespeare", assets=a).collect()] == ["So shaken, as we are"]
    g = dataset(spark, "graph_cora", assets=a)
    assert {(r.src, r.dst) for r in g.edges.collect()} == {("n1033", "n35"), ("n103482", "n35")}
    assert {r.node: (r.label, sum(r.feats)) for r in g.labels.join(g.features, "node").collect()} == {"n35": ("Theory", 1.0), "n1033": ("Theory", 1.0), "n103482": ("Case_Based", 1.0)}
    k = dataset(spark, "graph_karate_club")
    assert graph.is_weighted(k.edges) and k.edges.agg(F.count("*"), F.sum("weight")).first()[:] == (78, 231.0) and k.labels.groupBy("label").count().select("count").distinct().first()[0] == 17


def test_lemmas_by_map_and_by_join(spark, monkeypatch):
    df = spark.createDataFrame([(1, "The Of a"), (1, "the  x"), (2, None), (3, "")], "id int, text string")
    table = spark.createDataFrame([("the", "n", "a"), ("of", "v", "from"), ("a", "v", "one")], "form string, pos string, lemma string")
    want = [(1, "one from one"), (1, "one  x"), (2, None), (3, "")]
    run = lambda: sorted(map(tuple, text.lemmatize(df, table).collect()), key=str)
    assert run() == sorted(want, key=str)
    monkeypatch.setattr(text, "SENT_FORMS", 0)
    assert run() == sorted(want, key=str)


def test_closest_pairs_of_every_20th(spark, tmp_path):
    import numpy as np

    from vecloom.plans.registry import QUERIES

    x = np.random.default_rng(1).standard_normal((230, 8)).astype(np.float32)
    rows = [(k, [float(a) for a in v], 0) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["query"], r["rank"]): r["idx"] for r in QUERIES["q35_closest_pairs"](spark, str(tmp_path)).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = np.argsort(-(unit @ unit.T), axis=1, kind="stable")
    assert got == {(k, r + 1): near[k, r] for k in range(0, 230, 20) for r in range(5)}
