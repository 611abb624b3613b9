"""Metric meter and classification tasks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import rng
from vecloom.operators import classifiers, graph, splits
from vecloom.operators.meter import MetricMeter, UnknownMetricException  # noqa: F401
from vecloom.operators.storage import cut_lineage, drop, settled, written


def metric_means(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("name").agg(F.avg("value").alias("value"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double"))).first()[0]


def logistic(train: DataFrame, test: DataFrame, features: str = "feats", label: str = "label", c: float = 1.0, max_iter: int = 100):
    """(model, test with prediction): multinomial for more than two classes, unscaled, strength 1/c over the rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    vec = lambda d: d.withColumn("__v", array_to_vector(features))
    n = max(1, train.count())
    model = LogisticRegression(featuresCol="__v", labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter).fit(vec(train))
    return model, model.transform(vec(test)).drop("__v")


def node_rows(vectors: DataFrame, labels: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """node, feats, label (its index as double). vectors: node, vec without the unknown mark; labels: node, label."""
    if vectors.join(labels, "node", "left_anti").limit(1).count():
        raise ValueError("a node has no label")
    rows = vectors.join(labels, "node").withColumnRenamed("vec", "feats")
    if features is not None:
        rows = rows.join(features.withColumnRenamed("feats", "__f"), "node").withColumn("feats", F.concat("feats", "__f")).drop("__f")
    return rows.join(splits.label_index(rows, "label"), "label").select("node", "feats", F.col("idx").cast("double").alias("label"))


def node_folds(rows: DataFrame, experiment: int, train_ratio: float = 0.5, stratify: bool = True, test_all: bool = False) -> DataFrame:
    """rows with split, for one experiment."""
    return splits.train_test(rows, "node", train_ratio, seed=experiment, label="label" if stratify else None, test_all=test_all)


def all_node_folds(rows: DataFrame, experiments: int, train_ratio: float = 0.5, stratify: bool = True, test_all: bool = False) -> DataFrame:
    """rows with train and test: the experiments that each row is in, as node_folds() deals them, in one job."""
    n = rows.count()
    total = splits.test_size(n, train_ratio)
    flat = rows.select("node", "label").withColumn("experiment", F.explode(F.sequence(F.lit(0), F.lit(experiments - 1))))
    ranked = splits.ranks(flat, rng.bits(F.col("experiment"), F.col("node")), ["node"], ["experiment", "label"] if stratify else ["experiment"], n * experiments)
    if stratify:
        ranked = ranked.join(splits.allocation(rows, "label", total, n), "label")
    last = F.col("__r") <= (F.col("take") if stratify else F.lit(total))
    of = lambda x: F.coalesce(F.collect_list(F.when(x, F.col("experiment"))), F.array().cast("array<int>"))
    dealt = ranked.groupBy("node").agg(of(~last).alias("train"), of(F.lit(True) if test_all else last).alias("test"))
    return rows.join(dealt, "node")


def split_folds(rows: DataFrame, experiments: int, split, seed: int) -> DataFrame:
    """rows with train and test: the experiments that each row is in, by any split."""
    dealt = functools.reduce(DataFrame.unionByName, (split(rows, seed=seed + k).select("node", "split", F.lit(k).alias("k")) for k in range(experiments)))
    of = lambda x: F.coalesce(F.collect_list(F.when(F.col("split") == x, F.col("k"))), F.array().cast("array<int>")).alias(x)
    return rows.join(dealt.groupBy("node").agg(of("train"), of("test")), "node")


def node_classification(vectors: DataFrame, labels: DataFrame, features: DataFrame | None = None, train_ratio: float = 0.5, experiments: int = 10, stratify: bool = True, test_all: bool = False, c: float = 1.0, max_iter: int = 100, split=None, seed: int = 42) -> DataFrame:
    """experiment, accuracy: all experiments in one fit. split: a function (rows, seed=...) that adds `split`, called with
    seeds from `seed` on; its train rows train, its test rows test."""
    rows = cut_lineage(node_rows(vectors, labels, features))
    rows = written(all_node_folds(rows, experiments, train_ratio, stratify, test_all) if split is None else split_folds(rows, experiments, split, seed), "folds")
    classes, dims = rows.agg(F.max("label"), F.max(F.size("feats"))).first()
    out = classifiers.Fit(rows, experiments, int(classes) + 1, dims, c, max_iter).accuracies()
    drop(rows)
    return vectors.sparkSession.createDataFrame(list(enumerate(out)), "experiment int, accuracy double")


def edge_rows(edges: DataFrame, arcs: DataFrame | None, experiment: int, train_ratio: float = 0.5, mode: str = "reference", others: graph.NonEdges | None = None) -> DataFrame:
    """u, v, train, label: edges (1) and drawn non-edges (0), round(train_ratio * edges) of either for training. mode
    'reference' draws as many non-edges again as there are edges, 'holdout' twice the edges in all. others: non-edges of arcs, where several
    experiments draw from them."""
    n = edges.count()
    m = round(train_ratio * n)
    marked = graph.train_edges(edges, train_ratio, seed=experiment)
    # one draw of non-edges, the first m for training
    neg = (others or graph.NonEdges(arcs)).drawn(2 * n if mode == "holdout" else n + m, seed=experiment)
    pos = marked.select(F.col("src").alias("u"), F.col("dst").alias("v"), "train", F.lit(1.0).alias("label"))
    return pos.unionByName(neg.select("u", "v", (F.col("sample") < m).alias("train"), F.lit(0.0).alias("label")))


def edge_classification(edges: DataFrame, vectors: DataFrame, operator: str = "hadamard", train_ratio: float = 0.5, experiments: int = 10, mode: str = "reference", c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """experiment, accuracy of telling edges from drawn non-edges, all experiments in one fit. mode 'reference' scores all
    edges, those of training too; 'holdout' the others alone."""
    others, parts = graph.NonEdges(graph.symmetric(edges, False)), []

    def part(k: int) -> DataFrame:
        rows = graph.edge_embeddings(edge_rows(edges, None, k, train_ratio, mode, others), vectors, operator)
        one, none = F.array(F.lit(k)), F.array().cast("array<int>")
        test = ~F.col("train") if mode == "holdout" else (F.col("label") == 1) | ~F.col("train")
        return rows.select(F.col("emb").alias("feats"), "label", F.when(F.col("train"), one).otherwise(none).alias("train"), F.when(test, one).otherwise(none).alias("test"))

    for k in range(experiments):
        # an experiment's draws go once its rows are written
        parts.append(settled(lambda: part(k), "edges"))  # noqa: B023
    drop(others.pairs, others.order, others.open)
    rows = functools.reduce(DataFrame.unionByName, parts)
    dims = rows.agg(F.max(F.size("feats"))).first()[0]
    out = classifiers.Fit(rows, experiments, 2, dims, c, max_iter).accuracies()
    drop(*parts)
    return edges.sparkSession.createDataFrame(list(enumerate(out)), "experiment int, accuracy double")


def summary(runs: DataFrame) -> DataFrame:
    """mean, best and the last experiment that reached it."""
    best = F.max(F.struct("accuracy", "experiment"))
    return runs.agg(F.avg("accuracy").alias("mean"), best.alias("b")).select("mean", F.col("b.accuracy").alias("best"), F.col("b.experiment").alias("experiment"))
