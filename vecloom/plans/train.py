"""Training and downstream tasks from settings, end to end.

A text's sentences or a graph's walks become tokens, a vocabulary and windows; a trainer fits both matrices.
A graph's walks are drawn anew each epoch. After each epoch a checkpoint and the metrics
(epoch, step, name, value) are written to the experiment's folders, through Spark, so that any file system will do.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import text
from vecloom.operators import graph, metrics, sgns, vocabulary
from vecloom.operators.storage import load_embeddings, save_embeddings
from vecloom.plans.config import Config, Layout


@dataclass
class Run:
    """What training gives."""

    trainer: sgns.Trainer
    vocab: DataFrame
    layout: Layout
    data: object

    def embeddings(self) -> DataFrame:
        return self.trainer.embeddings(self.vocab)


def tokens_of(config: Config, data, epoch: int) -> DataFrame:
    """tokens of the sentences, or of this epoch's walks, which are read as sentences."""
    if isinstance(data, graph.Graph):
        return graph.walk_sentences(config.make_walks(data.neighbours(), epoch)).select(text.tokenize("text").alias("tokens"))
    return data.select(text.tokenize("text").alias("tokens"))


def vocabulary_of(config: Config, data) -> DataFrame:
    if isinstance(data, graph.Graph):
        return vocabulary.build_vocab(data.nodes.select(text.tokenize("node").alias("tokens")), 0, by_frequency=False)
    return vocabulary.build_vocab(data.select(text.tokenize("text").alias("tokens")), config.data.min_word_frequency)


def train(spark: SparkSession, config: Config, root: str, mode: str = "error", resume: bool = False) -> Run:
    """mode: what to do if the experiment is there already ('error' or 'overwrite'). resume: go on from its last checkpoint."""
    layout = Layout(root, config.data.dataset, config.train.experiment).prepare("overwrite" if resume else mode)
    layout.snapshot(config, "train")
    data = config.make_dataset(spark)
    vocab = vocabulary_of(config, data).cache()
    trainer = config.make_trainer(vocab.count())
    if resume:
        trainer.resume(load_embeddings(spark, layout.checkpoints))
    if isinstance(data, graph.Graph):
        examples = lambda epoch: config.make_examples(tokens_of(config, data, epoch), vocab, epoch)
    else:
        examples = config.make_examples(tokens_of(config, data, 0), vocab).cache()

    def after(t):
        save_embeddings(t.checkpoint(spark), layout.checkpoints, t.epoch, t.state.t)
        t.metrics(spark).where(F.col("epoch") == t.epoch - 1).coalesce(1).write.mode("overwrite").parquet(f"{layout.metrics}/epoch={t.epoch - 1:06d}")

    trainer.fit(examples, after)
    return Run(trainer, vocab, layout, data)


def scalars(spark: SparkSession, layout: Layout) -> DataFrame:
    """epoch, step, name, value of all epochs of an experiment."""
    return spark.read.parquet(f"{layout.metrics}/epoch=*")


def node_task(config: Config, run: Run) -> DataFrame:
    """mean, best and experiment of classifying the nodes of a trained graph."""
    d = config.downstream
    vectors = run.embeddings().where("side = 'input' AND idx <> 0").select(F.col("token").alias("node"), "vec")
    features = run.data.features if run.data.has_features else None
    # another split than the stratified one in two is dealt with seeds from downstream.seed on
    split = functools.partial(config.make_split(), key="node") if d.split != "train_test" or d.split_options else None
    return metrics.summary(metrics.node_classification(vectors, run.data.labels, features, d.train_ratio, d.n_experiments, d.stratify, d.test_all, d.c, d.max_iter, split, d.seed))


def edge_task(config: Config, run: Run) -> DataFrame:
    """mean, best and experiment of telling edges of a trained graph from non-edges."""
    d = config.downstream
    vectors = run.embeddings().where("side = 'input' AND idx <> 0").select(F.col("token").alias("node"), "vec")
    return metrics.summary(metrics.edge_classification(run.data.edges, vectors, d.operator, d.train_ratio, d.n_experiments, c=d.c, max_iter=d.max_iter))
