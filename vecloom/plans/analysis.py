"""What a trained experiment has learnt, from settings: closest pairs, a projection and a test of analogies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import graph, similarity
from vecloom.operators.storage import load_embeddings
from vecloom.plans.config import Config, Layout
from vecloom.plans.train import vocabulary_of

#: start - minus + plus should be near end; the last is nonsense on purpose. Fixed values.
SEMANTICS = [
    ("king", "man", "woman", "queen"),
    ("queen", "woman", "man", "king"),
    ("king", "queen", "woman", "man"),
    ("queen", "king", "man", "woman"),
    ("uncle", "execute", "kiss", "saw"),
]


@dataclass
class Analysis:
    """The parts that the settings ask for; others are None."""

    closest: DataFrame | None = None
    projection: DataFrame | None = None
    semantics: DataFrame | None = None


def analyse(spark: SparkSession, config: Config, root: str) -> Analysis:
    """Reads the checkpoint that the settings name, writes closest_pairs (text), projected_embeddings and semantics (tables) to
    the experiment's analysis folder, and returns them as read back."""
    a = config.analysis
    if a.semantics and config.data.is_graph:
        raise ValueError("the test of analogies is for texts, not for graphs")
    layout = Layout(root, config.data.dataset, config.train.experiment).prepare("overwrite")
    layout.snapshot(config, "analysis")
    data = config.make_dataset(spark)
    vocab = vocabulary_of(config, data).cache()
    vectors = load_embeddings(spark, layout.checkpoints, a.checkpoint).select("side", "idx", "vec")
    if vectors.where("side = 'input'").count() != vocab.count():
        raise ValueError("the checkpoint is of another vocabulary")
    inputs, outputs = (vectors.where(F.col("side") == side).select("idx", "vec").join(vocab.select("idx", "token"), "idx") for side in ("input", "output"))
    out = Analysis()
    if a.closest_pairs:
        pairs = similarity.closest_pairs(vocab, inputs.drop("token"), outputs.drop("token"), a.max_words, a.closest_pairs)
        similarity.save_closest_pairs(pairs, f"{layout.analysis}/closest_pairs")
        out.closest = spark.read.text(f"{layout.analysis}/closest_pairs")
    if a.projection_words:
        labels = data.labels if isinstance(data, graph.Graph) and data.has_labels else None
        points = similarity.project(inputs, a.projection_words, a.skip_unk, labels, a.projection)
        out.projection = _kept(points, f"{layout.analysis}/projected_embeddings")
    if a.semantics:
        combos = spark.createDataFrame(SEMANTICS, "start string, minus string, plus string, end string")
        out.semantics = _kept(similarity.analogy(combos, inputs, outputs, a.closest_pairs or 5), f"{layout.analysis}/semantics")
    return out


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
