"""The analysis task from settings, and folders on Spark's file system."""

import numpy as np
import pytest

from vecloom.operators import storage
from vecloom.plans import analysis, config, train
from vecloom.sources import datasets

WORDS = ["king", "man", "woman", "queen", "rules", "walks"]


@pytest.fixture(scope="module")
def royal():
    @datasets.register_dataset("royal_words")
    def royal_words(spark):
        return datasets.sentences(spark, [" ".join(np.roll(WORDS, k)) for k in range(6)] * 3)

    yield "royal_words"
    datasets.REGISTRY.pop("royal_words")


SETTINGS = """
train: {{max_epochs: 2, steps_per_epoch: 2, lr: 0.1, experiment: one}}
data: {{dataset: {name}, context_radius: 1, is_graph: {graph}, walk_length: 4, walks_per_node: 3}}
analysis: {{closest_pairs: 2, max_words: 3, projection_words: {points}, projection: {method}, semantics: {semantics}}}
embedding_dim: {dims}
"""


@pytest.mark.parametrize("method, dims", [("tsne", 4), ("pca", 4), ("pca", 2)])
def test_text(spark, tmp_path, royal, method, dims):
    c = config.load(SETTINGS.format(name=royal, graph="false", points=5, method=method, semantics="true", dims=dims))
    run = train.train(spark, c, str(tmp_path))
    found = analysis.analyse(spark, c, str(tmp_path))
    lines = [r.value for r in found.closest.collect()]
    assert len(lines) == 4 and all(len(x.split(": ")[1].split(", ")) == 2 for x in lines[1:])
    points = found.projection.collect()
    assert [r.idx for r in sorted(points)] == [1, 2, 3, 4, 5] and all(np.isfinite([r.x, r.y]).all() for r in points)
    vec = {r.token: np.array(r.vec) for r in run.embeddings().where("side = 'input'").collect()}
    if dims == 2:
        assert all(np.allclose([r.x, r.y], vec[r.token]) for r in points)
    rows = found.semantics.collect()
    assert {(r.start, r.minus, r.plus, r.end) for r in rows} == set(analysis.SEMANTICS[:4])
    for r in rows:
        made = vec[r.start] - vec[r.minus] + vec[r.plus]
        assert abs(r.cosine - made @ vec[r.end] / np.linalg.norm(made) / np.linalg.norm(vec[r.end])) < 1e-9 and len(r.nearest.split(", ")) == 2
    assert (tmp_path / royal / "one" / "analysis" / "closest_pairs").is_dir()
    snapshots = list((tmp_path / royal / "one" / "run_history").glob("analysis_*.yaml"))
    assert len(snapshots) == 1 and config.load(snapshots[0].read_text()) == c


def test_graph_has_labels_and_no_analogies(spark, tmp_path):
    c = config.load(SETTINGS.format(name="graph_triplets", graph="true", points=0, method="pca", semantics="false", dims=2))
    train.train(spark, c, str(tmp_path))
    found = analysis.analyse(spark, c, str(tmp_path))
    assert found.projection is None and found.semantics is None and found.closest.count() == 4
    c.analysis.projection_words, c.analysis.closest_pairs = 20, 0
    found = analysis.analyse(spark, c, str(tmp_path))
    assert found.closest is None and all(r.label is not None for r in found.projection.collect())
    c.analysis.semantics = True
    with pytest.raises(ValueError):
        analysis.analyse(spark, c, str(tmp_path))


def test_folders(spark, tmp_path):
    path = f"file://{tmp_path}/a/b"
    assert not storage.exists(path)
    storage.make_folder(path)
    storage.write_text(f"{path}/x.txt", "one")
    storage.write_text(f"{path}/x.txt", "zwei ä")
    assert storage.exists(path) and (tmp_path / "a" / "b" / "x.txt").read_text("utf-8") == "zwei ä"
