"""Experiment settings, their YAML form and the folders of an experiment."""

from __future__ import annotations

import dataclasses
import datetime as dt
import functools
import importlib
import os
import warnings
from dataclasses import dataclass, field

import yaml
from pyspark.sql import functions as F

from vecloom.functions import rng, text
from vecloom.functions.vectors import edge_operator
from vecloom.operators import graph, sgns, sharded, splits, vocabulary
from vecloom.operators.local_steps import LocalTrainer
from vecloom.operators.storage import cut_lineage, exists, make_folder, write_text
from vecloom.sources.datasets import dataset


@dataclass
class TrainConfig:
    max_epochs: int = 5
    steps_per_epoch: int = 4
    lr: float = 0.01
    gamma: float = 1.0
    step_size: int = 1
    optimizer: str = "adam"
    interval: str = "epoch"
    #: Tasks that take local steps between averages, and how many each; one task takes exact steps.
    local_tasks: int = 1
    local_steps: int = 16
    experiment: str = "default"


@dataclass
class LossConfig:
    negatives: int = 1


@dataclass
class DataConfig:
    dataset: str = "abcde"
    mode: str = "sg"
    context_radius: int = 2
    max_length: int = 0
    #: Sentences (or walks) of a step; 0 deals examples into steps_per_epoch shares.
    batch_size: int = 0
    min_word_frequency: int = 1
    is_graph: bool = False
    walk: str = "deepwalk"
    walk_length: int = 16
    walks_per_node: int = 10
    p: float = 1.0
    q: float = 1.0
    replicas: int = 1
    options: dict = field(default_factory=dict)


@dataclass
class AnalysisConfig:
    closest_pairs: int = 5
    max_words: int = 100
    skip_unk: bool = True
    checkpoint: str = "last"
    projection: str = "tsne"
    projection_words: int = 250
    semantics: bool = False


@dataclass
class DownstreamConfig:
    checkpoint: str = "last"
    operator: str = "hadamard"
    train_ratio: float = 0.5
    n_experiments: int = 10
    test_all: bool = False
    c: float = 1.0
    max_iter: int = 100
    stratify: bool = True
    seed: int = 42
    split: str = "train_test"
    split_options: dict = field(default_factory=dict)


@dataclass
class Config:
    train: TrainConfig = field(default_factory=TrainConfig)
    loss: LossConfig = field(default_factory=LossConfig)
    data: DataConfig = field(default_factory=DataConfig)
    analysis: AnalysisConfig = field(default_factory=AnalysisConfig)
    downstream: DownstreamConfig = field(default_factory=DownstreamConfig)
    embedding_dim: int = 8
    max_norm: float | None = None

    def make_dataset(self, spark):
        """Sentences or a graph, whichever the settings say the data set is."""
        found = dataset(spark, self.data.dataset, **self.data.options)
        if isinstance(found, graph.Graph) != self.data.is_graph:
            raise ValueError(f"data set {self.data.dataset!r} is{'' if self.data.is_graph else ' not'} set as a graph (is_graph)")
        if self.data.is_graph and self.data.min_word_frequency > 1:
            warnings.warn("min_word_frequency has no effect on a graph: each node counts once", stacklevel=2)
        return found

    def make_walks(self, arcs, epoch: int = 0):
        """Walks of an epoch: `replicas` times walks_per_node from each node, other ones each epoch."""
        f, extra = graph.walk_generator(self.data.walk), {}
        if f is graph.node2vec:
            extra = {"p": self.data.p, "q": self.data.q}
        return f(arcs, self.data.walk_length, self.data.walks_per_node * self.data.replicas, epoch=epoch, **extra)

    def n_walks(self, g) -> int:
        """Walks of an epoch."""
        return g.nodes.count() * self.data.walks_per_node * self.data.replicas

    def make_examples(self, tokens, vocab, epoch: int | None = None):
        """Training examples of token sentences: windows by mode, radius and length, in batches where batch_size is set. Batches take
        sentences in the order they are read, or, with an epoch, in one that the epoch draws."""
        d = self.data
        fit = text.clip("tokens", d.max_length or None, d.context_radius)
        rows = tokens.where(text.long_enough("tokens", d.context_radius)).select(F.monotonically_increasing_id().alias("id"), fit.alias("tokens"))
        ids = vocabulary.encode(cut_lineage(rows), vocab, "id")
        if not d.batch_size:
            return vocabulary.examples(ids, d.context_radius, d.mode)
        if epoch is not None:
            ids = ids.withColumn("drawn", rng.bits(epoch, F.col("id")))
        return vocabulary.batch_examples(ids, ["id"] if epoch is None else ["drawn", "id"], d.batch_size, d.context_radius, d.mode)

    def make_trainer(self, vocab: int) -> sgns.Trainer:
        """Matrices that are too large to go out whole are trained in shards."""
        t = self.train
        kind = sgns.Trainer if vocab * self.embedding_dim * 16 <= sgns.Trainer.SENT else sharded.ShardedTrainer
        if t.local_tasks > 1:
            if not self.data.batch_size or kind is sharded.ShardedTrainer:
                raise ValueError("local steps need a batch_size, and matrices that a task can hold")
            kind = functools.partial(LocalTrainer, tasks=t.local_tasks, local_steps=t.local_steps)
        return kind(vocab, self.embedding_dim, t.lr, self.loss.negatives, t.max_epochs, t.steps_per_epoch, gamma=t.gamma, step_size=t.step_size, max_norm=self.max_norm, optimizer=t.optimizer, interval=t.interval)

    def make_split(self):
        """A function (rows, key, seed) by name, with the settings' parameters."""
        d = self.downstream
        if d.split not in splits.SPLITS:
            raise ValueError(f"split {d.split!r}: one of {sorted(splits.SPLITS)}")
        return functools.partial(splits.SPLITS[d.split], **(d.split_options or ({"train_ratio": d.train_ratio, "test_all": d.test_all} if d.split == "train_test" else {})))

    def make_edge_operator(self):
        return edge_operator(self.downstream.operator)


def _build(kind, raw: dict):
    known = {f.name: f for f in dataclasses.fields(kind)}
    if extra := set(raw) - set(known):
        raise ValueError(f"{kind.__name__} has no {sorted(extra)}")
    out = {}
    for name, value in raw.items():
        default = known[name].default_factory() if known[name].default_factory is not dataclasses.MISSING else known[name].default
        if dataclasses.is_dataclass(default):
            value = _build(type(default), value or {})
        elif isinstance(default, float) or "float" in str(known[name].type):
            value = None if value is None else float(value)  # YAML reads 1e-3 as text
        elif isinstance(default, int) and not isinstance(default, bool):
            value = int(value)
        out[name] = value
    return kind(**out)


def load(source: str) -> Config:
    return _build(Config, yaml.safe_load(source) or {})


#: Packages whose names settings may call; add one's own with allow_targets().
TARGETS = ["vecloom"]


def allow_targets(package: str) -> None:
    """Lets settings call names of a package."""
    if package not in TARGETS:
        TARGETS.append(package)


def instantiate(spec):
    """Nested settings with `_target_: module.name` become what calling that name with the others gives; the module has to
    lie in one of TARGETS."""
    if isinstance(spec, list):
        return [instantiate(x) for x in spec]
    if not isinstance(spec, dict):
        return spec
    made = {k: instantiate(v) for k, v in spec.items() if k != "_target_"}
    if "_target_" not in spec:
        return made
    module, _, name = spec["_target_"].rpartition(".")
    if not any(module == t or module.startswith(f"{t}.") for t in TARGETS):
        raise ValueError(f"{spec['_target_']!r} is in none of {TARGETS}; see allow_targets()")
    return getattr(importlib.import_module(module), name)(**made)


def tree(config, name: str = "config") -> str:
    """The settings as indented lines."""
    lines = [name]

    def add(value, depth):
        for key, x in value.items():
            lines.append("  " * depth + (f"{key}:" if isinstance(x, dict) and x else f"{key}: {x}"))
            if isinstance(x, dict):
                add(x, depth + 1)

    add(dataclasses.asdict(config), 1)
    return "\n".join(lines)


def dump(config: Config) -> str:
    return yaml.safe_dump(dataclasses.asdict(config), sort_keys=False)


@dataclass
class Layout:
    """Folders of an experiment."""

    root: str
    dataset: str
    experiment: str

    @property
    def base(self) -> str:
        return os.path.join(self.root, self.dataset, self.experiment)

    @property
    def checkpoints(self) -> str:
        return os.path.join(self.base, "checkpoints")

    @property
    def history(self) -> str:
        return os.path.join(self.base, "run_history")

    @property
    def analysis(self) -> str:
        return os.path.join(self.base, "analysis")

    @property
    def metrics(self) -> str:
        return os.path.join(self.root, "metrics", self.dataset, self.experiment)

    def prepare(self, mode: str = "error") -> "Layout":
        """mode 'error' refuses an experiment that is there; 'overwrite' goes on over it."""
        if mode not in ("error", "overwrite"):
            raise ValueError(f"mode {mode!r}")
        if mode == "error" and exists(self.base):
            raise FileExistsError(self.base)
        for d in (self.checkpoints, self.history, self.analysis):
            make_folder(d)
        return self

    def snapshot(self, config: Config, task: str = "train") -> str:
        path = os.path.join(self.history, f"{task}_{dt.datetime.now():%Y%m%d_%H%M%S}.yaml")
        write_text(path, dump(config))
        return path
