"""Skip-gram and CBOW with negative sampling: initial vectors, logits, noise, loss, training."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from vecloom.functions import rng
from vecloom.functions.vectors import dot, mean_vector, sigmoid
from vecloom.operators.meter import MetricMeter
from vecloom.operators.storage import cut_lineage, drop, ship, written
from vecloom.operators.vocabulary import numbered

FLOOR = 1e-6


def xavier_bound(rows: int, dims: int) -> float:
    return (6.0 / (rows + dims)) ** 0.5


def xavier(spark, rows: int, dims: int, seed: int = 0, side: str = "input") -> DataFrame:
    """side, idx, vec: uniform within the bound."""
    b = xavier_bound(rows, dims)
    draw = lambda k: F.lit(-b) + rng.uniform(seed, F.lit(side), F.col("idx"), k) * F.lit(2 * b)
    return spark.range(rows).select(F.lit(side).alias("side"), F.col("id").cast("int").alias("idx")).withColumn("vec", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), draw))


def noise(spark, batch: int, targets: int, negatives: int, vocab: int, seed: int = 0) -> DataFrame:
    """sample, pos, k, neg: uniform indices in [0, vocab)."""
    cell = spark.range(batch * targets * negatives)
    cols = cell.select(F.floor(F.col("id") / (targets * negatives)).cast("long").alias("sample"), F.floor(F.pmod("id", F.lit(targets * negatives)) / negatives).cast("int").alias("pos"), F.pmod("id", F.lit(negatives)).cast("int").alias("k"))
    return cols.withColumn("neg", rng.integer(vocab, seed, F.col("sample"), F.col("pos"), F.col("k")))


def skipgram_logits(pairs: DataFrame, inputs: DataFrame, outputs: DataFrame, proba: bool = False) -> DataFrame:
    """pairs (center, ctx, ...) with logit."""
    a, b = inputs.select(F.col("idx").alias("center"), F.col("vec").alias("__a")), outputs.select(F.col("idx").alias("ctx"), F.col("vec").alias("__b"))
    logit = dot("__a", "__b")
    return pairs.join(a, "center").join(b, "ctx").withColumn("logit", sigmoid(logit) if proba else logit).drop("__a", "__b")


def cbow_logits(rows: DataFrame, key: str, inputs: DataFrame, outputs: DataFrame, proba: bool = False) -> DataFrame:
    """rows (key, context array, target): the mean of context vectors against the target's."""
    flat = rows.select(key, "target", F.posexplode("context").alias("at", "idx")).join(inputs.select("idx", "vec"), "idx")
    means = flat.groupBy(key, "target").agg(mean_vector(F.transform(F.array_sort(F.collect_list(F.struct("at", "vec"))), lambda x: x["vec"])).alias("__m"))
    logit = dot("__m", "__b")
    return means.join(outputs.select(F.col("idx").alias("target"), F.col("vec").alias("__b")), "target").withColumn("logit", sigmoid(logit) if proba else logit).drop("__m", "__b")


def log_sigmoid(x):
    """-log of the sigmoid, which is at least FLOOR."""
    return -F.ln(F.greatest(sigmoid(x), F.lit(FLOOR)))


def loss(scores: DataFrame) -> DataFrame:
    """scores: pos double, neg array<double>. One row: loss, positive_loss, negative_loss, recall, precision."""
    neg = F.aggregate("neg", F.lit(0.0), lambda s, x: s + log_sigmoid(-x))
    rows = scores.select(log_sigmoid(F.col("pos")).alias("p"), neg.alias("n"), (sigmoid("pos") >= 0.5).cast("double").alias("hit"), F.aggregate("neg", F.lit(0.0), lambda s, x: s + (sigmoid(x) >= 0.5).cast("double")).alias("miss"), F.size("neg").alias("k"))
    return rows.agg(F.avg(F.col("p") + F.col("n")).alias("loss"), F.avg("p").alias("positive_loss"), F.avg("n").alias("negative_loss"), F.avg("hit").alias("recall"), (1 - F.sum("miss") / F.sum("k")).alias("precision"))


def input_gradient(pairs: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Positive part of the gradient of the mean loss by input vectors: idx, at, grad. pairs: center, ctx, n."""
    total = pairs.agg(F.sum("n").cast("double").alias("total"))
    a, b = inputs.select(F.col("idx").alias("center"), F.col("vec").alias("x")), outputs.select(F.col("idx").alias("ctx"), F.col("vec").alias("y"))
    rows = pairs.join(a, "center").join(b, "ctx").withColumn("s", sigmoid(dot("x", "y"))).withColumn("c", F.when(F.col("s") > FLOOR, (F.col("s") - 1) * F.col("n")).otherwise(0.0))
    parts = rows.select("center", "c", F.posexplode("y").alias("at", "y")).groupBy(F.col("center").alias("idx"), "at").agg(F.sum(F.col("c") * F.col("y")).alias("g"))
    return parts.crossJoin(F.broadcast(total)).select("idx", "at", (F.col("g") / F.col("total")).alias("grad"))


def step_lr(lr: float, step_size: int, gamma: float, epoch: int) -> float:
    return lr * gamma ** (epoch // step_size)


def step_lr_column(lr: float, step_size: int, gamma: float, epoch):
    """step_lr() of a column of epochs."""
    return F.lit(lr) * F.pow(F.lit(gamma), F.floor(epoch / step_size))


@dataclass
class Adam:
    """Dense Adam; rows without gradient still move."""

    lr: float = 1e-3
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    t: int = 0
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = self.beta1 * self.m.get(k, 0.0) + (1 - self.beta1) * g
            v = self.v[k] = self.beta2 * self.v.get(k, 0.0) + (1 - self.beta2) * g * g
            params[k] = params[k] - self.lr * (m / (1 - self.beta1**self.t)) / (np.sqrt(v / (1 - self.beta2**self.t)) + self.eps)


@dataclass
class SGD:
    """Plain gradient steps."""

    lr: float = 1e-2
    t: int = 0
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            params[k] = params[k] - self.lr * g


OPTIMIZERS = {"adam": Adam, "sgd": SGD}


def _key():
    return F.array_join(F.col("inputs").cast("array<string>"), "-")


#: Occurrences of an example in one row, so that no row's noise grows with the corpus.
OCCURRENCES = 1024


def with_noise(examples: DataFrame, negatives: int, vocab: int, seed: int, step, kind: str = "int", keep: tuple = ()) -> DataFrame:
    """examples (inputs array<int>, target int, n long) as inputs, target, piece, n, neg: each of the n occurrences draws
    `negatives` indices of its own, by a counter hash. step: a number or a column of numbers. keep: columns that stay. An example of more than OCCURRENCES comes in several
    pieces, whose draws count on."""
    pieces = examples.select(*keep, "inputs", "target", F.col("n").alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / OCCURRENCES))).alias("piece"))
    first = F.col("piece") * OCCURRENCES
    pieces = pieces.withColumn("n", F.least(F.col("__n") - first, F.lit(OCCURRENCES).cast("long"))).withColumn("__k", first * negatives)
    draw = lambda k: rng.integer(vocab, seed, step if isinstance(step, Column) else F.lit(step), _key(), F.col("target"), F.col("__k") + k).cast(kind)
    return pieces.withColumn("neg", F.transform(F.sequence(F.lit(0), (F.col("n") * negatives - 1).cast("int")), draw)).drop("__n", "__k")


class NoiseTable:
    """Draws of indices by weight. The weights' sum is cut into as many equal cells as there are indices; a cell lists
    the indices whose shares of the sum reach into it. A draw falls on each cell alike, however uneven the
    weights, and looks its index up there."""

    def __init__(self, weights: DataFrame):
        """weights: idx int, weight double; indices of no weight are never drawn."""
        rows = numbered(weights.where("weight > 0").select(F.col("idx").alias("word"), F.col("weight").cast("double").alias("weight")), [F.col("word")])
        # whole numbers of some 100 bits for the sum: running sums of these are exact, whatever the order and the number of words
        about = rows.agg(F.sum("weight")).first()[0]
        scale = 2.0 ** min(1000, 100 - math.frexp(about or 1.0)[1])
        rows = rows.withColumn("whole", (F.col("weight") * scale).cast("decimal(38,0)"))
        # running sums within ranges of places, then over the ranges' totals
        rows = rows.withColumn("range", F.floor(F.col("idx") / RANGE))
        sums = rows.groupBy("range").agg(F.sum("whole").alias("w"))
        base = sums.select("range", F.coalesce(F.sum("w").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("decimal(38,0)")).alias("base"))
        end = F.col("base") + F.sum("whole").over(W.partitionBy("range").orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
        run = rows.join(base, "range").withColumn("end", end)
        run = cut_lineage(run.select("word", (F.col("end").cast("double") / scale).alias("hi"), ((F.col("end") - F.col("whole")).cast("double") / scale).alias("lo")))
        self.total, n = run.agg(F.max("hi"), F.count("*")).first()
        if not n:
            raise ValueError("no index has a weight")
        self.run, self.width, self.sent = run, self.total / n, n <= SENT_WEIGHTS

    @functools.cached_property
    def cells(self) -> DataFrame:
        cell = lambda x: F.floor(x / self.width).cast("long")
        cells = self.run.select("word", "hi", F.explode(F.sequence(cell(F.greatest("lo", F.lit(0.0))), cell(F.col("hi")))).alias("cell"))
        return cut_lineage(cells.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("hi", "word"))).alias("__x")))

    @functools.cached_property
    def _ends(self):
        """The ends of the shares in order and their indices, on every executor."""
        t = self.run.select("hi", "word").toArrow()
        order = np.argsort(t["hi"].to_numpy(), kind="stable")
        return ship(self.run.sparkSession).sparkContext.broadcast((t["hi"].to_numpy()[order], t["word"].combine_chunks().take(pa.array(order))))

    def looked_up(self, df: DataFrame, lists: str) -> DataFrame:
        """df with a list of bits (of rng.SPAN) turned into the indices that they draw. Rows stay whole, so nothing is shuffled."""
        sent, total, at = self._ends, self.total, df.columns.index(lists)

        def run(batches):
            ends, words = sent.value
            for b in batches:
                x = b.column(at)
                places = np.searchsorted(ends, x.flatten().to_numpy() / float(rng.SPAN) * total, side="right")
                cuts = pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy())]).astype(np.int32))
                yield pa.record_batch([*b.columns[:at], pa.ListArray.from_arrays(cuts, words.take(pa.array(places))), *b.columns[at + 1 :]], b.schema.names)

        return df.mapInArrow(run, StructType([StructField(f.name, ArrayType(self.run.schema["word"].dataType)) if f.name == lists else f for f in df.schema]))

    def drawn(self, df: DataFrame, u) -> DataFrame:
        """df with neg: the index at a share u of the sum, u uniform in [0, 1)."""
        at = df.withColumn("__p", u * F.lit(self.total)).withColumn("cell", F.floor(F.col("__p") / self.width).cast("long"))
        found = at.join(self.cells, "cell").withColumn("neg", F.filter("__x", lambda x: x["hi"] > F.col("__p"))[0]["word"])
        return found.drop("cell", "__x", "__p")


#: A table of at most this many weights is sent to every executor.
SENT_WEIGHTS = 4_000_000
#: Places in one range of running sums.
RANGE = 1 << 16


def word_weights(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """idx, weight: frequencies to a power, as for uni-gram noise."""
    return vocab.select("idx", F.pow(F.col("freq").cast("double"), F.lit(power)).alias("weight"))


def with_weighted_noise(examples: DataFrame, negatives: int, table: NoiseTable, seed: int, step, keep: tuple = ()) -> DataFrame:
    """with_noise() by a table's weights. Draws stay in their rows where the table can be sent; only those by a larger one meet it in a join."""
    plain = with_noise(examples, negatives, rng.SPAN, seed, step, "long", keep)
    if table.sent:
        return table.looked_up(plain.select(*keep, "inputs", "target", "piece", "n", "neg"), "neg")
    flat = plain.select(*keep, "inputs", "target", "piece", "n", F.posexplode("neg").alias("k", "bits"))
    met = table.drawn(flat, F.col("bits") / F.lit(float(rng.SPAN)))
    return met.groupBy(*keep, "inputs", "target", "piece", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "neg"))), lambda x: x["neg"]).alias("neg"))


#: Bytes of the means and gradients of one block of examples, which a task holds.
BLOCK_BYTES = 256 << 20
#: Pairs of an example and an output that are worked out at a time.
PAIRS = 1 << 16


def _sums_of(keys: np.ndarray, rows: np.ndarray):
    """Distinct keys in order and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(rows[order], first)


class _Block:
    """The examples of one block: their means first, then outputs with the examples that meet them."""

    def __init__(self):
        self.parts, self.ids = [], None

    def means(self, t) -> None:
        h = t.column(4)
        self.parts.append((t.column(2).to_numpy(), h.flatten().to_numpy().reshape(t.num_rows, -1), pc.list_value_length(t.column(3)).to_numpy(), t.column(3).flatten().to_numpy()))

    def _ready(self) -> None:
        if self.ids is not None:
            return
        ids, h, width, flat = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.parts = []
        self.order = np.argsort(ids)
        self.ids, self.h, self.width, self.flat = ids[self.order], h, width, flat
        self.grad, self.met = np.zeros_like(h), np.zeros(len(ids), bool)

    def outputs(self, t):
        """idx and gradient of outputs by the examples of this block."""
        self._ready()
        if not len(self.ids):
            return None
        none = t.column(4).is_null().to_numpy(zero_copy_only=False)
        o = np.zeros((t.num_rows, self.h.shape[1]))
        o[~none] = t.column(4).flatten().to_numpy().reshape(-1, o.shape[1])
        of = np.repeat(np.arange(t.num_rows), pc.list_value_length(t.column(5)).to_numpy())
        asked, weight = t.column(5).flatten().to_numpy(), t.column(6).flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.ids, asked), len(self.ids) - 1)
        known = self.ids[at] == asked
        at, of, weight = self.order[at[known]], of[known], weight[known]
        out, hit = np.zeros_like(o), np.zeros(len(o), bool)
        for k in range(0, len(at), PAIRS):
            a, b, w = at[k : k + PAIRS], of[k : k + PAIRS], weight[k : k + PAIRS]
            h, y = self.h[a], o[b]
            sign = np.where(w > 0, 1.0, -1.0)
            p = 1 / (1 + np.exp(-np.clip(sign * np.einsum("ij,ij->i", h, y), -700, 700)))
            # an output without a vector has gradient 0 and moves no input
            c = np.where((p > FLOOR) & ~none[b], (p - 1) * w, 0.0)[:, None]
            rows, g = _sums_of(b, c * h)
            out[rows] += g
            hit[rows] = True
            rows, g = _sums_of(a, c * y)
            self.grad[rows] += g
            self.met[a[~none[b]]] = True
        return t.column(2).to_numpy()[hit], out[hit]

    def inputs(self):
        """idx and gradient of inputs, once each."""
        self._ready()
        of = np.repeat(np.arange(len(self.width)), self.width)
        order = np.argsort(self.flat, kind="stable")
        order = order[self.met[of[order]]]
        keys = self.flat[order]
        ends = np.r_[np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)] if len(keys) else []
        at = 0
        while at < len(keys):
            # whole keys, some PAIRS of rows at a time
            end = int(ends[min(np.searchsorted(ends, at + PAIRS), len(ends) - 1)])
            mine = of[order[at:end]]
            yield _sums_of(keys[at:end], self.grad[mine] / self.width[mine, None])
            at = end


def _block_gradients(batches):
    """Rows of blocks, each with kind 0 (means) before kind 1 (outputs), as side, idx, g."""

    def rows(side, idx, g):
        ends = np.arange(len(g) + 1, dtype=np.int32) * g.shape[1]
        return pa.record_batch([pa.array([side] * len(g)), pa.array(idx.astype(np.int32)), pa.ListArray.from_arrays(ends, g.reshape(-1))], ["side", "idx", "g"])

    block, number = None, None
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
        for lo, hi in zip(cuts, cuts[1:]):
            t, (mine, kind) = b.slice(lo, hi - lo), divmod(int(part[lo]), 2)
            if mine != number:
                if block is not None:
                    for idx, g in block.inputs():
                        yield rows("input", idx, g)
                block, number = _Block(), mine
            if kind == 0:
                block.means(t)
            elif (got := block.outputs(t)) is not None and len(got[0]):
                yield rows("output", *got)
    if block is not None:
        for idx, g in block.inputs():
            yield rows("input", idx, g)


def gradients(examples: DataFrame, inputs: DataFrame, outputs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """side, idx, at, grad: the gradient of the mean loss by both matrices, so that neither has to fit a
    machine. examples: as with_noise() gives them. Skip-gram has one input, CBOW the mean of several.

    Examples lie in blocks of bounded size. An output goes once to each block that has an example with it, however many these are, and one
    sum of gradients comes back from there; so vectors travel by blocks and not by draws, and never more often than by draws."""
    spark = ship(examples.sparkSession)
    total, count = examples.agg(F.sum("n").cast("double"), F.count("*")).first()
    dims = inputs.select(F.max(F.size("vec"))).first()[0] or 1
    blocks = max(1, -(-count * dims * 16 // block_bytes))
    keyed = examples.withColumn("id", F.xxhash64(_key(), "target", "piece")).withColumn("block", F.pmod("id", F.lit(blocks)).cast("int"))
    vec = F.when(~F.exists("vec", lambda x: x.isNull()), F.col("vec").cast("array<double>")).alias("vec")
    flat = keyed.select("id", "block", "inputs", F.posexplode("inputs").alias("k", "idx")).join(inputs.select("idx", vec).where("vec IS NOT NULL"), "idx")
    mean = mean_vector(F.transform(F.array_sort(F.collect_list(F.struct("k", "vec"))), lambda x: x["vec"]))
    means = flat.groupBy("id").agg(F.first("block").alias("block"), F.first("inputs").alias("inputs"), mean.alias("vec"))
    # a weight over 0: so many occurrences of the target; under 0: so many draws as noise
    drawn = F.concat(F.array(F.struct(F.col("target").cast("int").alias("idx"), F.col("n").cast("double").alias("w"))), F.transform("neg", lambda x: F.struct(x.cast("int").alias("idx"), F.lit(-1.0).alias("w"))))
    met = keyed.select("id", "block", F.explode(drawn).alias("t")).groupBy(F.col("t.idx").alias("idx"), "block").agg(F.collect_list(F.struct("id", "t.w")).alias("x"))
    met = met.join(outputs.select("idx", vec), "idx")
    sides = means.select("block", F.lit(0).alias("kind"), "id", F.col("inputs").cast("array<int>").alias("inputs"), "vec", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<double>").alias("weights"))
    sides = sides.unionByName(met.select("block", F.lit(1).alias("kind"), F.col("idx").cast("long").alias("id"), F.lit(None).cast("array<int>").alias("inputs"), "vec", F.col("x.id").alias("ids"), F.col("x.w").alias("weights")))
    parts = sides.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind").mapInArrow(_block_gradients, "side string, idx int, g array<double>")
    # at most one row from each block
    g = F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), F.get("x", F.lit(0)), lambda s, y: F.zip_with(s, y, lambda a, b: a + b))
    sums = parts.groupBy("side", "idx").agg(F.collect_list("g").alias("x")).select("side", "idx", g.alias("g"))
    return sums.select("side", "idx", F.posexplode("g").alias("at", "grad")).withColumn("grad", F.col("grad") / F.lit(total))


def batch_gradient(t, x: np.ndarray, y: np.ndarray, grads: list) -> np.ndarray:
    """Adds the gradients of the summed loss by both matrices to grads; the sums that step_means() takes. t: a record batch
    of inputs, target, n, neg."""
    flat = t.column(0).flatten().to_numpy().astype(np.int64)
    width = np.diff(t.column(0).offsets.to_numpy()).astype(np.int64)
    target, n = t.column(1).to_numpy().astype(np.int64), t.column(2).to_numpy().astype(np.int64)
    neg = t.column(3).flatten().to_numpy().astype(np.int64)
    draws = np.diff(t.column(3).offsets.to_numpy()).astype(np.int64)
    of = np.repeat(np.arange(len(n)), draws)
    h = np.add.reduceat(x[flat], np.cumsum(width) - width) / width[:, None]
    p = 1 / (1 + np.exp(-np.clip((h * y[target]).sum(1), -500, 500)))
    q = 1 / (1 + np.exp(np.clip((h[of] * y[neg]).sum(1), -500, 500)))
    cp, cq = np.where(p > FLOOR, p - 1, 0) * n, np.where(q > FLOOR, 1 - q, 0)
    back = cp[:, None] * y[target] + np.add.reduceat(cq[:, None] * y[neg], np.cumsum(draws) - draws)
    np.add.at(grads[0], flat, np.repeat(back / width[:, None], width, axis=0))
    np.add.at(grads[1], target, cp[:, None] * h)
    np.add.at(grads[1], neg, cq[:, None] * h[of])
    return np.array([n.sum(), (n * -np.log(np.maximum(p, FLOOR))).sum(), -np.log(np.maximum(q, FLOOR)).sum(), (n * (p >= 0.5)).sum(), (q <= 0.5).sum(), len(q)], np.float64)


def capped(x: np.ndarray, most: float | None) -> np.ndarray:
    """Rows longer than `most` shortened to it."""
    if most is None:
        return x
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > most, x * most / np.maximum(n, 1e-12), x)


def step_means(t) -> dict:
    """Of sums: occurrences, positive and negative loss, hits, false alarms, draws."""
    return {"loss": (t[1] + t[2]) / t[0], "positive-loss": t[1] / t[0], "negative-loss": t[2] / t[0], "recall": t[3] / t[0], "precision": 1 - t[4] / t[5]}


@dataclass
class Trainer:
    """Fits both matrices on examples (inputs array<int>, target int, n long; or pairs center, ctx, n). A step is one
    distributed gradient over a share of the examples, dealt anew each epoch, or over one batch after the other where
    examples have a column `batch` (as batch_examples() gives). The matrices (vocabulary x dims, `SENT`
    bytes at most) stay on the driver and go out with each step. Larger ones take
    sharded.ShardedTrainer."""

    vocab: int
    dims: int
    lr: float = 0.05
    negatives: int = 1
    epochs: int = 5
    steps_per_epoch: int = 4
    seed: int = 0
    gamma: float = 1.0
    step_size: int = 1
    max_norm: float | None = None
    optimizer: str = "adam"
    interval: str = "epoch"
    history: list = field(default_factory=list)
    meter: MetricMeter = field(default_factory=MetricMeter)
    epoch: int = 0
    #: Draws noise by weight; uniform where there is none.
    noise_table: NoiseTable | None = None

    SENT = 1 << 30

    def __post_init__(self):
        if self.vocab * self.dims * 16 > self.SENT:
            raise ValueError("the matrices are too large to go out whole; take sharded.ShardedTrainer")
        if self.optimizer not in OPTIMIZERS or self.interval not in ("epoch", "step"):
            raise ValueError(f"optimizer one of {sorted(OPTIMIZERS)}, interval 'epoch' or 'step'")
        r, b = np.random.default_rng(self.seed), xavier_bound(self.vocab, self.dims)
        self.params = {s: r.uniform(-b, b, (self.vocab, self.dims)) for s in ("input", "output")}
        self.state = OPTIMIZERS[self.optimizer]()

    def fit(self, examples, after=None) -> "Trainer":
        """examples: a DataFrame, or a function of the epoch that gives one (fresh walks). after(trainer): called at the
        end of each epoch. A trainer that was loaded goes on with its next epoch."""
        while self.epoch < self.epochs:
            df = examples(self.epoch) if callable(examples) else examples
            if "inputs" not in df.columns:
                df = df.select(F.array("center").alias("inputs"), F.col("ctx").alias("target"), "n")
            self._batches(df) if "batch" in df.columns else self._shares(df)
            for name, value in self.meter.get_all():
                self.history.append({"epoch": self.epoch, "step": self.state.t, "name": name, "value": value})
            self.epoch += 1
            if after is not None:
                after(self)
        return self

    def _pace(self) -> None:
        self.state.lr = step_lr(self.lr, self.step_size, self.gamma, self.state.t if self.interval == "step" else self.epoch)

    def _shares(self, df: DataFrame) -> None:
        """An epoch of steps_per_epoch shares."""
        shares = self.steps_per_epoch
        parted = df.select("inputs", "target", "n", F.pmod(F.xxhash64(_key(), "target", F.lit(self.epoch)), F.lit(shares)).alias("first"))
        # read once by each step, and not held by executors meanwhile
        parted = written(parted, "shares")
        for share in range(shares):
            self._pace()
            # occurrences are dealt evenly, the odd ones from a share on that the epoch draws
            extra = F.when(F.pmod(F.lit(share) - F.col("first"), F.lit(shares)) < F.pmod("n", F.lit(shares)), 1).otherwise(0)
            mine = parted.withColumn("n", (F.floor(F.col("n") / shares) + extra).cast("long")).where("n > 0")
            means = self._step(mine, self.epoch * shares + share)
            if means is not None:
                self._log(means)
        drop(parted)

    def _kept(self, df: DataFrame):
        """The batches' examples as a table in the order of batches, so that a step reads its own row groups, and their number."""
        table = written(df.select("batch", "inputs", "target", "n").repartitionByRange("batch").sortWithinPartitions("batch"), "batches")
        last = table.agg(F.max("batch")).first()[0]
        return table, 0 if last is None else last + 1

    def _batches(self, df: DataFrame) -> None:
        """An epoch of a step for each batch, in their order."""
        table, count = self._kept(df)
        for batch in range(count):
            self._pace()
            means = self._step(table.where(F.col("batch") == batch).drop("batch"), self.epoch * count + batch)
            if means is not None:
                self._log(means)
        drop(table)

    def _step(self, examples: DataFrame, number: int) -> dict | None:
        """One step of the optimizer; the means before it."""
        got = self._gradient(examples, number)
        if got is None:
            return None
        grads, means = got
        self.state.step(self.params, grads)
        self._cap()
        return means

    def _log(self, means: dict, prefix: str = "train") -> None:
        for name, value in means.items():
            if np.isnan(value):
                raise FloatingPointError(f"{name} isn't a number")
            if name in ("recall", "precision"):
                self.meter.push(f"{prefix}-metrics/{name}", value)
            else:
                self.meter.push(f"{prefix}-epoch/{name}", value)
                self.history.append({"epoch": self.epoch, "step": self.state.t, "name": f"{prefix}/{name}", "value": value})
        if prefix == "train":
            self.history.append({"epoch": self.epoch, "step": self.state.t, "name": "epoch/lr", "value": self.state.lr})

    def _noisy(self, examples: DataFrame, step, keep: tuple = ()) -> DataFrame:
        if self.noise_table is None:
            return with_noise(examples, self.negatives, self.vocab, self.seed, step, keep=keep)
        return with_weighted_noise(examples, self.negatives, self.noise_table, self.seed, step, keep)

    def validate(self, examples: DataFrame) -> dict:
        """Means over examples that aren't trained on, logged as val."""
        got = self._gradient(examples, -1 - self.epoch)
        if got is None:
            return {}
        self._log(got[1], "val")
        return got[1]

    def _cap(self):
        self.params = {k: capped(p, self.max_norm) for k, p in self.params.items()}

    def _gradient(self, examples: DataFrame, step: int):
        spark = ship(examples.sparkSession)
        sent = spark.sparkContext.broadcast(self.params)

        def run(batches):
            grads, sums = None, np.zeros(6)
            for t in batches:
                if not t.num_rows:
                    continue
                x, y = sent.value["input"], sent.value["output"]
                if grads is None:
                    grads = [np.zeros_like(x), np.zeros_like(y)]
                sums += batch_gradient(t, x, y, grads)
            if grads is not None:
                hit = [np.flatnonzero(g.any(1)) for g in grads]
                yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array([h.tobytes() for h in hit], pa.binary()), pa.array([g[h].tobytes() for g, h in zip(grads, hit)], pa.binary()), pa.array([sums.tobytes(), b""], pa.binary())], ["side", "rows", "grad", "sums"])

        noisy = self._noisy(examples.select("inputs", "target", "n"), step)
        rows = noisy.select("inputs", "target", "n", "neg").mapInArrow(run, "side int, rows binary, grad binary, sums binary").collect()
        sent.destroy()
        if not rows:
            return None
        total, grads = np.zeros(6), [np.zeros_like(self.params["input"]), np.zeros_like(self.params["output"])]
        for r in rows:
            grads[r.side][np.frombuffer(r.rows, np.int64)] += np.frombuffer(r.grad).reshape(-1, self.dims)
            if r.sums:
                total += np.frombuffer(r.sums)
        return {"input": grads[0] / total[0], "output": grads[1] / total[0]}, step_means(total)

    def embeddings(self, vocab: DataFrame) -> DataFrame:
        """side, idx, token, vec."""
        spark = vocab.sparkSession
        rows = [(s, i, v.tolist()) for s, m in self.params.items() for i, v in enumerate(m)]
        return spark.createDataFrame(rows, "side string, idx int, vec array<double>").join(vocab.select("idx", "token"), "idx").select("side", "idx", "token", "vec")

    def metrics(self, spark) -> DataFrame:
        """epoch, step, name, value of all that was logged."""
        return spark.createDataFrame([(h["epoch"], h["step"], h["name"], float(h["value"])) for h in self.history], "epoch int, step int, name string, value double")

    def checkpoint(self, spark) -> DataFrame:
        """All that a trainer needs to go on: side, idx, vec and the optimizer's moments, with epoch and step."""
        zero = np.zeros((self.vocab, self.dims))
        rows = [(self.epoch, self.state.t, s, i, p[i].tolist(), self.state.m.get(s, zero)[i].tolist(), self.state.v.get(s, zero)[i].tolist()) for s, p in self.params.items() for i in range(self.vocab)]
        return spark.createDataFrame(rows, "epoch int, step int, side string, idx int, vec array<double>, m array<double>, v array<double>")

    def resume(self, checkpoint: DataFrame) -> "Trainer":
        rows = checkpoint.collect()
        self.epoch, self.state.t = rows[0].epoch, rows[0].step
        for s in self.params:
            mine = sorted((r for r in rows if r.side == s), key=lambda r: r.idx)
            if len(mine) != self.vocab or len(mine[0].vec) != self.dims:
                raise ValueError("the checkpoint is of another vocabulary or dimension")
            self.params[s] = np.array([r.vec for r in mine])
            self.state.m[s], self.state.v[s] = np.array([r.m for r in mine]), np.array([r.v for r in mine])
        return self
