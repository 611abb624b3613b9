"""Training of matrices that fit no machine: both sides and the optimizer's moments lie in shards.

A side's shard s of S holds the rows with idx % S = s, so that frequent words spread over all shards. A step
- packs the step's terms (context, output, positive or noise) by the shards that they join, four to six bytes each,
- pairs each context shard with each output shard that a term joins: such a cell works out the gradients of
  the rows of both,
- adds these up by shard in a tree, and moves each shard's rows where they lie.

For skip-gram the contexts are the input rows. For CBOW each distinct set of inputs is a context; its vector, and the way
back of its gradient to its inputs, take cells of context and input shards. The driver holds figures alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import rng
from vecloom.operators.sgns import FLOOR, OPTIMIZERS, Trainer, step_means, xavier_bound
from vecloom.operators.storage import drop, ship, written
from vecloom.operators.vocabulary import numbered

STATE = "side string, shard int, vec binary, m binary, v binary"
PART = "side string, shard int, part int, blob binary, sums array<double>"
#: Blobs that one task adds up.
FAN = 16
#: Terms that a cell works on at a time, that a task packs at a time, and that a piece of a cell has on average at most.
TERMS, HELD, MOST_TERMS = 1 << 15, 1 << 22, 1 << 23
#: Bytes of the shards that meet in a cell, at most, unless two have more.
CELL_BYTES = 32 << 20
PACKED = "sa int, sb int, flush int, noise binary, places binary, weights binary"


def _parts(rows) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 5
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()))
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["side", "shard", "part", "blob", "sums"])


def added(parts: DataFrame, cells: int) -> DataFrame:
    """One row for each side and shard: its blobs and sums added up, FAN at a time."""

    def add(t: pa.Table) -> pa.Table:
        total, sums = None, None
        for blob, s in zip(t["blob"], t["sums"]):
            x = np.frombuffer(blob.as_buffer())
            total = x.copy() if total is None else total + x
            s = np.array(s.as_py())
            sums = s if sums is None else sums + s
        return _parts([(t["side"][0].as_py(), t["shard"][0].as_py(), t["part"][0].as_py(), total.tobytes(), sums.tolist())])

    while True:
        cells = -(-cells // FAN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(cells)).cast("int")).groupBy("side", "shard", "part").applyInArrow(add, PART)
        if cells == 1:
            return parts


def _packer(wide: int, shards: int, height: int, span: int, kind):
    """Examples (a, b, n, neg) as rows of PACKED: of each pair of groups of `span` shards the places (i * span * height + j) of its noise terms, once a draw, and those of
    its positive ones with their numbers of occurrences, of at most sgns.OCCURRENCES."""

    high, across = span * height, -(-shards // span)
    group = lambda x, n: x % n // span
    row = lambda x, n: x % n % span * height + x // n

    def flushed(held, flush):
        a, b, n, of, neg = (np.concatenate(c) for c in zip(*held))
        sides = []
        for x, y, w in ((a[of], neg, None), (a, b, n.astype(np.uint16))):
            cell = group(x, wide) * across + group(y, shards)
            order = np.argsort(cell, kind="stable")
            cells, first = np.unique(cell[order], return_index=True)
            place = (row(x, wide) * high + row(y, shards))[order].astype(kind)
            sides.append((cells, np.append(first, len(place)), place, None if w is None else w[order]))
        every = np.union1d(sides[0][0], sides[1][0])

        def blobs(cells, ends, values):
            at = np.searchsorted(cells, every)
            here = at < len(cells)
            here[here] = cells[at[here]] == every[here]
            return pa.array([values[ends[k] : ends[k + 1]].tobytes() if h else b"" for k, h in zip(at, here)], pa.binary())

        (c0, e0, p0, _), (c1, e1, p1, w1) = sides
        return pa.record_batch([pa.array((every // across).astype(np.int32)), pa.array((every % across).astype(np.int32)), pa.array(np.full(len(every), flush, np.int32)), blobs(c0, e0, p0), blobs(c1, e1, p1), blobs(c1, e1, w1)], ["sa", "sb", "flush", "noise", "places", "weights"])

    def run(batches):
        from pyspark import TaskContext

        held, rows, terms, flush = [], 0, 0, TaskContext.get().partitionId()
        for t in batches:
            if not t.num_rows:
                continue
            neg, draws = t.column(3).flatten().to_numpy(), pc.list_value_length(t.column(3)).to_numpy()
            held.append((t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy(), rows + np.repeat(np.arange(t.num_rows), draws), neg))
            rows, terms = rows + t.num_rows, terms + t.num_rows + len(neg)
            if terms >= HELD:
                yield flushed(held, flush)
                held, rows, terms, flush = [], 0, 0, flush + 1
        if held:
            yield flushed(held, flush)

    return run


@dataclass
class ShardedTrainer(Trainer):
    """Trainer for matrices of any size; the same examples, noise, dealing, losses and updates. `rows`: rows of a
    matrix in one shard; a cell holds two shards. spark: where the first vectors are drawn (by counter, as xavier())."""

    spark: SparkSession | None = None
    rows: int = 4096

    def __post_init__(self):
        if self.optimizer not in OPTIMIZERS or self.interval not in ("epoch", "step"):
            raise ValueError(f"optimizer one of {sorted(OPTIMIZERS)}, interval 'epoch' or 'step'")
        self.state = OPTIMIZERS[self.optimizer]()
        self.shards = -(-self.vocab // self.rows)
        self.height = -(-self.vocab // self.shards)
        self.spark = ship(self.spark or SparkSession.getActiveSession())
        b = xavier_bound(self.vocab, self.dims)
        cells = self.spark.range(self.vocab).select(F.explode(F.array(F.lit("input"), F.lit("output"))).alias("side"), F.col("id").cast("int").alias("idx"))
        draw = lambda k: F.lit(-b) + rng.uniform(self.seed, F.col("side"), F.col("idx"), k) * F.lit(2 * b)
        self.table = written(self._packed(cells.withColumn("vec", F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), draw)).select("side", "idx", "vec", F.lit(None).cast("array<double>").alias("m"), F.lit(None).cast("array<double>").alias("v"))), "shards")

    # ------------------------------------------------------------ state

    def _packed(self, rows: DataFrame) -> DataFrame:
        """side, idx, vec, m, v as shards; null moments are zero."""
        height, dims, shards = self.height, self.dims, self.shards

        def pack(t: pa.Table) -> pa.Table:
            at = t["idx"].to_numpy() // shards
            out = []
            for c in ("vec", "m", "v"):
                x = np.zeros((height, dims))
                col = t[c].combine_chunks()
                here = col.is_valid().to_numpy(zero_copy_only=False)
                x[at[here]] = col.drop_null().flatten().to_numpy().reshape(-1, dims)
                out.append(x.tobytes())
            return pa.table([pa.array([t["side"][0].as_py()]), pa.array([t["shard"][0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in out)], names=["side", "shard", "vec", "m", "v"])

        return rows.withColumn("shard", F.pmod("idx", F.lit(shards)).cast("int")).groupBy("side", "shard").applyInArrow(pack, STATE)

    def vectors(self) -> DataFrame:
        """side, idx, vec, m, v: all rows of both matrices."""
        height, dims, shards, vocab = self.height, self.dims, self.shards, self.vocab

        def rows(batches):
            for b in batches:
                for side, shard, *blobs in zip(*(c for c in b.columns)):
                    idx = np.arange(height) * shards + shard.as_py()
                    n = int((idx < vocab).sum())
                    if n:
                        ends = pa.array(np.arange(n + 1) * dims, pa.int32())
                        lists = [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(x.as_buffer())[: n * dims])) for x in blobs]
                        yield pa.record_batch([pa.array([side.as_py()] * n), pa.array(idx[:n], pa.int32()), *lists], ["side", "idx", "vec", "m", "v"])

        return self.table.mapInArrow(rows, "side string, idx int, vec array<double>, m array<double>, v array<double>")

    def embeddings(self, vocab: DataFrame) -> DataFrame:
        return self.vectors().join(vocab.select("idx", "token"), "idx").select("side", "idx", "token", "vec")

    def checkpoint(self, spark=None) -> DataFrame:
        return self.vectors().select(F.lit(self.epoch).alias("epoch"), F.lit(self.state.t).alias("step"), "side", "idx", "vec", "m", "v")

    def resume(self, checkpoint: DataFrame) -> "ShardedTrainer":
        """Goes on from the rows of a checkpoint, this class's or Trainer's."""
        first = checkpoint.agg(F.max("epoch"), F.max("step"), F.count("*"), F.max("idx"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
        if tuple(first[2:]) != (2 * self.vocab, self.vocab - 1, self.dims, self.dims):
            raise ValueError("the checkpoint is of another vocabulary or dimension")
        self.epoch, self.state.t = first[0], first[1]
        self._replace(written(self._packed(checkpoint.select("side", "idx", "vec", "m", "v")), "shards"))
        return self

    def _replace(self, table: DataFrame) -> None:
        old, self.table = self.table, table
        drop(old)

    # ------------------------------------------------------------ cells

    def _shards_of(self, side: str) -> DataFrame:
        return self.table.where(F.col("side") == side).select("shard", F.col("vec").alias("blob"))

    @staticmethod
    def _cells(links: DataFrame, a: DataFrame, b: DataFrame, work, span: int = 1) -> DataFrame:
        """links: sa, sb (and piece, where several tasks share a pair) and what work(table, blob of a, blob of b) needs; a and b: shard, blob.
        Each pair of shards that a link joins gives the rows (side, shard, part, blob, sums) of work. With a span sa and sb are groups of so many shards, whose
        blobs lie one after the other."""
        keys = [k for k in ("sa", "sb", "piece") if k in links.columns]
        mine = ["ca", "cb", "cp"][: len(keys)]
        cells = links.select(*(F.col(k).alias(c) for k, c in zip(keys, mine))).distinct()
        group = F.floor(F.col("shard") / span).cast("int")
        sides = [cells.join(x.select(group.alias(s), "shard", "blob").hint("merge"), s).select(*mine, F.lit(name).alias("side"), "shard", "blob") for x, s, name in ((a, "ca", "a"), (b, "cb", "b"))]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _parts([])
            right = right.sort_by("shard")
            whole = (np.concatenate([np.frombuffer(x.as_buffer()) for s, x in zip(right["side"], right["blob"]) if s.as_py() == side]) for side in "ab")
            return _parts(work(left, *whole))

        return links.groupBy(*keys).cogroup(sides[0].unionByName(sides[1]).groupBy(*mine)).applyInArrow(run, PART)

    def _contexts(self, examples: DataFrame):
        """(inputs, a: the number of a set of inputs; links from contexts to inputs; number of context shards). For skip-gram
        a context is its one input: there are neither contexts nor links."""
        if not examples.where(F.size("inputs") != 1).limit(1).count():
            return None, None, self.shards
        contexts = written(numbered(examples.select("inputs").distinct(), [F.col("inputs")]).withColumnRenamed("idx", "a"), "contexts")
        shards = max(1, -(-contexts.count() // self.height))
        flat = contexts.select("a", F.size("inputs").alias("width"), F.explode("inputs").alias("b")).groupBy("a", "b", "width").agg(F.count("*").alias("n"))
        links = flat.select(F.pmod("a", F.lit(shards)).cast("int").alias("sa"), F.pmod("b", F.lit(self.shards)).cast("int").alias("sb"), F.floor(F.col("a") / shards).cast("int").alias("i"), F.floor(F.col("b") / self.shards).cast("int").alias("j"), (F.col("n") / F.col("width")).alias("w"))
        return contexts, written(links, "links"), shards

    def _means(self, links: DataFrame, shards: int) -> DataFrame:
        """shard, blob: the mean input vectors of contexts."""
        height, dims = self.height, self.dims

        def work(t, _, b):
            out, b = np.zeros((height, dims)), b.reshape(-1, dims)
            i, j, w = (t[c].to_numpy() for c in ("i", "j", "w"))
            for k in range(0, len(i), TERMS):
                s = slice(k, k + TERMS)
                np.add.at(out, i[s], w[s, None] * b[j[s]])
            return [("context", t["sa"][0].as_py(), t["sb"][0].as_py(), out.tobytes(), [0.0] * 6)]

        empty = links.select(F.col("sa").alias("shard")).distinct().withColumn("blob", F.lit(b"").cast("binary"))
        return added(self._cells(links, empty, self._shards_of("input"), work), self.shards).select("shard", "blob")

    def _back(self, links: DataFrame, grads: DataFrame, shards: int) -> DataFrame:
        """Gradients of contexts carried to their inputs."""
        height, dims = self.height, self.dims

        def work(t, a, _):
            out, a = np.zeros((height, dims)), a.reshape(-1, dims)
            i, j, w = (t[c].to_numpy() for c in ("i", "j", "w"))
            for k in range(0, len(i), TERMS):
                s = slice(k, k + TERMS)
                np.add.at(out, j[s], w[s, None] * a[i[s]])
            return [("input", t["sb"][0].as_py(), t["sa"][0].as_py(), out.tobytes(), [0.0] * 6)]

        empty = links.select(F.col("sb").alias("shard")).distinct().withColumn("blob", F.lit(b"").cast("binary"))
        return added(self._cells(links, grads, empty, work), shards)

    def _gradients(self, examples: DataFrame, number: int) -> DataFrame:
        """side, shard, part, blob, sums of the step: sums of gradients, with the figures of the loss on outputs' rows."""
        height, dims, shards = self.height, self.dims, self.shards
        contexts, links, wide = self._contexts(examples)
        noisy = self._noisy(examples, number)
        noisy = noisy.withColumn("a", F.col("inputs")[0].cast("long")) if links is None else noisy.join(contexts, "inputs")
        # groups of shards meet, so that each shard goes to fewer cells; there are still enough of these for all tasks
        tasks = 2 * int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        span = max(1, min(int(((wide * shards) / tasks) ** 0.5), CELL_BYTES // (height * dims * 16)))
        high = span * height
        kind = np.uint32 if high * high <= 1 << 32 else np.uint64
        packed = noisy.select("a", F.col("target").cast("long").alias("b"), "n", F.col("neg").cast("array<long>").alias("neg")).mapInArrow(_packer(wide, shards, height, span, kind), PACKED)
        table = written(packed, "terms")
        size = table.agg(F.sum((F.length("noise") + F.length("places")) / kind().itemsize)).first()[0] or 0
        # frequent pairs of shards in small vocabularies have more terms than a task may hold
        groups = lambda n: -(-n // span)
        pieces = max(1, int(-(-size // (MOST_TERMS * groups(wide) * groups(shards)))))
        terms = table.withColumn("piece", F.pmod(F.hash("sa", "sb", "flush"), F.lit(pieces)).cast("int"))

        side = "input" if links is None else "context"

        def work(t, a, b):
            a, b = a.reshape(-1, dims), b.reshape(-1, dims)
            ga, gb, sums = np.zeros_like(a), np.zeros_like(b), np.zeros(6)
            noise, places = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c in ("noise", "places"))
            place = np.concatenate([places, noise])
            n = np.concatenate([np.frombuffer(b"".join(t["weights"].to_pylist()), np.uint16), np.ones(len(noise), np.uint16)])
            for k in range(0, len(place), TERMS):
                s = slice(k, k + TERMS)
                i, j = np.divmod(place[s].astype(np.int64), high)
                h, o, up, w = a[i], b[j], np.arange(k, k + len(i)) < len(places), n[s].astype(np.float64)
                p = 1 / (1 + np.exp(-np.clip((h * o).sum(1) * np.where(up, 1, -1), -500, 500)))
                c = np.where(p > FLOOR, np.where(up, p - 1, 1 - p), 0) * w
                np.add.at(ga, i, c[:, None] * o)
                np.add.at(gb, j, c[:, None] * h)
                lost = w * -np.log(np.maximum(p, FLOOR))
                sums += [w[up].sum(), lost[up].sum(), lost[~up].sum(), w[up & (p >= 0.5)].sum(), w[~up & (p <= 0.5)].sum(), w[~up].sum()]
            sa, sb, piece = (t[c][0].as_py() for c in ("sa", "sb", "piece"))
            out = [(side, sa * span + k, sb * pieces + piece, g.tobytes(), [0.0] * 6) for k, g in enumerate(np.split(ga, len(ga) // height))]
            # the figures of the loss come with the first shard
            return out + [("output", sb * span + k, sa * pieces + piece, g.tobytes(), [0.0] * 6 if k else sums.tolist()) for k, g in enumerate(np.split(gb, len(gb) // height))]

        means = self._shards_of("input") if links is None else written(self._means(links, wide), "means")
        parts = written(added(self._cells(terms, means, self._shards_of("output"), work, span), groups(max(shards, wide)) * pieces), "gradients")
        left = [table]
        if links is not None:
            back = self._back(links, parts.where("side = 'context'").select("shard", "blob"), wide)
            whole = written(parts.where("side = 'output'").unionByName(back), "gradients")
            left += [contexts, links, means, parts]
            parts = whole
        drop(*left)
        return parts

    def _sums(self, parts: DataFrame):
        return parts.agg(*(F.sum(F.col("sums")[k]) for k in range(6))).first()

    # ------------------------------------------------------------ steps

    def _gradient(self, examples: DataFrame, step: int):
        """For validate(): no gradient, the means."""
        parts = self._gradients(examples, step)
        total = self._sums(parts)
        drop(parts)
        return None if total[0] is None else (None, step_means(total))

    def _step(self, examples: DataFrame, number: int) -> dict | None:
        parts = self._gradients(examples, number)
        total = self._sums(parts)
        if total[0] is None:
            drop(parts)
            return None
        n, dims, cap, kind = total[0], self.dims, self.max_norm, type(self.state)
        lr, t = self.state.lr, self.state.t

        def move(state: pa.Table, grads: pa.Table) -> pa.Table:
            x, m, v = (np.frombuffer(state[c][0].as_buffer()).reshape(-1, dims) for c in ("vec", "m", "v"))
            g = np.frombuffer(grads["blob"][0].as_buffer()).reshape(-1, dims) / n if grads.num_rows else np.zeros_like(x)
            params, own = {0: x}, kind(lr=lr, t=t, m={0: m}, v={0: v})
            own.step(params, {0: g})
            x = params[0]
            if cap is not None:
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.where(norm > cap, x * cap / np.maximum(norm, 1e-12), x)
            blobs = (np.ascontiguousarray(y).tobytes() for y in (x, own.m[0], own.v[0]))
            return pa.table([state["side"].combine_chunks(), state["shard"].combine_chunks(), *(pa.array([y], pa.binary()) for y in blobs)], names=["side", "shard", "vec", "m", "v"])

        self._replace(written(self.table.groupBy("side", "shard").cogroup(parts.groupBy("side", "shard")).applyInArrow(move, STATE), "shards"))
        drop(parts)
        self.state.t += 1
        return step_means(total)
