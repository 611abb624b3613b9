"""t-SNE of any number of vectors: affinities of nearest neighbours, repulsion through a grid, rounds as Spark jobs.

A point is drawn to its neighbours by sparse sums over arcs (point, neighbour). All points drive each other apart; that force
is smooth, so each point's weight goes to sixteen nodes of a regular grid, the grid is convolved with the force once, and
points read the result at the same nodes. The grid has at most NODES * BOXES nodes a side, however many points there are,
so the driver holds a bounded field; all that grows with the points lies in tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import rng
from vecloom.operators import nearest
from vecloom.operators.storage import drop, ship, written

#: Nodes of a box along an axis; fields between them are polynomials of one degree less.
NODES = 4
#: Boxes of the grid along an axis at most; the fields that go out have NODES * BOXES nodes a side and two doubles a node.
BOXES = 384
#: Width of a box while that many suffice; wider ones, beyond a span of BOXES * WIDTH, tell close points less well apart.
WIDTH = 0.5
#: Halvings of the search for a bandwidth.
HALVINGS = 50
#: Points in one block of arcs.
BLOCK = 2048
STATE = "idx long, x double, y double, ux double, uy double"


def clamp(perplexity: float, n: int) -> float:
    """The perplexity that n points allow."""
    return min(perplexity, max(2.0, (n - 1) / 3))


def affinities(vectors: DataFrame, perplexity: float = 30.0) -> DataFrame:
    """idx, to array<long>, p array<double>: how likely each point takes each of its 3 * perplexity nearest others (ties by idx)
    as its neighbour, under a Gaussian of the point's own width whose perplexity is the one asked for; shares of a point sum to one.

    vectors: idx, vec, idx without repeats; null vectors take no part. Copies are at distance zero. Nearest ones are exact
    (nearest.every_nearest). Rows have a bounded size."""
    spark = ship(vectors.sparkSession)
    v = vectors.where("vec IS NOT NULL").select(F.col("idx").cast("long").alias("idx"), "vec")
    n = v.count()
    if n < 2:
        return spark.createDataFrame([], "idx long, to array<long>, p array<double>")
    p = clamp(perplexity, n)
    k = min(n - 1, int(3 * p))
    met = nearest.every_nearest(v, k + 1, metric="euclidean").matches.where("query <> idx")
    lists = met.groupBy(F.col("query").alias("id")).agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "idx", "sim"))), 1, k).alias("near"))
    lists = lists.select("id", F.transform("near", lambda t: t["idx"]).alias("to"), F.transform("near", lambda t: t["sim"] * t["sim"]).alias("d"))

    def widths(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            d = d - d.min(axis=1, keepdims=True)
            lo, hi, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
            for _ in range(HALVINGS):
                w = np.exp(-d * beta[:, None])
                s = w.sum(axis=1)
                wide = np.log(s) + beta * (d * w).sum(axis=1) / s > np.log(p)
                lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
                beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
            w = np.exp(-d * beta[:, None])
            w /= w.sum(axis=1, keepdims=True)
            ends = pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32())
            yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))], ["idx", "to", "p"])

    return lists.mapInArrow(widths, "idx long, to array<long>, p array<double>")


def symmetric(arcs: DataFrame) -> DataFrame:
    """idx, to, p: joint affinities of pairs of points, both ways, which sum to one in all; from affinities()."""
    n = arcs.count()
    flat = arcs.select("idx", F.explode(F.arrays_zip("to", "p")).alias("t")).select("idx", F.col("t.to").alias("to"), F.col("t.p").alias("p"))
    both = flat.unionByName(flat.select(F.col("to").alias("idx"), F.col("idx").alias("to"), "p"))
    return both.groupBy("idx", "to").agg((F.sum("p") / F.lit(2.0 * max(n, 1))).alias("p"))


# ---------------------------------------------------------------- repulsion


class Grid:
    """A square of boxes over the points, each with NODES x NODES nodes."""

    def __init__(self, low: tuple[float, float], span: float):
        self.boxes = int(min(BOXES, max(20, np.ceil(span / WIDTH))))
        self.low, self.width = np.array(low), max(span, 1e-9) * (1 + 1e-9) / self.boxes
        self.side = NODES * self.boxes

    def nodes(self, xy: np.ndarray):
        """Node rows, node columns and the shares of both axes, NODES for each point."""
        at = (xy - self.low) / self.width
        box = np.clip(np.floor(at).astype(np.int64), 0, self.boxes - 1)
        # nodes lie at (k + 1/2) / NODES of a box; each has the polynomial that is one there and zero at the others
        t = (at - box) * NODES - 0.5
        share = np.stack([np.prod([(t - j) / (k - j) for j in range(NODES) if j != k], axis=0) for k in range(NODES)], axis=2)
        node = box[:, :, None] * NODES + np.arange(NODES)
        return node[:, 0], node[:, 1], share[:, 0], share[:, 1]

    def fields(self, charge: np.ndarray):
        """(force along x, force along y, sum over all ordered pairs of points of 1 / (1 + distance^2))."""
        m, h = self.side, self.width / NODES
        d = np.fft.fftfreq(2 * m, 1 / (2 * m)) * h
        dx, dy = d[:, None], d[None]
        near = 1 / (1 + dx * dx + dy * dy)
        wave = np.fft.rfft2(charge, (2 * m, 2 * m))
        made = [np.fft.irfft2(wave * np.fft.rfft2(kernel), (2 * m, 2 * m))[:m, :m] for kernel in (near * near * dx, near * near * dy, near)]
        return made[0], made[1], float((charge * made[2]).sum())


def _charges(state: DataFrame, grid: Grid) -> np.ndarray:
    """The points' weights at the grid's nodes, added up by row of nodes in tasks; one bounded array comes back."""
    side = grid.side

    def spread(batches):
        total, rows = None, None
        for b in batches:
            xy = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            i, j, a, c = grid.nodes(xy)
            if total is None:
                total, rows = np.zeros((side, side)), np.zeros(side, bool)
            np.add.at(total, (i[:, :, None], j[:, None, :]), a[:, :, None] * c[:, None, :])
            rows[np.unique(i)] = True
        if total is not None:
            hit = np.flatnonzero(rows)
            yield pa.record_batch([pa.array(hit), pa.array([total[k].tobytes() for k in hit], pa.binary())], ["row", "blob"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(side)
        for blob in t["blob"]:
            total += np.frombuffer(blob.as_buffer())
        return pa.table({"row": t["row"].slice(0, 1), "blob": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((side, side))
    for r in state.select("x", "y").mapInArrow(spread, "row long, blob binary").groupBy("row").applyInArrow(add, "row long, blob binary").collect():
        out[r.row] = np.frombuffer(r.blob)
    return out


def repulsion(state: DataFrame):
    """(idx, rx, ry of each point: sums over all others of (point - other) / (1 + distance^2)^2; and the sum over all ordered
    pairs of different points of 1 / (1 + distance^2)). state: idx, x, y and others."""
    spark = ship(state.sparkSession)
    x0, x1, y0, y1, n = state.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    grid = Grid((x0, y0), max(x1 - x0, y1 - y0))
    fx, fy, total = grid.fields(_charges(state, grid))
    sent = spark.sparkContext.broadcast((fx, fy))

    def read(batches):
        for b in batches:
            i, j, a, c = grid.nodes(np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], axis=1))
            share, at = a[:, :, None] * c[:, None, :], (i[:, :, None], j[:, None, :])
            yield pa.record_batch([b.column(0), *(pa.array((share * f[at]).sum(axis=(1, 2))) for f in sent.value)], ["idx", "rx", "ry"])

    return state.select("idx", "x", "y").mapInArrow(read, "idx long, rx double, ry double"), total - n


# ---------------------------------------------------------------- attraction


class Arcs:
    """Arcs in blocks of points, and which points each block has to hear of; both written once."""

    def __init__(self, arcs: DataFrame, n: int):
        blocks = max(1, -(-n // BLOCK))
        self.arcs = written(arcs.select(F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int").alias("block"), "idx", "to", "p"), "arcs")
        heard = self.arcs.select("block", F.explode(F.concat(F.array("idx"), "to")).alias("idx"))
        self.heard = written(heard.distinct(), "heard")

    def pull(self, state: DataFrame) -> DataFrame:
        """idx, ax, ay: sums over arcs from and to a point of p (point - other) / (1 + distance^2). An arc counts at both ends,
        so it makes up the symmetric affinity; a point that many take as neighbour is summed by block first."""
        told = self.heard.join(state.select("idx", "x", "y"), "idx").select("block", "idx", "x", "y")

        def run(a: pa.Table, s: pa.Table) -> pa.Table:
            ids = s["idx"].to_numpy()
            order = np.argsort(ids)
            ids, xy = ids[order], np.stack([s["x"].to_numpy()[order], s["y"].to_numpy()[order]], axis=1)
            force = np.zeros_like(xy)
            if a.num_rows:
                to = a["to"].combine_chunks()
                own = np.searchsorted(ids, np.repeat(a["idx"].to_numpy(), np.diff(to.offsets.to_numpy())))
                other = np.searchsorted(ids, to.flatten().to_numpy())
                gap = xy[own] - xy[other]
                f = gap * (a["p"].combine_chunks().flatten().to_numpy() / (1 + (gap * gap).sum(axis=1)))[:, None]
                for k in range(2):
                    force[:, k] = np.bincount(own, f[:, k], len(ids)) - np.bincount(other, f[:, k], len(ids))
            return pa.table({"idx": pa.array(ids), "ax": pa.array(force[:, 0]), "ay": pa.array(force[:, 1])})

        parts = self.arcs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "idx long, ax double, ay double")
        return parts.groupBy("idx").agg(F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))

    def drop(self) -> None:
        drop(self.arcs, self.heard)


def start(points: DataFrame, seed: int = 42) -> DataFrame:
    """idx, x, y, ux, uy: points close around zero, by counter, that don't move yet."""
    def normal(k):
        # uniform draws are below one, so the logarithm's argument isn't zero
        far = F.sqrt(-2 * F.log(1 - rng.uniform(seed, F.col("idx"), k, "r")))
        return (far * F.cos(2 * np.pi * rng.uniform(seed, F.col("idx"), k, "a")) * 1e-4).alias(k)

    return points.select(F.col("idx").cast("long").alias("idx"), normal("x"), normal("y"), F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"))


def advance(state: DataFrame, arcs: Arcs, n: int, number: int, rate: float | None = None, early: int = 100) -> DataFrame:
    """The state after round `number`: affinities count fourfold and moves go on by half up to `early`, then once and by 0.8."""
    keep, much = (0.5, 4.0) if number < early else (0.8, 1.0)
    rate = max(n / 12, 50.0) if rate is None else rate
    away, total = repulsion(state)
    met = state.join(arcs.pull(state), "idx", "left").join(away, "idx")
    move = lambda u, a, r: F.lit(keep) * F.col(u) - F.lit(4.0 * rate) * (F.coalesce(F.col(a), F.lit(0.0)) * F.lit(much / (2 * n)) - F.col(r) / F.lit(max(total, 1e-300)))
    met = met.select("idx", "x", "y", move("ux", "ax", "rx").alias("ux"), move("uy", "ay", "ry").alias("uy"))
    return met.select("idx", (F.col("x") + F.col("ux")).alias("x"), (F.col("y") + F.col("uy")).alias("y"), "ux", "uy")


def embed(vectors: DataFrame, perplexity: float = 30.0, rounds: int = 500, seed: int = 42, rate: float | None = None) -> DataFrame:
    """idx, x, y: t-SNE in two dimensions of vectors (idx, vec; idx without repeats, null vectors take no part). State lies in the
    shared folder and is written once a round, so lineage stays short and lost executors redo one round at most."""
    kind = vectors.schema["idx"].dataType.simpleString()
    v = vectors.where("vec IS NOT NULL").select("idx", "vec")
    n = v.count()
    state = written(start(v, seed), "points")
    if n > 1:
        arcs = Arcs(affinities(v, perplexity), n)
        for number in range(rounds):
            old, state = state, written(advance(state, arcs, n, number, rate), "points")
            drop(old)
        arcs.drop()
    return state.select(F.col("idx").cast(kind).alias("idx"), "x", "y")
