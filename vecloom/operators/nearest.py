"""Exact nearest vectors of every vector, with cells around pivots that rule most pairs out.

Angles between unit vectors, and distances, keep the triangle inequality. A vector x whose angle to its pivot p lies in [lo, hi] is
at least max(angle(q, p) - hi, lo - angle(q, p)) from q, so a block of such vectors that is further than the k-th best match
known so far can hold none of the k best.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions import rng
from vecloom.functions.vectors import norm
from vecloom.operators.storage import ship, written

#: Bytes of pivots that go to every task.
PIVOT_BYTES = 32 << 20
#: Bytes of vectors on each side of a meeting.
SIDE_BYTES = 16 << 20
#: Similarities held at a time.
CELLS = 4 << 20
#: Radians (or share of the longest vector) by which a block may seem too far; rounding stays far under it.
SLACK = 1e-6


def _rows(column, dims: int) -> np.ndarray:
    """A column of packed vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _minus_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return -np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0.0))


#: By metric: what is largest for the nearest, and the distance that follows from it.
METRICS = {
    "cosine": (lambda a, b: a @ b.T, lambda s: np.arccos(np.clip(s, -1.0, 1.0))),
    "euclidean": (_minus_distances, lambda s: -s),
}


def _best(sim: np.ndarray, ids: np.ndarray, k: int):
    """row, id, similarity of the k largest of each row, ties by id."""
    if sim.shape[1] > k:
        row, col = np.nonzero(sim >= np.partition(sim, -k, axis=1)[:, [-k]])
    else:
        row, col = (x.reshape(-1) for x in np.indices(sim.shape))
    value = sim[row, col]
    order = np.lexsort((ids[col], -value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.searchsorted(row, np.arange(sim.shape[0]))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], ids[col[keep]], value[keep]


def _runs(sizes: list[int], rows: int) -> np.ndarray:
    """Numbers of runs of neighbouring blocks of the given sizes, each of `rows` at most or of one block."""
    run, held, out = 0, 0, []
    for m in sizes:
        if held and held + m > rows:
            run, held = run + 1, 0
        held += m
        out.append(run)
    return np.array(out, np.int64)


@dataclass
class Nearest:
    """matches: query, rank, idx, sim. met: (pairs, all_pairs) in one row: pairs of vectors in groups that met, of which
    similarities are worked out only where blocks may hold one of the best, and pairs of all distinct vectors."""

    matches: DataFrame
    met: DataFrame


def every_nearest(vectors: DataFrame, k: int = 5, seed: int = 0, pivots: int | None = None, block_rows: int | None = None, group_rows: int | None = None, metric: str = "cosine") -> Nearest:
    """The k most similar vectors (itself among them) of every vector, ties by idx, as exact as meeting all.

    metric: 'cosine', or 'euclidean', whose sim is minus the distance. vectors: idx, vec; null vectors and, for the cosine, those of
    norm zero, which have no angle, take no part. Equal vectors are searched once and
    share their matches. The root of the number of vectors gives that of pivots and, from a million on, the rows of a
    block, so what tasks hold of pivots and blocks grows as the root. Each vector meets its own block first; its k-th best there says
    which other blocks it has to meet. Meetings are keyed by pairs of groups of blocks, both of bounded size."""
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r}: one of {sorted(METRICS)}")
    sims_of, gap = METRICS[metric]
    angular = metric == "cosine"
    spark = ship(vectors.sparkSession)
    kind = vectors.schema["idx"].dataType.simpleString()
    v = vectors.select(F.col("idx").cast("long").alias("idx"), "vec").where(norm("vec") > 0 if angular else F.col("vec").isNotNull())
    once = written(v.groupBy("vec").agg(F.min("idx").alias("rep"), F.count("*").alias("copies")), "distinct")
    n, dims, copied, longest = once.agg(F.count("*"), F.max(F.size("vec")), F.max("copies"), F.max(norm("vec"))).first()
    if not n:
        empty = spark.createDataFrame([], f"query {kind}, rank int, idx {kind}, sim double")
        return Nearest(empty, spark.createDataFrame([(0, 0)], "pairs long, all_pairs long"))
    slack = SLACK if angular else SLACK * longest
    loose = 1e-12 if angular else slack
    root = int(np.ceil(np.sqrt(n)))
    count = max(1, min(pivots or root, PIVOT_BYTES // (8 * dims)))
    each = block_rows or max(min(1024, max(64, root // 4)), root)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a vector goes to a group at most once, so few groups are sent least; as many as fill the tasks with meetings of two
    wanted = max(1, min(group_rows or SIDE_BYTES // (8 * dims), max(each, -(-n // int(np.ceil(np.sqrt(parts)))))))
    centres = np.array([r.vec for r in once.orderBy(rng.bits(seed, F.col("rep")), "rep").limit(count).select("vec").collect()], np.float64)
    if angular:
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    sent = spark.sparkContext.broadcast(centres)

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, CELLS // len(sent.value))):
                part = batch.slice(at, max(1, CELLS // len(sent.value)))
                m = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                if angular:
                    m = m / np.linalg.norm(m, axis=1, keepdims=True)
                angle = gap(sims_of(m, sent.value))
                cell = angle.argmin(axis=1)
                yield pa.record_batch([part.column(0), pa.array(cell), pa.array(angle[np.arange(len(cell)), cell]), pa.array([x.tobytes() for x in m], pa.binary())], ["rep", "cell", "angle", "unit"])

    def number(batches):
        """Blocks are runs of `each` rows of one cell, numbered within the task."""
        base, block, cell, rows = TaskContext.get().partitionId() << 32, -1, None, 0
        for batch in batches:
            cells, out = batch.column(1).to_pylist(), []
            for c in cells:
                if c != cell or rows == each:
                    block, cell, rows = block + 1, c, 0
                rows += 1
                out.append(base + block)
            yield batch.append_column("block", pa.array(out, pa.int64()))

    placed = once.select("rep", "vec").mapInArrow(place, "rep long, cell long, angle double, unit binary")
    placed = placed.repartitionByRange(parts, "cell", "angle", "rep").sortWithinPartitions("cell", "angle", "rep")
    placed = written(placed.mapInArrow(number, "rep long, cell long, angle double, unit binary, block long"), "placed")
    # the root of n rows
    rows = placed.groupBy("block").agg(F.first("cell").alias("cell"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("m")).orderBy("block").collect()
    # groups are runs of blocks, across the tasks that numbered these, of at most `wanted` rows
    group_of = _runs([r.m for r in rows], wanted)
    blocks = spark.sparkContext.broadcast((*(np.array([r[c] for r in rows]) for c in ("block", "cell", "lo", "hi")), group_of))
    of_block = F.broadcast(spark.createDataFrame([(r.block, g) for r, g in zip(rows, group_of.tolist())], "block long, b long"))

    def own(t: pa.Table) -> pa.Table:
        """A vector's best in its own block, and the groups of blocks that may hold better ones."""
        m, ids, here = _rows(t["unit"], dims), t["rep"].to_numpy(), t["block"][0].as_py()
        names, cell, lo, hi, groups = blocks.value
        other, sims, goes = [], [], []
        step = max(1, CELLS // max(len(ids), len(names), len(sent.value)))
        for at in range(0, len(ids), step):
            q = m[at : at + step]
            row, to, sim = _best(sims_of(q, m), ids, k)
            ends = np.searchsorted(row, np.arange(len(q) + 1))
            limit = np.array([gap(sim[e - 1]) if e - s == k else np.inf for s, e in zip(ends[:-1], ends[1:])])
            to_pivot = gap(sims_of(q, sent.value))[:, cell]
            near = np.maximum(to_pivot - hi, lo - to_pivot) <= limit[:, None] + slack
            near[:, names == here] = False
            for i in range(len(q)):
                other.append(to[ends[i] : ends[i + 1]].tolist())
                sims.append(sim[ends[i] : ends[i + 1]].tolist())
                goes.append(np.unique(groups[near[i]]).tolist())
        return pa.table({"rep": t["rep"], "block": t["block"], "a": pa.array(np.repeat(groups[np.searchsorted(names, here)], len(ids)), pa.int64()), "unit": t["unit"], "other": pa.array(other, pa.list_(pa.int64())), "sims": pa.array(sims, pa.list_(pa.float64())), "goes": pa.array(goes, pa.list_(pa.int64()))})

    asked = written(placed.groupBy("block").applyInArrow(own, "rep long, block long, a long, unit binary, other array<long>, sims array<double>, goes array<long>"), "asked")
    # size(sims) is k where the own block gave a k-th best; below it nothing is worth sending on
    left = asked.select("a", F.explode("goes").alias("b"), "rep", "block", "unit", F.when(F.size("sims") == k, F.element_at("sims", -1)).otherwise(float("-inf")).alias("least"))
    keys = left.select("a", "b").distinct()
    grouped = placed.join(of_block, "block")
    right = grouped.join(F.broadcast(keys), "b").select(F.col("a").alias("a2"), F.col("b").alias("b2"), "rep", "block", "unit")

    def meet(l: pa.Table, r: pa.Table) -> pa.Table:
        out = []
        if l.num_rows and r.num_rows:
            l, r = l.sort_by("block"), r.sort_by("block")
            q, m, ids = _rows(l["unit"], dims), _rows(r["unit"], dims), r["rep"].to_numpy()
            reps, least = l["rep"].to_numpy(), l["least"].to_numpy()
            ours, theirs = l["block"].to_numpy(), r["block"].to_numpy()
            names, cell, lo, hi, _ = blocks.value
            at_names = np.searchsorted(names, theirs)
            inside = np.unique(at_names)
            step = max(1, CELLS // len(ids))
            starts = np.unique(np.concatenate([np.arange(0, len(q), step), np.flatnonzero(np.diff(ours)) + 1]))
            for s, e in zip(starts, [*starts[1:], len(q)]):
                limit = gap(least[s:e]) + slack
                to_pivot = gap(sims_of(q[s:e], sent.value))[:, cell[inside]]
                far = np.maximum(to_pivot - hi[inside], lo[inside] - to_pivot) > limit[:, None]
                # a vector has met its own block already
                wanted = inside[~far.all(axis=0) & (names[inside] != ours[s])]
                cols = np.flatnonzero(np.isin(at_names, wanted))
                sim = sims_of(q[s:e], m[cols])
                row, col = np.nonzero(sim >= least[s:e, None] - loose)
                value, to = sim[row, col], ids[cols[col]]
                order = np.lexsort((to, -value, row))
                row, value, to = row[order], value[order], to[order]
                keep = np.arange(len(row)) - np.searchsorted(row, np.arange(e - s))[row] < k
                out.append((reps[s:e][row[keep]], to[keep], value[keep]))
        a, b, c = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"rep": a, "other": b, "sim": c})

    found = left.groupBy("a", "b").cogroup(right.groupBy("a2", "b2")).applyInArrow(meet, "rep long, other long, sim double")
    local = asked.select("rep", F.explode(F.arrays_zip("other", "sims")).alias("x")).select("rep", F.col("x.other").alias("other"), F.col("x.sims").alias("sim"))
    rank = lambda ids: F.row_number().over(W.partitionBy("rep").orderBy(F.col("sim").desc(), ids))
    best = local.unionByName(found).withColumn("rank", rank("other")).where(F.col("rank") <= k)
    if copied == 1:
        matches = best.select(F.col("rep").alias("query"), "rank", F.col("other").alias("idx"), "sim")
    else:
        members = v.join(once.select("vec", "rep"), "vec").select("idx", "rep")
        firsts = members.withColumn("nth", F.row_number().over(W.partitionBy("rep").orderBy("idx"))).where(F.col("nth") <= k)
        named = best.drop("rank").join(firsts.select(F.col("rep").alias("other"), "idx"), "other")
        named = named.withColumn("rank", rank("idx")).where(F.col("rank") <= k).select("rep", "rank", "idx", "sim")
        matches = members.select(F.col("idx").alias("query"), "rep").join(named, "rep").select("query", "rank", "idx", "sim")
    sizes = grouped.groupBy("b").agg(F.count("*").alias("m"))
    away = left.groupBy("b").agg(F.count("*").alias("q")).join(sizes, "b").select((F.col("q") * F.col("m")).alias("pairs"))
    home = placed.groupBy("block").agg((F.count("*") * F.count("*")).alias("pairs")).select("pairs")
    met = away.unionByName(home).agg(F.sum("pairs").alias("pairs"), F.lit(n * n).cast("long").alias("all_pairs"))
    return Nearest(matches.select(F.col("query").cast(kind).alias("query"), "rank", F.col("idx").cast(kind).alias("idx"), "sim"), met)
