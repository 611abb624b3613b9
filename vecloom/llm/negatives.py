"""Hard negatives by bit-sliced integer products.

Vectors are whole numbers in two's complement, cut into bit-planes. The product of an anchor with a row is built from the
row's planes, most significant first: after each one, what the lower planes can still add lies between the sums
of the anchor's negative and positive components times what these planes can weigh. So each score has an interval that
narrows to the score itself, and a pair is dropped as soon as its interval can't reach what its anchor still needs.

Anchors go out in blocks of bounded size and each block meets all rows in one pass for positives and
one for negatives; a task keeps a few best rows for each anchor, and the tasks' bests are merged.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.common import materialize, ship

#: Bytes of anchors' components in one block.
BLOCK_BYTES = 32 << 20
#: Scores that a step holds at a time.
CELLS = 1 << 22
#: A step goes on with single pairs once fewer than this share of its pairs are left.
SPARSE = 0.15
NONE = -(1 << 62)


def _kind(most: int):
    """The fastest type that holds whole numbers up to `most` exactly."""
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def qualifying(anchors: np.ndarray, rows: np.ndarray, need: np.ndarray, cap: np.ndarray):
    """(anchor number, row number, score) of all pairs with need[anchor] <= score <= cap[anchor], as columns."""
    nothing = (np.empty(0, np.int64),) * 3
    if not len(anchors) or not len(rows):
        return nothing
    most = max(int(np.abs(rows).max(initial=0)), 1)
    planes = most.bit_length()
    kind = _kind(int(np.abs(anchors).sum(1).max()) << (planes + 1))
    q = anchors.astype(kind)
    up, down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    # the plane of signs weighs -2**planes
    score = -(1 << planes) * (q @ (rows < 0).T.astype(kind))
    pairs = None
    for k in range(planes - 1, -1, -1):
        bit = ((rows >> k) & 1).astype(kind)
        rest = (1 << k) - 1
        if pairs is None:
            score += (1 << k) * (q @ bit.T)
            alive = (score >= (need - rest * up)[:, None]) & (score <= (cap - rest * down)[:, None])
            n = int(np.count_nonzero(alive))
            if not n:
                return nothing
            if n < SPARSE * alive.size or k == 0:
                pairs = np.nonzero(alive)
                score = score[pairs].astype(np.int64)
        else:
            a, r = pairs
            for i in range(0, len(a), 1 << 16):
                s = slice(i, i + (1 << 16))
                score[s] += (1 << k) * np.einsum("ij,ij->i", q[a[s]], bit[r[s]]).astype(np.int64)
            alive = (score >= (need - rest * up)[a]) & (score <= (cap - rest * down)[a])
            pairs, score = (a[alive], r[alive]), score[alive]
            if not len(score):
                return nothing
    return *pairs, score


class Best:
    """The k highest scores of each key, ties by smaller id."""

    def __init__(self, keys: int, k: int):
        self.score, self.id = np.full((keys, k), NONE), np.full((keys, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        """What a score must reach to get in."""
        return self.score[:, -1]

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        met, of = np.unique(key, return_inverse=True)
        key = np.concatenate([of, np.repeat(np.arange(len(met)), k)])
        score = np.concatenate([score, self.score[met].ravel()])
        ids = np.concatenate([ids, self.id[met].ravel()])
        order = np.lexsort((ids, -score, key))
        first = np.searchsorted(key[order], np.arange(len(met)))
        top = order[first[:, None] + np.arange(k)]
        self.score[met], self.id[met] = score[top], ids[top]

    def rows(self):
        """(key, score, id) of all that got in."""
        key, at = np.nonzero(self.score > NONE)
        return key, self.score[key, at], self.id[key, at]


def _tiles(batches, anchors: int):
    """(ids, labels, matrix) of rows of one length; the first ones are short, so that bests are known early."""
    limit = 64
    most = max(64, CELLS // max(1, anchors))
    for batch in batches:
        vec = batch.column(2)
        width = np.diff(vec.offsets.to_numpy())
        flat, start = vec.values.to_numpy(), vec.offsets.to_numpy()
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            i = 0
            while i < len(mine):
                at = mine[i : i + limit]
                i += limit
                limit = min(most, 2 * limit)
                yield ids[at], labels[at], flat[start[at][:, None] + np.arange(w)].reshape(len(at), w)


class _Block:
    """Anchors by length of their vectors: (numbers, ids, labels, matrix)."""

    def __init__(self, table: pa.Table):
        self.n, self.by_width = table.num_rows, {}
        table = table.combine_chunks()
        self.ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        vec = table["vec"].chunk(0)
        start = vec.offsets.to_numpy()
        flat, width = vec.values.to_numpy(), np.diff(start)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            self.by_width[int(w)] = (at, self.ids[at], labels[at], flat[start[at][:, None] + np.arange(w)].reshape(len(at), w))


def _positives(rows: DataFrame, block: _Block, k: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        b = sent.value
        best = Best(b.n, k)
        for ids, labels, x in _tiles(batches, b.n):
            numbers, own, kinds, q = b.by_width.get(x.shape[1], (np.empty(0, int),) * 4)
            for label in np.intersect1d(labels, kinds):
                a, r = np.flatnonzero(kinds == label), np.flatnonzero(labels == label)
                i, j, score = qualifying(q[a], x[r], best.least[numbers[a]], np.full(len(a), -NONE))
                i, j = a[i], r[j]
                other = own[i] != ids[j]
                best.add(numbers[i[other]], score[other], ids[j[other]])
        yield pa.record_batch([pa.array(c, pa.int64()) for c in best.rows()], ["anchor", "score", "id"])

    found = rows.mapInArrow(run, "anchor long, score long, id long")
    return _top(found, ["anchor"], k)


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _negatives(rows: DataFrame, block: _Block, positives, k: int, slots: int, low: int, high: int, scale: int) -> DataFrame:
    """positives: score and id of each anchor's positives, by anchor and slot, NONE where there is none."""
    sent = rows.sparkSession.sparkContext.broadcast((block, *positives))

    def run(batches):
        b, p, pid = sent.value
        has = p > NONE
        floor, cap = np.where(has, -((-low * np.where(has, p, 0)) // scale), -NONE), np.where(has, high * np.where(has, p, 0) // scale, NONE)
        floor = np.where(floor > cap, -NONE, floor)
        best = Best(b.n * slots, k)
        for ids, labels, x in _tiles(batches, b.n):
            if x.shape[1] not in b.by_width:
                continue
            numbers, _, kinds, q = b.by_width[x.shape[1]]
            need = np.maximum(floor, best.least.reshape(-1, slots))[numbers]
            a = np.flatnonzero(need.min(1) < -NONE)
            i, j, score = qualifying(q[a], x, need[a].min(1), cap[numbers[a]].max(1))
            i = a[i]
            other = kinds[i] != labels[j]
            i, j, score = i[other], j[other], score[other]
            inside = (score[:, None] >= need[i]) & (score[:, None] <= cap[numbers[i]])
            at, slot = np.nonzero(inside)
            best.add(numbers[i[at]] * slots + slot, score[at], ids[j[at]])
        key, score, vid = best.rows()
        n, slot = key // slots, key % slots
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (b.ids[n], slot, pid[n, slot], p[n, slot], score, vid)], ["anchor_id", "slot", "positive_id", "positive_score", "score", "id"])

    found = rows.mapInArrow(run, "anchor_id long, slot long, positive_id long, positive_score long, score long, id long")
    return _top(found, ["anchor_id", "slot"], k).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label (longs), vec
    (array of longs). anchors: a condition on these columns.

    An anchor's positives are the `positives` rows of its label with the highest inner products, other vec_ids
    only; its negatives for each are the first `negatives` rows of other labels with low * positive <=
    scale * negative <= high * positive. Ties go to the smaller vec_id. Rows with a null vec_id, label, vector or component
    take no part. Vectors meet those of their own length only. A repeated row counts as often as it is there, but a vec_id is
    an anchor once (its smallest label and vector). An empty vector has the product 0 with other empty
    ones. An anchor without positives, or a positive without negatives, gives no row; an empty table gives none. Scores have to
    stay below 2**62. Other columns are ignored."""
    spark = ship(vectors.sparkSession)
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<bigint>").alias("vec")).where("vec_id is not null and label is not null and vec is not null and not exists(vec, x -> x is null)")
    rows = materialize(whole, "vectors")
    chosen = materialize(rows.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.label", "x.vec"), "anchors")
    n, widest = chosen.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    each = max(1, block_bytes // (8 * max(1, widest)))
    # i counts on within a written partition, and a span of `each` numbers never has more rows than that
    dealt = materialize(chosen.repartition(-(-11 * n // (10 * each))).withColumn("i", F.monotonically_increasing_id()), "blocks")
    starts = [r[0] for r in dealt.select(F.expr(f"i div {each}L * {each}L")).distinct().collect()]
    found = []
    for start in sorted(starts):
        block = _Block(dealt.where(F.col("i").between(start, start + each - 1)).drop("i").toArrow())
        p, pid = np.full((block.n, positives), NONE), np.zeros((block.n, positives), np.int64)
        for r in _positives(rows, block, positives).collect():  # `positives` rows for each anchor of the block at most
            p[r.anchor, r.rank - 1], pid[r.anchor, r.rank - 1] = r.score, r.id
        part = _negatives(rows, block, (p, pid), negatives, positives, low, high, scale)
        found.append(materialize(part, "negatives") if len(starts) > 1 else part)
    return functools.reduce(DataFrame.unionAll, found)


def whole_numbers(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vec: each component times `scale`, rounded down. Rows with a null vector, or with a null or
    non-finite component, go. Where vec_id is divisible by 7 the label first becomes (label + 1) % 10."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    x = x.where("vec_id is not null and label is not null and e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return x.select("vec_id", label.alias("label"), F.transform("e", lambda v: F.floor(v * scale)).alias("vec"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """mine() over embeddings with every vec_id divisible by 50 as anchor."""
    return mine(whole_numbers(embeddings), "vec_id % 50 = 0")
