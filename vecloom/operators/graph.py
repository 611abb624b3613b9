"""Graphs, transition weights, random walks, negative edges and edge embeddings.

edges: src string, dst string, weight double (null: unweighted), once per undirected edge.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from vecloom.functions import rng
from vecloom.functions.vectors import edge_operator
from vecloom.operators import filters
from vecloom.operators.splits import ranks
from vecloom.operators.storage import cut_lineage, drop, settled, ship, written
from vecloom.operators.vocabulary import SENT_ROWS, maybe_sent, numbered


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, smaller end first; the smallest weight of repeated ones."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))


def is_weighted(edges: DataFrame) -> bool:
    """Whether every edge has a weight."""
    return bool(edges.agg(F.bool_and(F.col("weight").isNotNull())).first()[0])


def symmetric(edges: DataFrame, weighted: bool | None = None) -> DataFrame:
    """Both directions, weight 1 unless all edges have one."""
    use = is_weighted(edges) if weighted is None else weighted
    w = F.col("weight") if use else F.lit(1.0)
    # both from one row, so that the edges are made once
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    arcs = edges.select(F.explode(F.when(F.col("src") != F.col("dst"), F.array(there, back)).otherwise(F.array(there))).alias("x"), w.alias("weight"))
    return arcs.select("x.src", "x.dst", "weight")


@dataclass
class Graph:
    """Edges with optional labels (node, label) and features (node, feats)."""

    edges: DataFrame
    label_table: DataFrame | None = None
    feature_table: DataFrame | None = None

    @property
    def has_labels(self) -> bool:
        return self.label_table is not None

    @property
    def has_features(self) -> bool:
        return self.feature_table is not None

    @property
    def labels(self) -> DataFrame:
        if self.label_table is None:
            raise ValueError("the graph has no labels")
        return self.label_table

    @property
    def features(self) -> DataFrame:
        if self.feature_table is None:
            raise ValueError("the graph has no features")
        return self.feature_table

    @property
    def nodes(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()

    def neighbours(self) -> DataFrame:
        return symmetric(self.edges)


def first_order(arcs: DataFrame) -> DataFrame:
    """src, dst, prob: weights over their sum at each node."""
    sums = arcs.groupBy("src").agg(F.sum("weight").alias("total"))
    return arcs.join(sums, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("prob"))


def _second_weight(prev, cand, weight, near, p: float, q: float, variant: str):
    """Weight of a step prev -> here -> cand; near: prev and cand are adjacent."""
    if variant == "reference":
        far = F.when(near, weight / q).otherwise(weight)
    elif variant == "paper":
        far = F.when(near, weight).otherwise(weight / q)
    else:
        raise ValueError(f"variant {variant!r}: 'reference' or 'paper'")
    return F.when(prev.isNull(), weight).when(prev == cand, weight / p).otherwise(far)


def second_order(arcs: DataFrame, p: float = 1.0, q: float = 1.0, variant: str = "reference") -> DataFrame:
    """prev, here, dst, prob of the biased second-order walk."""
    steps = arcs.select(F.col("src").alias("prev"), F.col("dst").alias("here")).join(arcs.select(F.col("src").alias("here"), "dst", "weight"), "here")
    near = arcs.select(F.col("src").alias("prev"), "dst", F.lit(True).alias("near"))
    w = steps.join(near, ["prev", "dst"], "left")
    w = w.withColumn("w", _second_weight(F.col("prev"), F.col("dst"), F.col("weight"), F.coalesce("near", F.lit(False)), p, q, variant))
    return w.select("prev", "here", "dst", (F.col("w") / F.sum("w").over(W.partitionBy("prev", "here"))).alias("prob"))


#: Least neighbours in one row of the table that walks look their steps up in.
SPOKES = 1024
#: Neighbours from which on a node's are dealt to ranges, so that no task gets all of them; below SPOKES squared.
HUB = 1 << 18
BLOCKS = "src string, block int, dsts array<string>, his array<double>"


def _cut(batches):
    """Arcs in the order of (src, dst) as blocks of SPOKES neighbours of one node: BLOCKS. What a task holds is a batch and a block."""
    held, base, first = None, 0.0, 0  # arcs of the block that is still open; the sum and the number of its node's blocks before it
    for batch in itertools.chain(batches, [None]):
        parts = [x for x in (held, None if batch is None else pa.Table.from_batches([batch])) if x is not None and x.num_rows]
        if not parts:
            continue
        t = pa.concat_tables(parts)
        src, dst, w = (t.column(k).combine_chunks() for k in range(3))
        w = w.to_numpy(zero_copy_only=False).astype(np.float64)
        here, before = src[1:], src[:-1]
        differ = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(here.is_null(), before.is_null()))
        new = np.concatenate([[True], differ.to_numpy(zero_copy_only=False)])
        start = np.flatnonzero(new)
        place = np.arange(len(w)) - start[np.cumsum(new) - 1]
        cuts = np.flatnonzero(place % SPOKES == 0)
        block = place[cuts] // SPOKES + np.where(cuts < (start[1] if len(start) > 1 else len(w)), first, 0)
        w[0] += base
        # one after the other, as a running sum in SQL
        hi = np.concatenate([np.cumsum(x) for x in np.split(w, start[1:])])
        end = len(w)
        if batch is not None:
            end = int(cuts[-1])
            if end:  # else the open block is the one that was held
                base, first = (0.0, 0) if new[end] else (float(hi[end - 1]), int(block[-1]))
            held, cuts, block = t.slice(end), cuts[:-1], block[:-1]
        if len(cuts):
            ends = pa.array(np.append(cuts, end), pa.int32())
            yield pa.record_batch([src.take(pa.array(cuts)), pa.array(block, pa.int32()), pa.ListArray.from_arrays(ends, dst), pa.ListArray.from_arrays(ends, pa.array(hi))], ["src", "block", "dsts", "his"])


def _hub_blocks(arcs: DataFrame) -> DataFrame:
    """BLOCKS of hubs, of the root of the degree at least. Sums are taken within ranges of (src, dst) first, so a hub's neighbours
    spread over many tasks, and the ranges' totals carry them on."""
    n = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(arcs.repartitionByRange(n, "src", "dst").withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("src", "range").agg(F.sum("weight").alias("w"), F.count("*").alias("c"))
    before = W.partitionBy("src").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("src", "range", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("base"), F.greatest(F.lit(SPOKES), F.ceil(F.sqrt(F.sum("c").over(W.partitionBy("src"))))).alias("each"))
    order = W.partitionBy("src", "range").orderBy("dst")
    run = dealt.withColumn("own", F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order) - 1)
    run = run.join(bases, ["src", "range"]).withColumn("hi", F.col("base") + F.col("own"))
    rows = run.groupBy("src", "range", F.floor(F.col("place") / F.col("each")).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("hi", "dst"))).alias("x"))
    rows = rows.withColumn("block", (F.row_number().over(W.partitionBy("src").orderBy("range", "piece")) - 1).cast("int"))
    return rows.select("src", "block", F.transform("x", lambda e: e["dst"]).alias("dsts"), F.transform("x", lambda e: e["hi"]).alias("his"))


def _spokes(arcs: DataFrame):
    """(node: src, bounds, total; block: src, block, dsts, his): running sums of a node's weights in the order of
    neighbours, in blocks of SPOKES or, for a hub, of the root of its degree, and the sums at which its blocks end.
    Arcs are written once and move once, to their node; those of hubs move to ranges."""
    ship(arcs.sparkSession)
    arcs = written(arcs.select("src", "dst", F.col("weight").cast("double").alias("weight")), "arcs")
    hubs = cut_lineage(arcs.groupBy("src").count().where(F.col("count") > HUB).select("src"))
    some = not hubs.isEmpty()
    if some:
        hubs = maybe_sent(hubs)
    plain = arcs.join(hubs, "src", "left_anti") if some else arcs
    blocks = plain.repartition("src").sortWithinPartitions("src", "dst").mapInArrow(_cut, BLOCKS)
    if some:
        blocks = blocks.unionByName(_hub_blocks(arcs.join(hubs, "src", "left_semi")))
    blocks = cut_lineage(blocks)
    drop(arcs)
    ends = blocks.select("src", F.element_at("his", -1).alias("end"))
    return ends.groupBy("src").agg(F.array_sort(F.collect_list("end")).alias("bounds"), F.max("end").alias("total")), blocks


def _met(at: DataFrame, blocks: DataFrame) -> DataFrame:
    """at (src, bounds, point, ...) with dst: the neighbour whose share of the weights point falls in."""
    at = at.withColumn("block", F.size(F.filter("bounds", lambda x: x <= F.col("point")))).drop("bounds")
    met = at.join(blocks, ["src", "block"], "left")
    return met.withColumn("dst", F.get("dsts", F.size(F.filter("his", lambda x: x <= F.col("point"))))).drop("dsts", "his", "block")


def _first_step(walks: DataFrame, of_node: DataFrame, blocks: DataFrame, seed: int, epoch: int, step: int) -> DataFrame:
    at = walks.withColumn("src", F.element_at("path", -1)).join(of_node, "src", "left")
    at = at.withColumn("point", rng.uniform(seed, F.lit(epoch), F.col("start"), F.col("walk_no"), F.lit(step)) * F.col("total"))
    met = _met(at, blocks)
    return met.select("start", "walk_no", F.when(F.col("total").isNull(), F.col("path")).otherwise(F.concat("path", F.array("dst"))).alias("path"))


def _starts(arcs: DataFrame, length: int, per_node: int, nodes: DataFrame | None) -> DataFrame:
    if length < 1:
        raise ValueError("a walk has at least one node")
    starts = arcs.select(F.col("src").alias("node")).distinct() if nodes is None else nodes
    return starts.select(F.col("node").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk_no"), F.array("node").alias("path"))


def deepwalk(arcs: DataFrame, length: int, per_node: int = 1, seed: int = 0, epoch: int = 0, nodes: DataFrame | None = None) -> DataFrame:
    """Weighted first-order walks of `length` nodes from every node; a dead end stops a walk. A walk
    meets one row of its node and one block of its neighbours at each step, however many there are."""
    if length > 1:
        of_node, blocks = _spokes(arcs)
        nodes = of_node.select(F.col("src").alias("node")) if nodes is None else nodes
    walks = _starts(arcs, length, per_node, nodes)
    for step in range(1, length):
        walks = _first_step(walks, of_node, blocks, seed, epoch, step)
        if step % 4 == 0:
            walks = cut_lineage(walks)
    return walks.select(F.lit(epoch).alias("epoch"), "start", "walk_no", "path")


def _exact_step(walks: DataFrame, arcs: DataFrame, weigh, seed: int, epoch: int, step: int) -> DataFrame:
    """A step among all neighbours: start, walk_no, dst. walks: start, walk_no, src, prev, path."""
    cand = weigh(walks.join(arcs, "src")).select("start", "walk_no", "dst", "w")
    # the running sum's last value is the total, so intervals fit together without rounding
    order = W.partitionBy("start", "walk_no").orderBy("dst")
    run = cand.withColumn("hi", F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0)))
    run = run.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))).withColumn("total", F.max("hi").over(W.partitionBy("start", "walk_no")))
    point = rng.uniform(seed, F.lit(epoch), F.col("start"), F.col("walk_no"), F.lit(step)) * F.col("total")
    return run.where((point >= F.col("lo")) & (point < F.col("hi"))).select("start", "walk_no", "dst")


def _proposed(asked: DataFrame, of_node: DataFrame, blocks: DataFrame, tries: range, draw) -> DataFrame:
    """start, walk_no, prev, k, dst, u: for each walk of asked (start, walk_no, src, prev) the neighbours that its draws fall on. A walk meets a block once for all
    draws that fall in it; draws come apart afterwards."""
    at = asked.join(of_node, "src")
    # a node's one block has all draws
    points = lambda ks: F.transform(ks, lambda k: F.struct(k.alias("k"), (draw("point", k) * F.col("total")).alias("point"), draw("accept", k).alias("u")))
    every = F.sequence(F.lit(tries[0]), F.lit(tries[-1]))
    among = F.transform(points(every), lambda y: F.struct(y["k"].alias("k"), F.size(F.filter("bounds", lambda x: x <= y["point"])).alias("block")))
    placed = F.when(F.size("bounds") == 1, F.transform(every, lambda k: F.struct(k.alias("k"), F.lit(0).alias("block")))).otherwise(among)
    at = at.withColumn("placed", placed).withColumn("block", F.explode(F.array_distinct(F.transform("placed", lambda x: x["block"]))))
    at = at.withColumn("ks", F.transform(F.filter("placed", lambda x: x["block"] == F.col("block")), lambda x: x["k"])).drop("placed", "bounds")
    steps = F.transform(points("ks"), lambda y: F.struct(y["k"].alias("k"), F.get("dsts", F.size(F.filter("his", lambda x: x <= y["point"]))).alias("dst"), y["u"].alias("u")))
    return at.join(blocks, ["src", "block"]).select("start", "walk_no", "prev", F.explode(steps).alias("x")).select("start", "walk_no", "prev", "x.*")


def node2vec(arcs: DataFrame, length: int, per_node: int = 1, p: float = 1.0, q: float = 1.0, variant: str = "reference", seed: int = 0, epoch: int = 0, nodes: DataFrame | None = None, tries: int = 16, rounds: int = 4) -> DataFrame:
    """Second-order walks. variant 'reference': 1/q at distance one; 'paper': 1/q at distance two.

    A step draws neighbours by plain weights and accepts the first that passes with its bias over the largest bias, which gives
    the biased distribution exactly; each draw meets one block and one look-up of whether it is next to the node
    before, however many neighbours there are. A round makes `tries` draws for each walk that is still open; walks that none of
    `rounds` rounds moved are weighed among all their neighbours, which leaves the distribution as it is."""
    if length > 2:
        arcs = cut_lineage(arcs)
    near = arcs.select(F.col("src").alias("ps"), F.col("dst").alias("pd"))
    probe = lambda c: c.join(near.distinct(), (F.col("key") == F.col("ps")) & (F.col("dst") == F.col("pd")), "left")
    known = _Known(near.select(F.col("ps").alias("u"), F.col("pd").alias("v"))) if length > 2 else None
    bias = lambda weight, known: _second_weight(F.col("prev"), F.col("dst"), weight, known, p, q, variant)
    most = max(1.0, 1 / p, 1 / q)
    if length > 1:
        of_node, blocks = _spokes(arcs)
        nodes = of_node.select(F.col("src").alias("node")) if nodes is None else nodes
    walks = _starts(arcs, length, per_node, nodes)
    if length > 1:
        walks = _first_step(walks, of_node, blocks, seed, epoch, 1)
    for step in range(2, length):
        at = walks.select("start", "walk_no", "path", F.element_at("path", -1).alias("src"), F.when(F.size("path") > 1, F.get("path", F.size("path") - 2)).alias("prev")).join(of_node.select("src", F.lit(True).alias("goes")), "src", "left")
        at = cut_lineage(at)
        open_, moved, left = at.where("goes"), [], None
        for r in range(rounds):
            draw = lambda what, k: rng.uniform(seed, F.lit(epoch), F.col("start"), F.col("walk_no"), F.lit(step), k, F.lit(what))  # noqa: B023, E731
            asked = open_.select("start", "walk_no", "src", "prev")
            c = _proposed(F.broadcast(asked) if left is not None and left <= SENT_ROWS else asked, of_node, blocks, range(r * tries, (r + 1) * tries), draw).withColumn("u", F.col("u") * most)
            # the look-up matters only where the two outcomes differ, and those that a filter of all arcs rules out are done
            c = c.withColumn("key", F.when((F.col("u") < bias(F.lit(1.0), F.lit(True))) != (F.col("u") < bias(F.lit(1.0), F.lit(False))), F.col("prev")))
            c = c.where(F.col("key").isNotNull() | (F.col("u") < bias(F.lit(1.0), F.lit(False))))
            c = written(known.marked(c, "key", "dst"), "draws")
            maybe = c.where("maybe")
            met = cut_lineage(known.met(maybe.select(F.col("key").alias("u"), F.col("dst").alias("v"))).select(F.col("u").alias("ps"), F.col("v").alias("pd")).distinct())
            passed = lambda f, x: f.where(F.col("u") < bias(F.lit(1.0), x)).select("start", "walk_no", "dst", "k")  # noqa: B023, E731
            took = passed(maybe.join(maybe_sent(met), (F.col("key") == F.col("ps")) & (F.col("dst") == F.col("pd")), "left"), F.col("ps").isNotNull())
            took = took.unionByName(passed(c.where(~F.col("maybe")), F.lit(False)))
            moved.append(cut_lineage(took.groupBy("start", "walk_no").agg(F.min_by("dst", "k").alias("dst"))))
            open_ = cut_lineage(open_.join(moved[-1], ["start", "walk_no"], "left_anti"))
            drop(c, met)
            left = open_.count()
            if not left:
                break
        else:
            weigh = lambda c: probe(c.withColumn("key", F.col("prev"))).withColumn("w", bias(F.col("weight"), F.col("ps").isNotNull()))
            moved.append(_exact_step(open_, arcs, weigh, seed, epoch, step))
        steps = moved[0]
        for x in moved[1:]:
            steps = steps.unionByName(x)
        before, walks = at, at.join(steps, ["start", "walk_no"], "left").select("start", "walk_no", F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array("dst"))).alias("path"))
        if step < length - 1:  # the last step's tables are read by the result
            walks = cut_lineage(walks)
            drop(before)
    return walks.select(F.lit(epoch).alias("epoch"), "start", "walk_no", "path")


WALKS = {"deepwalk": deepwalk, "dfs": deepwalk, "node2vec": node2vec}


def register_walk(name: str):
    """Decorator: a walk f(arcs, length, per_node, ..., seed, epoch) by name in lower case; a name is taken once."""

    def add(f):
        if name.lower() in WALKS:
            raise ValueError(f"walk {name!r} is registered already")
        WALKS[name.lower()] = f
        return f

    return add


def walk_generator(name: str):
    """By name, in any case."""
    try:
        return WALKS[name.lower()]
    except KeyError:
        raise ValueError(f"walk {name!r}: one of {sorted(WALKS)}") from None


def walk_sentences(walks: DataFrame) -> DataFrame:
    """Walks as text, nodes parted by spaces."""
    return walks.select("epoch", "start", "walk_no", F.array_join("path", " ").alias("text"))


class _Known:
    """Pairs (u, v) that much asks for: a filter of all rules most out, the others meet the few pairs that a filter of these lets through. So
    the pairs are read and not shuffled."""

    def __init__(self, pairs: DataFrame):
        self.pairs = pairs

    @functools.cached_property
    def _filter(self):
        return filters.pair_filter(self.pairs.select(F.xxhash64("u"), F.xxhash64("v")), self.pairs.count())

    def marked(self, df: DataFrame, u: str, v: str) -> DataFrame:
        """df with maybe: whether its pair may be known; never where u is null."""
        sent, wide = self._filter, df.withColumn("hu", F.xxhash64(u)).withColumn("hv", F.xxhash64(v)).withColumn("some", F.col(u).isNotNull())

        def run(batches):
            for b in batches:
                hit = np.zeros(b.num_rows, bool)
                x, y, some = (b.column(b.num_columns - k) for k in (3, 2, 1))
                hit[sent.value.hits(filters.hashes(x.to_numpy(), y.to_numpy()))] = True
                yield pa.record_batch([*b.columns[:-3], pa.array(hit & some.to_numpy(zero_copy_only=False))], [*b.schema.names[:-3], "maybe"])

        return wide.mapInArrow(run, StructType([*df.schema.fields, StructField("maybe", BooleanType())]))

    def met(self, asked: DataFrame) -> DataFrame:
        """Those of asked (u, v) that are known."""
        count = asked.count()
        if count <= SENT_ROWS:
            return self.pairs.join(F.broadcast(asked), ["u", "v"], "left_semi")
        few = filters.pair_filter(asked.select(F.xxhash64("u"), F.xxhash64("v")), count)
        near = filters.held(self.pairs.withColumn("hu", F.xxhash64("u")).withColumn("hv", F.xxhash64("v")), "hu", "hv", few)
        return near.select("u", "v").join(asked, ["u", "v"], "left_semi")


#: A table of at most this many nodes is sent to Python workers as a list of names.
SENT_NODES = 8_000_000


class NonEdges:
    """Draws of non-neighbours from the nodes of arcs (src, dst), for any number of samples. Draws get their names from a list of nodes that is sent, and those
    that a filter of all pairs rules out as neighbours are done; only the others meet the pairs, of which a filter of these draws
    lets few through. So neither draws nor pairs are shuffled as a whole."""

    def __init__(self, arcs: DataFrame, self_loops: bool = True):
        self.spark = arcs.sparkSession
        pairs = arcs.select("src", "dst").distinct()
        if not self_loops:
            pairs = pairs.where("src <> dst").unionByName(pairs.select("src", F.col("src").alias("dst")).distinct())
        # read once for the degrees and once for each round of draws
        self.pairs = written(pairs, "pairs")
        self.known = _Known(self.pairs.select(F.col("src").alias("u"), F.col("dst").alias("v")))
        degree = self.pairs.groupBy("src").agg(F.count("*").alias("degree"))
        self.order = settled(lambda: numbered(degree.select(F.col("src").alias("node"), "degree"), [F.col("node")]).select(F.col("idx").cast("long").alias("i"), "node", "degree"))
        self.count = self.order.count()
        self.open = settled(lambda: numbered(self.order.where(F.col("degree") < self.count).select("node", F.col("i").alias("all")), [F.col("node")]).select(F.col("idx").cast("long").alias("iu"), "all", F.col("node").alias("u")))
        self.starts = self.open.count()
        self.sent = self.count <= SENT_NODES

    @functools.cached_property
    def _names(self):
        """The names of nodes by number, and the numbers of those that have a non-neighbour."""
        names, some = self.order.orderBy("i").select("node").toArrow(), self.open.orderBy("iu").select("all").toArrow()
        return ship(self.spark).sparkContext.broadcast((names["node"].combine_chunks(), some["all"].to_numpy().astype(np.int32)))

    def _named(self, draws: DataFrame) -> DataFrame:
        """draws (sample, iu, i, ...) with u and v."""
        if not self.sent:
            return draws.join(self.open.select("iu", "u"), "iu").join(self.order.select("i", F.col("node").alias("v")), "i")
        sent, at = self._names, [draws.columns.index(c) for c in ("iu", "i")]

        def run(batches):
            names, some = sent.value
            for b in batches:
                u, v = some[b.column(at[0]).to_numpy()], b.column(at[1])
                yield pa.record_batch([*b.columns, names.take(pa.array(u)), names.take(v)], [*b.schema.names, "u", "v"])

        return draws.mapInArrow(run, StructType([*draws.schema.fields, StructField("u", StringType()), StructField("v", StringType())]))

    def _marked(self, named: DataFrame, many: bool) -> DataFrame:
        """named with maybe: whether the pair may be in the graph; all may where there are few."""
        return self.known.marked(named, "u", "v") if many else named.withColumn("maybe", F.lit(True))

    def drawn(self, n: int, seed: int = 0, tries: int = 20) -> DataFrame:
        """sample, u, v, as negative_edges() has them."""
        spark = self.spark
        if not self.starts:
            return spark.createDataFrame([], "sample long, u string, v string")
        mine = ["sample", "iu", "i"] if self.sent else ["sample", "u", "v"]
        # most first draws will do, so later ones are made for the samples that are still open alone
        rest, taken, done, left = spark.range(n).select(F.col("id").alias("sample"), rng.integer(self.starts, seed, F.lit("u"), F.col("id")).alias("iu")), [], 0, n
        while done < tries:
            last = min(tries, max(1, 4 * done))
            draws = rest.select("sample", "iu", F.explode(F.sequence(F.lit(done), F.lit(last - 1))).alias("k")).withColumn("i", rng.integer(self.count, seed, F.lit("v"), F.col("sample"), F.col("k")))
            marked = self._marked(self._named(draws), left * (last - done) > SENT_ROWS)
            # the filter tells most draws; of the others the names stay
            named = written(marked.select("sample", "iu", "i", "k", "maybe", *(F.when(F.col("maybe") | F.lit(not self.sent), F.col(c)).alias(c) for c in ("u", "v"))), "draws")
            maybe = named.where("maybe")
            known = cut_lineage(self.known.met(maybe.select("u", "v")))
            free = maybe.join(known, ["u", "v"], "left_anti")
            sure = named.where(~F.col("maybe"))
            if last - done == 1:
                taken += [sure.select(*mine), cut_lineage(free.select(*mine))]
                rest = cut_lineage(maybe.join(known, ["u", "v"], "left_semi").select("sample", "iu"))
            else:
                every = [F.col(c) for c in mine[1:]]
                best = cut_lineage(sure.unionByName(free).groupBy("sample").agg(F.min_by(F.struct(*every), "k").alias("e")).select("sample", "e.*"))
                taken.append(best)
                rest = cut_lineage(rest.join(best.select("sample"), "sample", "left_anti"))
                drop(named)
            drop(known)
            done, left = last, rest.count()
            if not left:
                break
        found = functools.reduce(DataFrame.unionByName, taken)
        found = (self._named(found) if self.sent else found).select("sample", "u", "v")
        if not left:
            return found
        rest = cut_lineage(maybe_sent(rest).join(self.open.select("iu", "u"), "iu").join(self.order.select(F.col("node").alias("u"), "degree"), "u"))
        rank = rng.integer(F.lit(self.count) - F.col("degree"), seed, F.lit("rank"), F.col("sample"))
        known = self.pairs.join(maybe_sent(rest.select(F.col("u").alias("src")).distinct()), "src").join(self.order.select(F.col("node").alias("dst"), "i"), "dst").select(F.col("src").alias("u"), "i")
        by_rank = unmet(rest.select("sample", "u", rank.alias("rank")), known, self.count)
        return found.unionByName(by_rank.join(self.order.select("i", F.col("node").alias("v")), "i").select("sample", "u", "v"))


def negative_edges(arcs: DataFrame, n: int, seed: int = 0, tries: int = 20, self_loops: bool = True) -> DataFrame:
    """sample, u, v: a uniform node that has a non-neighbour and a uniform partner that isn't its neighbour: the
    first of `tries` draws that will do, else the non-neighbour whose rank is drawn. So there are n rows
    unless all nodes are neighbours of all. Self-loops and repeated pairs may come, as in
    the original scheme, unless self_loops is off."""
    return NonEdges(arcs, self_loops).drawn(n, seed, tries)


#: Least numbers of nodes in one block of a neighbour list.
GAPS = 1024


def unmet(asked: DataFrame, known: DataFrame, count: int, width: int | None = None) -> DataFrame:
    """sample, u, i: the node that has the given rank (from 0) among those of 0 to count - 1 that u doesn't know.

    asked: sample, u, rank; known: u, i, distinct. Numbers are cut into blocks of `width` (GAPS or the root of count). A block's neighbours
    lie in one row, and one row of u says how many unknown nodes come before each of its blocks, so a
    rank meets two rows of at most the root of count entries, whatever the degree of u."""
    width = width or max(GAPS, int(count**0.5) + 1)
    blocks = cut_lineage(known.groupBy("u", F.floor(F.col("i") / width).cast("long").alias("block")).agg(F.array_sort(F.collect_list("i")).alias("near")))
    before = W.partitionBy("u").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    runs = blocks.select("u", "block", F.coalesce(F.sum(F.size("near").cast("long")).over(before), F.lit(0)).alias("met"))
    of_node = runs.groupBy("u").agg(F.array_sort(F.collect_list(F.struct((F.col("block") * width - F.col("met")).alias("free"), "block", "met"))).alias("runs"))
    # the last block before which at most `rank` nodes are unknown
    at = asked.join(of_node, "u", "left").withColumn("run", F.try_element_at(F.filter("runs", lambda x: x["free"] <= F.col("rank")), F.lit(-1)))
    at = at.select("sample", "u", F.col("run.block").alias("block"), (F.col("rank") + F.coalesce(F.col("run.met"), F.lit(0))).alias("from"))
    met = at.join(blocks, ["u", "block"], "left")
    return met.select("sample", "u", F.aggregate(F.coalesce("near", F.array().cast("array<long>")), F.col("from"), lambda r, x: F.when(x <= r, r + 1).otherwise(r)).alias("i"))


def train_edges(edges: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """edges with train: the first round(ratio * n) of a seeded order, halves to even."""
    if not hasattr(edges, "_vecloom_path"):
        edges = written(edges, "edges")
    n = edges.count()
    m = round(ratio * n)
    drawn = edges.withColumn("__d", rng.bits(seed, F.col("src"), F.col("dst")))
    order = ["__d", "src", "dst"]
    # only the range of draws that holds the m-th edge is ranked; all others are told by their draws
    part = F.shiftright("__d", rng.SPAN.bit_length() - 1 - min(30, max(8, (n >> 16).bit_length())))
    sizes = drawn.groupBy(part.alias("part")).agg(F.count("*").alias("size")).withColumn("end", F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)))
    at = sizes.where(F.col("end") >= m).orderBy("part").first() if 0 < m <= n else None
    if at is None:
        return edges.withColumn("train", F.lit(m > 0))
    near = drawn.where(part == at.part).select(*order, F.row_number().over(W.orderBy(*order)).alias("__r")).where(F.col("__r").between(m - at.end + at.size, m - at.end + at.size + 1)).orderBy("__r").collect()
    if len(near) > 1 and near[0][:3] == near[1][:3]:  # repeated edges on both sides of the cut
        return ranks(edges, rng.bits(seed, F.col("src"), F.col("dst")), ["src", "dst"], n=n).withColumn("train", F.col("__r") <= m).drop("__r")
    last = F.struct(*(F.lit(x).cast(t).alias(c) for x, c, t in zip(near[0][:3], order, ("long", "string", "string"))))
    return drawn.withColumn("train", F.struct(*order) <= last).drop("__d")


#: Vectors of at most this many bytes are sent to every executor to meet pairs.
SENT_VECTORS = 128 << 20


def edge_embeddings(pairs: DataFrame, vectors: DataFrame, operator: str) -> DataFrame:
    """pairs (u, v, ...) with emb, from vectors (node, vec)."""
    f = edge_operator(operator)
    rows, dims = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    if rows * (8 * (dims or 0) + 48) <= SENT_VECTORS:
        vectors = F.broadcast(vectors)
    a, b = vectors.select(F.col("node").alias("u"), F.col("vec").alias("__a")), vectors.select(F.col("node").alias("v"), F.col("vec").alias("__b"))
    return pairs.join(a, "u").join(b, "v").withColumn("emb", f("__a", "__b")).drop("__a", "__b")
