"""Walks by rejection and by two-level sums against the exact distributions."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vecloom.operators import graph

EDGES = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0), ("c", "d", 0.5), ("b", "d", 3.0), ("d", "e", 1.0)]


@pytest.fixture(scope="module")
def arcs(spark):
    return graph.symmetric(spark.createDataFrame(EDGES, "src string, dst string, weight double")).cache()


def _steps(walks):
    """Counts of (prev, here, next) over walks of three nodes."""
    return Counter(tuple(r.path) for r in walks.collect())


@pytest.mark.parametrize("variant, p, q, tries, rounds", [("reference", 4.0, 0.5, 16, 4), ("paper", 0.25, 3.0, 1, 1), ("paper", 4.0, 0.5, 2, 3)])
def test_second_order_distribution(spark, arcs, variant, p, q, tries, rounds):
    n = 6000
    got = _steps(graph.node2vec(arcs, 3, n, p, q, variant, seed=2, tries=tries, rounds=rounds))
    assert sum(got.values()) == 5 * n and all(len(k) == 3 for k in got)
    arrived = Counter()
    for (a, b, _), k in got.items():
        arrived[a, b] += k
    for r in graph.second_order(arcs, p, q, variant).collect():
        total = arrived[r.prev, r.here]
        share = got[r.prev, r.here, r.dst] / total
        assert abs(share - r.prob) < 4.5 * math.sqrt(r.prob * (1 - r.prob) / total) + 1e-12, (r, share)


def test_walks_stop_at_dead_ends(spark):
    one_way = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a",), ("c",), ("alone",)], "node string")
    for walk in (graph.deepwalk, graph.node2vec):
        assert {r.start: r.path for r in walk(one_way, 5, nodes=nodes).collect()} == {"a": ["a", "b", "c"], "c": ["c"], "alone": ["alone"]}
        with pytest.raises(ValueError):
            walk(one_way, 0)
        assert walk(one_way, 1).count() == 2


def test_hub_is_cut_into_blocks(spark):
    n = 20_000
    hub = spark.range(n).select(F.lit("hub").alias("src"), F.format_string("n%05d", "id").alias("dst"), (1.0 + F.pmod("id", F.lit(3))).alias("weight"))
    nodes, blocks = graph._spokes(hub)
    rows = blocks.orderBy("block").collect()
    assert len(rows) >= n // 1024 and max(len(r.dsts) for r in rows) <= 1024 and [r.block for r in rows] == list(range(len(rows)))
    assert [d for r in rows for d in r.dsts] == ["n%05d" % i for i in range(n)]
    run, want = 0.0, []
    for i in range(n):
        run += 1 + i % 3
        want.append(run)
    assert [h for r in rows for h in r.his] == want
    node = nodes.first()
    assert node.total == run and node.bounds == [r.his[-1] for r in rows]
    walks = graph.deepwalk(hub, 2, 2000, seed=1, nodes=spark.createDataFrame([("hub",)], "node string"))
    by = Counter(int(r.path[1][1:]) % 3 for r in walks.collect())
    assert all(abs(by[k] / 2000 - (k + 1) / 6) < 0.05 for k in range(3))
