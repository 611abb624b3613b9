"""Edges that are made by a long job are made once, whatever reads them afterwards."""

import pytest

from vecloom.operators import graph


def _counted(spark, seen, rows, schema):
    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, schema).mapInArrow(run, schema)


EDGES = [(f"n{i}", f"n{j}", 1.0) for i in range(12) for j in range(i + 1, 12) if (i * j) % 3]


@pytest.mark.parametrize("what", ["symmetric", "train_edges", "negative_edges"])
def test_edges_are_made_once(spark, what):
    seen = spark.sparkContext.accumulator(0)
    edges = _counted(spark, seen, EDGES, "src string, dst string, weight double")
    if what == "symmetric":
        got = {tuple(r) for r in graph.symmetric(edges, True).collect()}
        assert got == {e for a, b, w in EDGES for e in ((a, b, w), (b, a, w))}
    elif what == "train_edges":
        got = graph.train_edges(edges, 0.5, seed=5).collect()
        assert len(got) == len(EDGES) and sum(r.train for r in got) == round(0.5 * len(EDGES))
    else:
        near = {e for a, b, _ in EDGES for e in ((a, b), (b, a))}
        got = graph.negative_edges(graph.symmetric(edges, True), 50, seed=3).collect()
        assert len(got) == 50 and not any((r.u, r.v) in near for r in got)
    assert seen.value == len(EDGES)
