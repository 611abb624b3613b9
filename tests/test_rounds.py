"""Draws in rounds: later ones are made for what is still open alone."""

import pytest

from vecloom.operators import graph


@pytest.fixture
def ends(monkeypatch):
    """The last places of all sequences of draws."""
    seen, plain = [], graph.F.sequence
    monkeypatch.setattr(graph.F, "sequence", lambda a, b, *c: seen.append(str(b)) or plain(a, b, *c))
    return seen


def test_negatives_take_one_draw_first(spark, ends):
    arcs = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)] + [(f"n{k}", f"n{k}", 1.0) for k in range(60)], "src string, dst string, weight double")
    got = graph.negative_edges(arcs, 200, seed=3).collect()
    assert sorted(r.sample for r in got) == list(range(200)) and all(r.u != r.v for r in got if r.u[0] == "n")
    assert "'0'" in ends[0]
