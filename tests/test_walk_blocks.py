"""Walks' blocks of neighbours: arcs are made once and move once; cuts don't depend on batches, nor on who is a hub."""

import itertools

import pyarrow as pa
import pytest

from vecloom.operators import graph

ARCS = [(f"n{i}", f"n{j}", 0.1 * ((i * j) % 7 + 1)) for i in range(9) for j in range(9 + 4 * i) if i != j] + [(None, "n1", 0.3), (None, "n2", 0.2)]


def _expected(width):
    out = {}
    for src, arcs in itertools.groupby(sorted(ARCS, key=lambda a: (a[0] or "", a[1])), key=lambda a: a[0]):
        total = 0.0
        for k, (_, dst, w) in enumerate(arcs):
            total += w
            out.setdefault((src, k // width), []).append((dst, total))
    return out


@pytest.mark.parametrize("size", [1, 3, 5, 8, 1000])
def test_cuts_do_not_depend_on_batches(monkeypatch, size):
    monkeypatch.setattr(graph, "SPOKES", 5)
    t = pa.Table.from_pylist([dict(zip(("src", "dst", "weight"), a)) for a in sorted(ARCS, key=lambda a: (a[0] or "", a[1]))])
    rows = [r for b in graph._cut(iter(t.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    assert {(r["src"], r["block"]): list(zip(r["dsts"], r["his"])) for r in rows} == _expected(5)
    assert len(rows) == len(_expected(5))
    assert list(graph._cut(iter([]))) == []


def test_arcs_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "src string, dst string, weight double"
    arcs = spark.createDataFrame(ARCS, schema).mapInArrow(run, schema)
    nodes, blocks = graph._spokes(arcs)
    assert {(r.src, r.block): list(zip(r.dsts, r.his)) for r in blocks.collect()} == _expected(graph.SPOKES)
    assert nodes.count() == 10
    assert seen.value == len(ARCS)


def test_hubs_walk_alike(spark, monkeypatch):
    arcs = spark.createDataFrame([(f"n{i}", f"n{j}", float((i * j) % 5 + 1)) for i in range(30) for j in range(30) if i != j and (i < 2 or (i + j) % 6 == 0)], "src string, dst string, weight double")
    walk = lambda: sorted((r.start, r.walk_no, *r.path) for r in graph.deepwalk(arcs, 4, 3, seed=5).collect())
    plain = walk()
    monkeypatch.setattr(graph, "HUB", 8)
    assert walk() == plain and len(plain) == 90
