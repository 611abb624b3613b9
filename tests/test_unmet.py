"""Ranks among the nodes that a node doesn't know, against lists."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vecloom.operators import graph


@pytest.mark.parametrize("width", [1, 3, 16, None])
def test_every_rank(spark, width):
    g, count = random.Random(width or 0), 50
    knows = {"none": [], "all but one": [i for i in range(count) if i != 31], "first": list(range(20)), "last": list(range(30, count)), "odd": list(range(1, count, 2)), "some": sorted(g.sample(range(count), 17))}
    asked, want = [], {}
    for u, near in knows.items():
        for rank, i in enumerate(x for x in range(count) if x not in near):
            want[len(asked)] = (u, i)
            asked.append((len(asked), u, rank))
    a = spark.createDataFrame(asked, "sample long, u string, rank long")
    k = spark.createDataFrame([(u, i) for u, near in knows.items() for i in near], "u string, i long")
    assert {r.sample: (r.u, r.i) for r in graph.unmet(a, k, count, width).collect()} == want


def test_hub_with_few_strangers(spark):
    n = 100_000
    known = spark.range(n).where("id % 20000 <> 7").select(F.lit("hub").alias("u"), F.col("id").alias("i"))
    asked = spark.range(500).select(F.col("id").alias("sample"), F.lit("hub").alias("u"), F.pmod("id", F.lit(5)).alias("rank"))
    got = graph.unmet(asked, known, n).collect()
    assert len(got) == 500 and all(r.i == 20000 * (r.sample % 5) + 7 for r in got)


def test_negative_edges_by_rank_are_uniform(spark):
    """One draw, then ranks: a node next to nearly all of the others."""
    names = [f"n{i:02d}" for i in range(40)]
    arcs = spark.createDataFrame([(a, b, 1.0) for a in names for b in names if b not in ("n03", "n19", "n37")], "src string, dst string, weight double")
    got = Counter(r.v for r in graph.negative_edges(arcs, 3000, seed=4, tries=1).collect())
    assert set(got) == {"n03", "n19", "n37"} and all(abs(x / 3000 - 1 / 3) < 0.05 for x in got.values())
