"""Pairs are counted once for both directions, texts tokenised once."""

import random

from pyspark.sql import functions as F

from vecloom.functions import text
from vecloom.operators.vocabulary import pair_counts


def _plain(lists, radius):
    n = {}
    for t in lists:
        for i in range(radius, len(t) - radius):
            for k in range(-radius, radius + 1):
                if k:
                    n[t[i], t[i + k]] = n.get((t[i], t[i + k]), 0) + 1
    return n


def test_pair_counts(spark):
    r = random.Random(3)
    lists = [[r.choice(["a", "b", "c", "é", "B", None]) for _ in range(r.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in lists], "tokens array<string>")
    for radius in (1, 2, 3):
        got = [((x.center, x.ctx), x.n) for x in pair_counts(df, radius).collect()]
        assert len(got) == len(dict(got)) and dict(got) == _plain(lists, radius)


def test_both_directions_are_one_group(spark):
    df = spark.createDataFrame([([f"w{k}" for k in range(40)],)], "tokens array<string>")
    out = pair_counts(df, 2)
    assert out.count() == 144
    plan = out._jdf.queryExecution().optimizedPlan()
    while "Aggregate" not in plan.nodeName():
        plan = plan.children().head()
    groups = out.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan).count()
    assert groups == 37 + 38  # at distance one and two, one of them a centre at least


def test_a_text_is_tokenised_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d"), (3, None), (4, "")], "id int, text string")
    s = text.sentences(df, radius=2, max_length=5)
    assert [(x.id, x.tokens) for x in s.collect()] == [(1, list("abcde"))]
    assert s.where(F.size("tokens") >= 5)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
