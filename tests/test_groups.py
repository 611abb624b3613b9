"""Groups of blocks end by rows, not with the tasks that numbered their blocks."""

import numpy as np
from pyspark.sql import functions as F

from vecloom.operators import nearest


def test_runs():
    assert nearest._runs([3, 3, 3, 9, 1, 1], 6).tolist() == [0, 0, 1, 2, 3, 3]
    assert nearest._runs([5], 2).tolist() == [0]


def test_vectors_go_to_few_groups_however_many_tasks(spark, monkeypatch):
    tables, write = {}, nearest.written

    def keep(df, label):
        tables[label] = write(df, label)
        return tables[label]

    monkeypatch.setattr(nearest, "written", keep)
    m = np.random.default_rng(7).normal(size=(400, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "idx int, vec array<double>")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "49")
    try:
        found = nearest.every_nearest(df, 3, block_rows=8)
        got = {(r.query, r["rank"]): r.idx for r in found.matches.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(u @ u.T), axis=1, kind="stable")
    assert got == {(q, k + 1): int(best[q, k]) for q in range(400) for k in range(3)}
    assert tables["asked"].select(F.max(F.size("goes"))).first()[0] <= 9  # over 40 where groups end with tasks
