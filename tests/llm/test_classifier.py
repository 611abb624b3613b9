"""The quality classifier: fold, threshold and accuracy on rows that it has not seen."""

import os
import zlib

import pytest

from vecloom.llm import classifier

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not found")
def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = classifier.score(spark.read.parquet(f"{DATA}/documents.parquet"), labels).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    quality = {r.doc_id: r.quality for r in labels.where("quality IS NOT NULL").collect()}
    seen = [(r.score, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    good, bad = [s for s, q in seen if q], [s for s, q in seen if not q]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert wins / (len(good) * len(bad)) >= 0.95
    assert sum((s >= 0.7) == q for s, q in seen) / len(seen) >= 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "some words", None), (3, "a b", "z"), (3, "a b", "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = classifier.score(docs, none).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {0}
    assert classifier.score(docs.limit(0), none).count() == 0
