"""Sentences to indices and back."""

from pyspark.sql import functions as F

from vecloom.operators import vocabulary


def test_sentences_stay_whole(spark, monkeypatch):
    """A vocabulary that is sent and one that isn't give the same; the former shuffles nothing."""
    rows = [(1, 0, ["b", "a", "x", "b"]), (1, 1, ["x"]), (2, 0, []), (3, 0, None), (4, 7, ["c", "<unk>", "a"])]
    s = spark.createDataFrame(rows, "d long, l int, tokens array<string>").withColumn("k", F.struct("d", "l"))
    v = spark.createDataFrame([("<unk>", 0), ("a", 1), ("b", 2), ("c", 3)], "token string, idx int")
    want = {(1, 0): [2, 1, 0, 2], (1, 1): [0], (4, 7): [3, 0, 1]}
    back = {(1, 0): ["b", "a", "<unk>", "b"], (1, 1): ["<unk>"], (4, 7): ["c", "<unk>", "a"]}
    for most in (4, 3):
        monkeypatch.setattr(vocabulary, "SENT_TOKENS", most)
        ids = vocabulary.encode(s, v, "k")
        assert {tuple(r.k): r.ids for r in ids.collect()} == want
        out = vocabulary.decode_sentences(ids, v, "k")
        assert {tuple(r.k): r.tokens for r in out.collect()} == back
        assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == (most == 3)
