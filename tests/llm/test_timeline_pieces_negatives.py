"""The painted timeline, the prefix table and bit-sliced products against brute force and the library."""

import hashlib
import math
import random

import numpy as np
import pytest
import sentencepiece

from vecloom.llm import negatives, pieces, point_in_time

# ---------------------------------------------------------------- painted timeline


def _answer(versions, key, t):
    usable = [v for v in versions if None not in v[:4] and v[0] == key and v[1] <= t and v[2] <= t < v[3]]
    return max(usable, key=lambda v: (v[1], v[2], v[4]), default=None)


def test_timeline_claims_once():
    line = point_in_time.TimeLine(10)
    assert line.claim(2, 5, "a") and line.claim(0, 10, "b") and not line.claim(1, 9, "c")
    assert line.owner == ["b"] * 2 + ["a"] * 3 + ["b"] * 5


@pytest.mark.parametrize("chunk", [7, 64])
def test_as_of_is_brute_force(spark, chunk):
    r = random.Random(chunk)
    versions = [(r.choice(["hot", "hot", "a", None]), r.randint(-40, 200), r.randint(-60, 220), r.randint(-40, 260), i // 2, "p%d" % i, 1) for i in range(400)]
    versions += [versions[0], versions[0], ("a", None, 1, 2, 900, "x", 1), ("a", 1, None, 2, 901, "x", 1), ("a", 1, 1, None, 902, "x", 1), ("a", 5, 5, 5, 903, "x", 1), ("wide", -300, -300, 300, 904, "w", 1)]
    asked = [(r.choice(["hot", "a", "none", None, "wide"]), r.choice([None, *range(-50, 250)]), k // 2, "q") for k in range(500)]
    v = spark.createDataFrame(versions, "key string, event long, arrival long, expiry long, version_id long, text string, winner int").repartition(5)
    q = spark.createDataFrame(asked, "key string, t long, winner long, cell string")
    got = sorted(((x.question.key, x.question.t, x.question.winner, x.winner and (x.winner.event, x.winner.arrival, x.winner.version_id)) for x in point_in_time.as_of(v, q, chunk).collect()), key=repr)
    want = []
    for key, t, k, _ in asked:
        w = _answer(versions, key, t) if t is not None and key is not None else None
        want.append((key, t, k, w and (w[1], w[2], w[4])))
    assert got == sorted(want, key=repr)
    assert any(w[3] for w in want) and not all(w[3] for w in want)


def test_as_of_empty_tables(spark):
    v = spark.createDataFrame([("a", 1, 1, 9, 7)], "key string, event long, arrival long, expiry long, version_id long")
    q = spark.createDataFrame([("a", 3)], "key string, t long")
    assert point_in_time.as_of(v, q.limit(0)).collect() == []
    assert point_in_time.as_of(v.limit(0), q).first().winner is None
    assert point_in_time.as_of(v, q).first().winner.version_id == 7


def test_feature_join(spark):
    docs = [(k, "s%d" % (k % 3) if k % 11 else None, k, None if k % 5 == 0 else "en", "t", "clash") for k in range(3000)] + [(None, "s1", 1, "en", None, None), (7, "s2", 5, "fr", "", None)]
    labels = [(k, 1, "clash") for k in range(0, 3300, 4)] + [(8, 0, None), (None, 1, None), (None, 1, None), (7, 1, None)]
    got = point_in_time.feature_join(spark.createDataFrame(docs, "doc_id long, source string, n_chars long, lang string, text string, t string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, version_id string")).collect()
    part = lambda k, i: int(hashlib.sha256(str(k).encode()).hexdigest()[8 * i : 8 * i + 8], 16)
    versions, source = [], {}
    for k, s, n, lang, *_ in docs:
        if k is not None:
            e = part(k, 0) % 200000
            versions.append((s, e, e - 60 + part(k, 1) % 1200, e + part(k, 2) % 900, k, n, lang))
            source[k] = max(filter(None, (source.get(k), s)), default=None)
    want = []
    for k, *_ in labels:
        t = None if k is None else part(k, 3) % 200000
        w = _answer([v for v in versions if v[0] == source.get(k)], source.get(k), t) if source.get(k) else None
        age = w and t - w[1]
        fresh = w is not None and age <= 20
        want.append((k, t, w and w[4], age, "none" if w is None else "fresh" if fresh else "stale", w[5] if fresh else None, w[6] if fresh else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {x[4] for x in want} == {"none", "fresh", "stale"}


# ---------------------------------------------------------------- prefix table


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def _texts(library):
    r = random.Random(3)
    plain = ["a", "b", "e", "t", "h", " ", " ", "▁", "n", "i", "1", "\n", "é", "ß", "中", "国", "🎉", "(", "=", "-", "\x00", "\x7f", "в", "а"]
    out = [None, "", " ", "  ", "a", " a", "a  b   c ", " " * 200, "▁a▁▁b", "\n\n\t x", "<s></s><unk><0x41>", "﻿ab", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 40_000, "the and " * 20_000, "中" * 3000]
    out += ["".join(r.choice(plain) for _ in range(r.randint(0, 90))) for _ in range(300)]
    out += ["".join(chr(r.choice([r.randint(1, 0x24F), r.randint(0x370, 0x5FF), r.randint(0x3040, 0x9FFF)])) for _ in range(r.randint(0, 40))) for _ in range(100)]
    return out + ["".join(library.id_to_piece(r.randint(3, 31999)) for _ in range(r.randint(0, 40))) for _ in range(100)]


def test_encode_is_the_library(spark, library):
    texts = _texts(library)
    rows = [(k, t, k * 2, "x") for k, t in enumerate(texts)] + [(3, "a", 1, None), (3, "a", 1, None), (None, "a b", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long, `a b` string").repartition(3)
    encoded = pieces.encode(df)
    assert sorted(encoded.columns) == ["a b", "doc_id", "ids"]
    got = sorted(((x.doc_id, x.ids, x.text) for x in pieces.decode(encoded).collect()), key=repr)
    want = []
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((k, ids, library.decode(ids)))
    assert got == sorted(want, key=repr)


def test_decode_any_ids(library):
    r, c = random.Random(5), pieces.codec(pieces.default_model())
    for _ in range(1500):
        ids = [r.choice([r.randint(0, 31999), r.randint(0, 260), r.randint(3, 258)]) for _ in range(r.randint(0, 12))]
        assert c.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_each_prefix_ends_in_its_own_last_piece(library):
    c = pieces.codec(pieces.default_model())
    text = "▁internationalisation"
    for i, p in enumerate(c.table(text), 1):
        assert library.encode(text[1:i], out_type=str)[-1:] == ([p] if i > 1 else [])


def test_digests(spark, library):
    texts = [None, "", "Hello  world", "é\n½"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pieces.digests(df).collect():
        ids = library.encode(texts[x.doc_id] or "", add_eos=True)
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and x.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.digests(df.limit(0)).collect() == []


# ---------------------------------------------------------------- bit-sliced products


@pytest.mark.parametrize("size", [3, 200, 1 << 22, 1 << 28])
def test_qualifying_is_exact(size):
    r = np.random.default_rng(size)
    q, x = r.integers(-size, size + 1, (20, 16)), r.integers(-size, size + 1, (300, 16))
    score = q @ x.T
    need, cap = np.sort(score, 1)[:, 200], np.sort(score, 1)[:, 290]
    a, b, s = negatives.qualifying(q, x, need, cap)
    inside = (score >= need[:, None]) & (score <= cap[:, None])
    assert set(zip(a.tolist(), b.tolist(), s.tolist())) == {(i, j, int(score[i, j])) for i, j in zip(*np.nonzero(inside))}


def _mine(rows, anchor, k=5, n=3):
    ok = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None and None not in v]
    anchors = {}
    for i, lab, v in ok:
        if anchor(i):
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        met = sorted((-sum(map(lambda p, q: p * q, v, w)), i, m) for i, m, w in ok if i != a and len(w) == len(v))
        for s, i, _ in [x for x in met if x[2] == lab][:k]:
            good = [x for x in met if x[2] != lab and -50 * s <= -100 * x[0] <= -95 * s][:n]
            out += [(a, i, rank, j, -s, -t) for rank, (t, j, _) in enumerate(good, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_mine_is_brute_force(spark, block_bytes):
    r = np.random.default_rng(1)
    centre = r.integers(-60, 60, (4, 8))
    rows = [(i, int(r.integers(4)), [int(v) for v in centre[r.integers(4)] + r.integers(-40, 40, 8)]) for i in range(300)]
    rows += [rows[5], rows[6], rows[0], (301, None, [1] * 8), (None, 1, [1] * 8), (302, 1, None), (303, 1, [1, None] * 4), (350, 2, [1, 2]), (351, 2, [3, 4]), (352, 1, [2, 2]), (400, 1, []), (401, 1, []), (402, 2, []), (450, 0, [0] * 8)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, label long, vec array<long>, score int").repartition(4)
    got = negatives.mine(df, "vec_id % 25 = 0", block_bytes=block_bytes).collect()
    want = _mine(rows, lambda i: i % 25 == 0)
    assert sorted(map(tuple, got)) == want and len(want) > 60


def test_hard_negatives(spark):
    r = np.random.default_rng(2)
    rows = [(i, int(i % 3), [float(np.float32(v)) for v in r.normal(0.1, 0.2, 6)]) for i in range(260)]
    rows += [(300, 1, [math.nan] * 6), (350, 1, [math.inf] + [0.0] * 5), (301, None, [0.5] * 6), (302, 1, None), (303, 1, [None] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    whole = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * v) for v in e]) for i, lab, e in rows[:260]]
    assert sorted(map(tuple, negatives.hard_negatives(df).collect())) == _mine(whole, lambda i: i % 50 == 0)
    assert negatives.hard_negatives(df.limit(0)).collect() == []
