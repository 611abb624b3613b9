"""Vectorised words against plain splitting."""

import random

import numpy as np
import pytest

from vecloom.llm.common import BLOCK, pack, span_hashes, unpack, word_spans


def test_words_and_lines():
    r = random.Random(1)
    parts = [b"a", b"B", b" ", b"\n", b"\x00", "é".encode(), b"\t", b"z"]
    for _ in range(200):
        texts = [b"".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 8))]
        buf, starts, ends, text, line = word_spans(texts)
        got = list(zip(text.tolist(), line.tolist(), (buf[a:b].tobytes() for a, b in zip(starts, ends))))
        assert got == [(i, k, w) for i, t in enumerate(texts) for k, x in enumerate(t.split(b"\n")) for w in x.split()]
        seen = {}
        for h, (_, _, w) in zip(span_hashes(buf, starts, ends).tolist(), got):
            assert seen.setdefault(w.lower(), h) == h
        assert len(set(seen.values())) == len(seen)


def test_words_longer_than_a_block():
    h = span_hashes(*word_spans([b"x" * (BLOCK + 9) + b" Y " + b"q" * BLOCK + b" y " + b"x" * (BLOCK + 9)])[:3])
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("kind", [np.uint8, np.int32, np.int64, np.uint64, np.float32])
def test_packed_columns(kind):
    x = np.random.default_rng(1).integers(0, 200, 77).astype(kind)
    y = unpack(pack(x, x[:0], x[::2]))
    assert (y[0] == x).all() and len(y[1]) == 0 and (y[2] == x[::2]).all() and y[0].dtype == kind
