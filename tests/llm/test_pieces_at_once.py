"""New pieces reach the tokenizers library many at a time, with the ids of whole texts."""

import numpy as np
import pytest

from vecloom.llm import wavelet
from vecloom.llm.tokens import Encoder, default_tokenizer


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.strings = tokenizer, 0

    def encode(self, *args, **options):
        return self.tokenizer.encode(*args, **options)

    def encode_batch_fast(self, texts, **options):
        self.strings += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_pieces_are_encoded_together():
    e = Encoder(default_tokenizer())
    plain, e.tokenizer = e.tokenizer, Counting(e.tokenizer)
    texts = ["".join(f" {chr(97 + k % 26)}{chr(97 + k // 26)}{end}" for k in range(600)) for end in ("", "zq", " !!", " 7")] + ["  two  x\n\n y", "don't, we'll é ü\t9 99 ...", " <|endoftext|> a", " ", ""]
    got = e.encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert e.tokenizer.strings < 60  # over 1200 pieces


def test_pieces_whose_ids_cannot_be_told_apart_are_encoded_alone():
    e = Encoder(default_tokenizer())
    e.first[:] = False
    assert np.frombuffer(e.encode(" plain words here"), "<u4").tolist() == e.tokenizer.encode(" plain words here", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [16, 17])
def test_planes_of_narrow_and_wide_ids(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 200_001).astype(np.uint32)
    m = wavelet.Matrix(wavelet.build(ids, bits))
    assert (m.decode() == ids).all() and m.decode().dtype == np.uint32
    assert m.access(70_000) == ids[70_000] and m.rank(int(ids[5]), 200_001) == int((ids == ids[5]).sum())
