"""Byte-level BPE ids of whole texts by the tokenizers library.

The library splits a text into pieces and merges bytes within each piece alone, so the ids of a
piece don't depend on its neighbours. Texts of plain Latin characters are cut by the same rule here
and each distinct piece goes to the library once per worker; any other text goes to it whole, and so does a text
that holds the string of a special token, which the library's plain call takes for that token.
"""

from __future__ import annotations

import itertools
import operator
import os
import re
import zlib

import numpy as np

#: Pieces that a worker keeps at most, unless an operator asks for fewer. Half of them are those met since the last turn.
KEPT_PIECES = 1_000_000
#: New pieces that go to the library as one text.
JOINED_PIECES = 128
#: Letters and numbers among the plain characters: fixed values of Unicode.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^ \t\n\r{_LETTER}{_NUMBER}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ſ]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = kept
        #: Pieces from before the last turn; those that are met again come back from here.
        self.before: dict[str, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        #: Whether an id's bytes start with a space.
        vocab = self.tokenizer.get_vocab()
        self.first = np.zeros(max(vocab.values()) + 1, bool)
        self.first[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _add(self, new: list[str]) -> None:
        """Put pieces in. Those that start with their only space are encoded many at a time, as one text: the library cuts it into the same pieces,
        and only a piece's first id has a space in front."""
        plain = [p for p in new if p[0] == " " and p[1:2] > " "]
        runs = ["".join(plain[k : k + JOINED_PIECES]) for k in range(0, len(plain), JOINED_PIECES)]
        for k, e in enumerate(self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)):
            ids, some = np.array(e.ids, "<u4"), plain[k * JOINED_PIECES : (k + 1) * JOINED_PIECES]
            at, raw = (4 * np.flatnonzero(self.first[ids])).tolist(), ids.tobytes()
            if len(at) == len(some) and not at[0] and not (self.special and self.special.search(runs[k])):
                self.update(zip(some, [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)])]))
        alone = [p for p in new if p not in self]
        for p, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self[p] = np.array(e.ids, "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Pieces that aren't known yet go to the library in one call."""
        pieces = [None if _ODD.search(t) or (self.special and self.special.search(t)) else _PIECE.findall(t) for t in texts]
        found = [None if p is None else list(map(self.get, p)) for p in pieces]
        # ids are never empty, but for bytes that a vocabulary lacks, which are looked up once more below
        new = set(itertools.chain.from_iterable(itertools.compress(p, map(operator.not_, f)) for p, f in zip(pieces, found) if p))
        known = {p: self.before[p] for p in new & self.before.keys()}
        if self and len(self) + len(new) > self.kept // 2:
            self.before = dict(self)
            self.clear()
        self.update(known)
        self._add([p for p in new if p not in known])
        return [self.whole(t) if p is None else b"".join([i or self[q] for i, q in zip(f, p)]) for t, p, f in zip(texts, pieces, found)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, kept: int = KEPT_PIECES) -> Encoder:
    """The worker's encoder for a vocabulary file, which every worker has at the same path."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = Encoder(path, kept)
    return _encoders[path, kept]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
