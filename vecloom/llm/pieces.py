"""SentencePiece BPE: ids of whole texts, and texts of ids.

The library starts from characters and again and again merges the two neighbours whose join is the best piece, the
leftmost of equals. So the ids of a prefix of a text don't depend on what follows, except for merges across its end: each
prefix has exactly one last piece. It is the one piece that ends there (an automaton finds all of
them) and is compatible with the last piece of the prefix before it: merging the characters of both gives just these two. Pieces
all of whose neighbours are compatible are the encoding, so a text takes one step for each piece that occurs in it,
and its ids are read off backwards.

No piece reaches over a place where a mark of space follows another character, nor over a character that
occurs in no longer piece. Texts are cut there, and each worker keeps the ids of units it has met.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import CACHE_WORDS, ship

SPACE = "▁"
#: Units of more characters aren't kept.
KEPT_CHARS = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Merges(dict):
    """(left, right) -> whether two pieces stay apart where they meet; ("", piece) -> whether the piece's characters
    merge into it.

    A piece's edge grows while its characters merge: each part that ever lies there is (part, score at which it arose,
    score at which it was merged on). Where scores only fall, a part of the left piece's right edge merges with
    one of the right piece's left edge if their join is a piece that comes before either is merged on. Where
    scores don't only fall, the characters of both are merged to see."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.edges: dict[str, tuple | None] = {}

    def merged(self, text: str):
        """(what the characters of text merge into, the scores of the merges, the edges that were)."""
        parts, score, took = list(text), self.scores.get, []
        left, right = [(parts[0], math.inf)], [(parts[-1], math.inf)]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts, took, left, right
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            took.append(best)
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 1:
                right.append((parts[-1], best))

    def edge(self, piece: str):
        """(left edge, right edge) of a piece, None where merges don't fall in score or don't give the piece."""
        if piece not in self.edges:
            parts, took, *both = self.merged(piece)
            ok = len(parts) == 1 and all(x >= y for x, y in zip(took, took[1:]))
            self.edges[piece] = tuple([(p, s, up) for (p, s), up in zip(e, [*(s for _, s in e[1:]), -math.inf])] for e in both) if ok else None
        return self.edges[piece]

    def apart(self, a: str, b: str) -> bool:
        x, y = self.edge(a), self.edge(b)
        if x is not None and y is not None:
            score = self.scores.get
            for p, arose_p, up_p in x[1]:
                for q, arose_q, up_q in y[0]:
                    s = score(p + q)
                    if s is not None and s > up_p and s >= up_q:
                        if s < arose_p and s < arose_q:
                            return False
                        return self.merged(a + b)[0] == [a, b]
            return True
        return self.merged(a + b)[0] == [a, b]

    def __missing__(self, pair):
        if len(self) >= 8 * CACHE_WORDS:
            self.clear()
        a, b = pair
        out = self[pair] = self.apart(a, b) if a else self.merged(b)[0] == [b]
        return out


class Codec(dict):
    """unit of text -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("the model has no pieces for bytes")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.code = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.end = sp.eos_id()
        self.merges = Merges({p: sp.get_score(i) for p, i in self.ids.items()})
        self.found = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self.found.add_word(p, p)
        self.found.make_automaton()
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a mark of space after another character")
        self.units = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # what an id adds to a text: bytes; control ids nothing, the unknown one its surface
        self.raw = [b"" if sp.is_control(i) else sp.decode([i]).encode() if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.silent = np.array([sp.is_control(i) for i in range(n)])
        self.unknown = np.array([sp.is_unknown(i) for i in range(n)])
        for probe in ("Hello  world 12\n", "½ Ａ x", "a"):
            if self.encode(probe)[:-1].tolist() != sp.encode(probe):
                raise ValueError("not a BPE model that leaves texts as they are")

    def table(self, unit: str) -> list[str]:
        """The last piece of each prefix of unit; a character that no longer piece ends in is one itself."""
        last, merges, done = list(unit), self.merges, -1
        for end, p in self.found.iter(unit):
            if end != done:
                start = end - len(p)
                if merges[last[start], p] if start >= 0 else merges["", p]:
                    last[end] = p
                    done = end
        return last

    def of_unit(self, unit: str) -> bytes:
        last, end, back = self.table(unit), len(unit), []
        while end:
            p = last[end - 1]
            back.append(self.code[p] if p in self.code else np.array([self.byte_ids[b] for b in p.encode()], "<i4").tobytes())
            end -= len(p)
        return b"".join(back[::-1])

    def __missing__(self, unit):
        out = self.of_unit(unit)
        if len(unit) <= KEPT_CHARS:
            if len(self) >= 2 * CACHE_WORDS:
                self.clear()
            self[unit] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """All ids, the end id last."""
        units = self.units.findall(SPACE + text.replace(" ", SPACE)) if text else ()
        return np.frombuffer(b"".join([*map(self.__getitem__, units), np.array([self.end], "<i4").tobytes()]), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: one leading space goes, and each byte that isn't part of a character becomes U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        first = next((i for i in ids.tolist() if self.raw[i]), None)
        if first is not None and not self.unknown[first] and not self.is_byte[first] and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", raw.decode("utf-8", "surrogateescape"))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a model file, which every worker has at the same path."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: Characters or ids that one output batch holds, give or take a text.
STEP = 1 << 21


def _mapped(df: DataFrame, column: str, name: str, kind: str, work) -> DataFrame:
    """df with a column `name`: work(value) of each row's `column`, in batches of bounded size."""
    ship(df.sparkSession)
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            values, start = batch.column(at), 0
            while start < batch.num_rows:
                size, out, end = 0, [], start
                while end < batch.num_rows and size < STEP:
                    out.append(work(values[end]))
                    size += len(out[-1])
                    end += 1
                kept = batch.slice(start, end - start)
                if kind == "string":
                    new = pa.array(out, pa.string())
                else:
                    new = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate(out), pa.int32()))
                yield pa.record_batch([*kept.columns, new], [*batch.schema.names, name])
                start = end

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{name}` {kind}")


def encode(docs: DataFrame, model: str | None = None, column: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `column` replaced by `ids`, array<int>: the ids of the whole text and the end id. A null text counts as an
    empty one, whose only id is the end id. Texts of any length take one step a matching piece. Rows stand for
    themselves, so nulls elsewhere and repeated rows are kept; a column that is already called `ids` is replaced, all others
    stay; an empty table gives an empty one."""
    path = model or default_model()
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (ids, column)), F.col(column).cast("string").alias(column))
    return _mapped(kept, column, ids, "array<int>", lambda x: codec(path).encode(x.as_py())).drop(column)


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids", column: str = "text") -> DataFrame:
    """encoded with `column`, the text of `ids` as the library gives it. Null ids give an empty text; a
    column that is already called `column` is replaced."""
    path = model or default_model()
    kept = encoded.drop(column) if column in encoded.columns else encoded
    return _mapped(kept, ids, column, "string", lambda x: codec(path).decode(x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)))


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256, of the ids and of the text that they give back."""
    both = decode(encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
