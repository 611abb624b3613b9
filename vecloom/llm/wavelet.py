"""Token ids as wavelet matrices, one per shard.

A shard is one row of a table: its number, its ids as one compressed blob, doc_ids and lengths of
its documents. The blob has one bit-plane for each bit of an id, most significant first; each plane
is the stable partition of the one above. A plane is cut into blocks of `BLOCK` bits, compressed
apart, with the number of ones before each: access, rank and select read one block a plane.
Spark's own writer puts the shards into the table, so any store will do, and a lost task is rerun.

Documents are in ascending doc_id order (null first, repeated ids by a hash of their text). Null text: empty, the
end id alone. Empty table: no shards. Other columns of the table are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.common import materialize, slim, steps, task_number
from vecloom.llm.tokens import crc, default_tokenizer, encoder

MAGIC = b"VWM1"
BLOCK = 1 << 16
SHARD = "task int, part int, n_tokens long, doc_ids array<long>, lengths array<long>, matrix binary"


def build(ids: np.ndarray, bits: int = 16) -> bytes:
    """The file of a sequence of ids under 2**bits."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} takes more than {bits} bits")
    # narrow ids halve what each plane moves
    x, n, planes = ids.astype(np.uint16 if bits <= 16 else np.uint32), len(ids), []
    zip_ = zstandard.ZstdCompressor(level=1)
    for b in range(bits - 1, -1, -1):
        one = (x & x.dtype.type(1 << b)) != 0
        packed = np.packbits(one, bitorder="little")
        blocks = [zip_.compress(packed[k : k + BLOCK // 8].tobytes()) for k in range(0, len(packed), BLOCK // 8)]
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64) if n else np.empty(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<i8")
        planes.append((ranks.tobytes(), np.cumsum([0, *map(len, blocks)]).astype("<i8").tobytes(), b"".join(blocks)))
        x = np.concatenate([x[np.flatnonzero(~one)], x[np.flatnonzero(one)]])
    head = struct.pack("<4sBQ", MAGIC, bits, n)
    return head + b"".join(struct.pack("<Q", len(a) + len(o) + len(d)) + a + o + d for a, o, d in planes)


class Matrix:
    """Reads a file that build() made; touches only the blocks that a call needs."""

    def __init__(self, blob: bytes):
        magic, self.bits, self.n = struct.unpack_from("<4sBQ", blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.blob, at, blocks = blob, 13, -(-self.n // BLOCK)
        self.planes = []
        for _ in range(self.bits):
            (size,) = struct.unpack_from("<Q", blob, at)
            ranks = np.frombuffer(blob, "<i8", blocks + 1, at + 8)
            cuts = np.frombuffer(blob, "<i8", blocks + 1, at + 8 + 8 * (blocks + 1))
            self.planes.append((ranks, cuts, at + 8 + 16 * (blocks + 1)))
            at += 8 + size
        self._zip, self._kept = zstandard.ZstdDecompressor(), {}

    def _block(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self._kept:
            _, cuts, at = self.planes[plane]
            if len(self._kept) >= 64:
                self._kept.clear()
            raw = self._zip.decompress(self.blob[at + cuts[k] : at + cuts[k + 1]])
            self._kept[plane, k] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: min(BLOCK, self.n - k * BLOCK)]
        return self._kept[plane, k]

    def _ones(self, plane: int, i: int) -> int:
        """Ones before place i of a plane."""
        k = i // BLOCK
        return int(self.planes[plane][0][k]) + (int(self._block(plane, k)[: i % BLOCK].sum()) if i % BLOCK else 0)

    def _zeros(self, plane: int) -> int:
        return self.n - int(self.planes[plane][0][-1])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            bit, ones = int(self._block(p, i // BLOCK)[i % BLOCK]), self._ones(p, i)
            value = value << 1 | bit
            i = self._zeros(p) + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int):
        lo, hi = 0, i
        for p in range(self.bits):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self._zeros(p) + a, self._zeros(p) + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before place i."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of a token."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.bits - 1, -1, -1):
            ranks, zeros = self.planes[p][0], self._zeros(p)
            bit = int(i >= zeros)
            want = i - zeros if bit else i
            before = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
            b = int(np.searchsorted(before, want, side="right")) - 1
            i = b * BLOCK + int(np.flatnonzero(self._block(p, b) == bit)[want - int(before[b])])
        return i

    def decode(self) -> np.ndarray:
        """All ids in order."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            _, cuts, at = self.planes[p]
            raw = b"".join(self._zip.decompress(self.blob[at + cuts[k] : at + cuts[k + 1]]) for k in range(len(cuts) - 1))
            one = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=self.n).view(bool) if self.n else np.empty(0, bool)
            zeros, y = self._zeros(p), np.empty_like(x)
            y[np.flatnonzero(~one)] = x[:zeros]
            y[np.flatnonzero(one)] = x[zeros:] | x.dtype.type(1 << (self.bits - 1 - p))
            x = y
        return x.astype(np.uint32)


def write_shards(docs: DataFrame, end_id: int = 0, tokenizer: str | None = None, tokens_per_shard: int = 4_000_000) -> DataFrame:
    """Encode all documents; the shards as a written table, ordered by (task, part)."""
    path, end = tokenizer or default_tokenizer(), np.array([end_id], "<u4").tobytes()
    spark = docs.sparkSession
    df = slim(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def encode(batches):
        enc, task, part = encoder(path), task_number(), 0
        held, ids_of, lengths = [], [], []

        def shard():
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.record_batch(
                [pa.array([task], pa.int32()), pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([list(ids_of)], pa.list_(pa.int64())), pa.array([list(lengths)], pa.list_(pa.int64())), pa.array([build(ids, max(16, int(ids.max()).bit_length()))], pa.binary())],
                ["task", "part", "n_tokens", "doc_ids", "lengths", "matrix"],
            )

        total = 0
        for batch in batches:
            for rows, texts in steps(batch):
                for doc, b in zip(rows.column(0).to_pylist(), enc.encode_all([t.decode("utf-8", "replace") for t in texts])):
                    b += end
                    held.append(b)
                    ids_of.append(doc)
                    lengths.append(len(b) // 4)
                    total += len(b) // 4
                    if total >= tokens_per_shard:
                        yield shard()
                        held, ids_of, lengths, total, part = [], [], [], 0, part + 1
        if held:
            yield shard()

    return materialize(df.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(encode, SHARD), "wavelet")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards' files."""
    sizes = shards.groupBy("task").agg(F.sum("n_tokens").alias("all"))
    base = sizes.select("task", (F.sum("all").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1))).alias("base"))
    within = shards.select("task", "part", F.coalesce(F.sum("n_tokens").over(W.partitionBy("task").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = within.join(base, "task").select("task", "part", (F.col("before") + F.coalesce("base", F.lit(0))).alias("start"))

    def read(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                start, docs, lengths, blob = (batch.column(k)[row].as_py() for k in range(4))
                raw = Matrix(blob).decode().astype("<u4").tobytes()
                ends = np.cumsum(np.array(lengths, np.int64))
                crcs = [crc(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths)]
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(start + ends - np.array(lengths, np.int64)), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(starts, ["task", "part"]).select("start", "doc_ids", "lengths", "matrix").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, token: int) -> DataFrame:
    """Per shard: occurrences of a token and the places of the first and the last."""

    def find(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                task, part, blob = (batch.column(k)[row].as_py() for k in range(3))
                m = Matrix(blob)
                n = m.count(token)
                yield pa.record_batch([pa.array([task], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([m.select(token, 0) if n else None], pa.int64()), pa.array([m.select(token, n - 1) if n else None], pa.int64())], ["task", "part", "n", "first", "last"])

    return shards.select("task", "part", "matrix").mapInArrow(find, "task int, part int, n long, first long, last long")
