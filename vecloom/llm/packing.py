"""Best-fit packing of token sequences in a hierarchy.

Each task packs its own pieces best-fit decreasing. Bins that are nearly full are final; an
underfull bin goes on as one item, and rounds of fewer and fewer tasks best-fit these items again.
A task of a later round takes about `per_task` items however many there are; once a round merges
next to nothing, or all items fit one task, what is left is final too. No bin or piece is dropped.

A document's ids and an end id are one piece if they fit; longer ones are cut, whole pieces last.
Null text counts as empty (the end id alone). A null doc_id stays null. Repeated rows are packed
each for itself. Empty table: empty result. Other columns of the table are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import materialize, slim, steps, task_number
from vecloom.llm.tokens import crc, default_tokenizer, encoder

PIECE = np.dtype([("doc_id", "<i8"), ("null", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<i8")])
#: Pieces of words that a worker keeps, and bytes of text that it encodes at a time: few, as idle workers of a pipeline keep what they have.
KEPT_PIECES, STEP_BYTES = 300_000, 1 << 19
#: A bin: final or to go on, its fill, its pieces in order.
BIN = "bin_id long, final boolean, fill int, pieces binary"


def best_fit(fills, capacity: int):
    """Bins as lists of item numbers: items in decreasing order, each to the fullest bin it fits."""
    order = np.argsort(-np.asarray(fills), kind="stable").tolist()
    bins, by_room, open_rooms = [], [[] for _ in range(capacity + 1)], 0
    for k in order:
        size = fills[k]
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        left = room - size
        if left:
            if not by_room[left]:
                open_rooms |= 1 << left
            by_room[left].append(b)
    return bins


class _Packer:
    """Collects items of one task; packs them a block at a time so that memory stays bounded."""

    def __init__(self, level: int, capacity: int, slack: int, per_block: int):
        self.base, self.capacity, self.slack, self.per_block = (level << 56) | (task_number() << 32), capacity, slack, per_block
        self.count, self.fills, self.blobs = 0, [], []

    def rows(self, last: bool):
        for members in best_fit(self.fills, self.capacity):
            fill = sum(self.fills[k] for k in members)
            yield self.base + self.count, last or self.capacity - fill <= self.slack, fill, b"".join(self.blobs[k] for k in members)
            self.count += 1
        self.fills, self.blobs = [], []


def _batches(rows, size=20_000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(held):
    a, b, c, d = zip(*held)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.bool_()), pa.array(c, pa.int32()), pa.array(d, pa.binary())], ["bin_id", "final", "fill", "pieces"])


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, slack: int = 2, per_task: int = 200_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path, block, end = tokenizer or default_tokenizer(), per_task, np.array([end_id], "<u4").tobytes()

    def first(batches):
        enc, packer = encoder(path, KEPT_PIECES), _Packer(0, capacity, slack, block)

        def rows():
            for batch in batches:
                for part, texts in steps(batch, limit=STEP_BYTES):
                    for doc, ids in zip(part.column(0).to_pylist(), enc.encode_all([t.decode("utf-8", "replace") for t in texts])):
                        ids += end
                        n, at, k = len(ids) // 4, 0, 0
                        while at < n:
                            size = (n - 1) % capacity + 1 if at == 0 else capacity
                            blob = np.array([(doc or 0, doc is None, k, at, size, crc(ids[4 * at : 4 * (at + size)]))], PIECE).tobytes()
                            if size == capacity:
                                yield packer.base + packer.count, True, size, blob
                                packer.count += 1
                            else:
                                packer.fills.append(size)
                                packer.blobs.append(blob)
                            at, k = at + size, k + 1
                if len(packer.fills) >= block:
                    yield from packer.rows(False)
            yield from packer.rows(False)

        yield from _batches(rows())

    def later(level, last):
        def merge(batches):
            packer = _Packer(level, capacity, slack, block)

            def rows():
                for batch in batches:
                    packer.fills += batch.column(0).to_pylist()
                    packer.blobs += batch.column(1).to_pylist()
                    if len(packer.fills) >= 4 * block:
                        yield from packer.rows(last)
                yield from packer.rows(last)

            yield from _batches(rows())

        return merge

    done, level = [], 0
    bins = materialize(slim(docs).mapInArrow(first, BIN), "pack")
    before = None
    while True:
        done.append(bins.where("final"))
        rest = bins.where("NOT final")
        left = rest.count()
        tasks = -(-left // per_task)
        if left == 0:
            break
        level += 1
        last = tasks == 1 or (before is not None and left > 0.98 * before)
        before = left
        bins = materialize(rest.repartition(tasks, F.xxhash64("bin_id", F.lit(level))).select("fill", "pieces").mapInArrow(later(level, last), BIN), "pack")
        if last:
            done.append(bins)
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)

    def spread(batches):
        for batch in batches:
            ids, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            if not blobs:
                continue
            counts = np.array([len(b) // PIECE.itemsize for b in blobs])
            p = np.frombuffer(b"".join(blobs), PIECE)
            length = p["length"].astype(np.int64)
            ends = np.cumsum(length)
            first_of = np.repeat(np.cumsum(counts) - counts, counts)
            offset = ends - length - (ends - length)[first_of]
            yield pa.record_batch([pa.array(p["doc_id"], mask=p["null"]), pa.array(p["piece"]), pa.array(p["start"]), pa.array(length), pa.array(p["crc"]), pa.array(np.repeat(ids, counts)), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return out.select("bin_id", "pieces").mapInArrow(spread, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
