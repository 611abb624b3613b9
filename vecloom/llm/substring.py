"""Removal of word passages that occur earlier, exactly, behind a count-min prefilter.

A window is `size` consecutive words of one document. A first pass counts, in merged sketches of a
fixed width, the lowest-hashed gram within each window: two equal windows choose the same gram at
different places, so a window's count is never underestimated. A second pass groups exactly, by
96-bit hashes, only windows that the sketch takes to be repeated; each task sends one entry
for a window, its first, so a window with a million places is small. What isn't the first of its
group is removed in the third pass, which knows the first places of each document.

Null text: no words. Rows with the same doc_id are ordered by a hash of their text; of rows that are
the same in doc_id and text one is the first. A null doc_id comes before all others. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import bitmap, buckets_for, by_bucket, gram_hashes, hash_words, materialize, pack, slim, steps, test_bits, unpack

GRAM = 10
#: Cells of the sketch; they grow with the input to the largest.
CELLS, MOST_CELLS = 1 << 24, 1 << 30


def window_grams(flat: np.ndarray, size: int, gram: int) -> np.ndarray:
    """For each window the (40-bit hash, place) of its lowest gram, leftmost first, in one uint64."""
    g = gram_hashes(flat, gram, 3)
    n = len(flat) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    low = (g & np.uint64(0xFFFFFFFFFF000000)) | (np.arange(len(g), dtype=np.uint64) & np.uint64(0xFFFFFF))
    need, have = size - gram + 1, 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


class _Text:
    """Vectors over the texts of one step; a window is valid where it ends in the document it starts in."""

    def __init__(self, texts, size: int):
        self.words = [t.split() for t in texts]
        self.flat, self.lens = hash_words(self.words)
        self.starts = np.cumsum(self.lens) - self.lens
        self.row = np.repeat(np.arange(len(texts)), self.lens)
        n = max(0, len(self.flat) - size + 1)
        self.valid = self.row[:n] == self.row[size - 1 : size - 1 + n]
        self.size = size

    def cells(self, width: int):
        """(cell, number of the chosen place) of each window."""
        low = window_grams(self.flat, self.size, min(GRAM, self.size))
        return (low >> np.uint64(24)) % np.uint64(width), low

    def candidates(self, bits, width):
        cells, _ = self.cells(width)
        return np.flatnonzero(self.valid & test_bits(bits, cells)) if len(cells) else np.empty(0, np.int64)


def _chosen(texts, size, width):
    """Cells of the distinct places that windows choose."""
    t = _Text(texts, size)
    cells, low = t.cells(width)
    cells, low = cells[t.valid], low[t.valid]
    if not len(low):
        return cells
    new = np.concatenate([[True], low[1:] != low[:-1]])
    # a place that is chosen, left and chosen again would count twice; that only overestimates
    return cells[new]


def remove_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text."""
    spark = docs.sparkSession
    base = slim(docs)
    n_words = (base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    width = CELLS
    while width < min(MOST_CELLS, n_words):
        width *= 2

    def cells_of(batch):
        for _, texts in steps(batch):
            yield _chosen(texts, size, width)

    bits = bitmap(base, cells_of, width, least=2)
    sent = spark.sparkContext.broadcast(bits)
    per = buckets_for(spark, n_words // 4)

    def send(batches):
        held, count = [], 0

        def flush():
            h0, h1, doc, null, key, at = (np.concatenate(v) for v in zip(*held))
            order = np.lexsort((at, key, doc, ~null, h1, h0))
            h0, h1, doc, null, key, at = (v[order] for v in (h0, h1, doc, null, key, at))
            new = np.concatenate([[True], (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])])
            rows = [v[new] for v in (h0, h1, doc, null.astype(np.uint8), key, at)]
            bucket = (rows[0] % np.uint64(per)).astype(np.int64)
            for k, columns in by_bucket(bucket, *rows):
                yield pa.record_batch([pa.array([k], pa.int64()), pa.array([pack(*columns)], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for rows, texts in steps(batch):
                t = _Text(texts, size)
                c = t.candidates(sent.value, width)
                if not len(c):
                    continue
                h0, h1 = gram_hashes(t.flat, size, 5)[c], (gram_hashes(t.flat, size, 6)[c] >> np.uint64(32)).astype(np.uint32)
                ids = rows.column(0)
                keys = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64)
                r = t.row[c]
                held.append((h0, h1, ids.fill_null(0).to_numpy()[r], ids.is_null().to_numpy(zero_copy_only=False)[r], keys[r], (c - t.starts[r]).astype(np.int32)))
                count += len(c)
                if count >= 3_000_000:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    def first(t: pa.Table) -> pa.Table:
        h0, h1, doc, null, key, at = (np.concatenate(v) for v in zip(*(unpack(b.as_py()) for b in t["blob"])))
        order = np.lexsort((at, key, doc, 1 - null, h1, h0))
        h0, h1, doc, null, key, at = (v[order] for v in (h0, h1, doc, null, key, at))
        new = np.concatenate([[True], (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])])
        return pa.table({"doc": pa.array(doc[new], mask=null[new] == 1), "key": key[new].view(np.int64), "at": at[new]})

    firsts = base.mapInArrow(send, "bucket long, blob binary").groupBy("bucket").applyInArrow(first, "doc long, key long, at int")
    places = firsts.groupBy("doc", "key").agg(F.collect_list("at").alias("__at"))

    def digest(batches):
        for batch in batches:
            for rows, texts in steps(batch):
                yield rows.append_column("key", pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64)))

    def cut(batches):
        for batch in batches:
            for rows, texts in steps(batch):
                t = _Text(texts, size)
                gone = np.zeros(len(t.flat) + 1, np.int32)
                c = t.candidates(sent.value, width)
                repeat = np.zeros(len(t.valid), bool)
                repeat[c] = True
                copy = rows.column(3).to_pylist()
                for k, at in enumerate(rows.column(2).to_pylist()):
                    s = int(t.starts[k])
                    if copy[k]:
                        if t.lens[k] >= size:
                            repeat[s : s + int(t.lens[k]) - size + 1] = True
                    elif at:
                        repeat[s + np.array(at)] = False
                where = np.flatnonzero(repeat & t.valid)
                np.add.at(gone, where, 1)
                np.add.at(gone, where + size, -1)
                gone = np.cumsum(gone[:-1]) > 0
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), t.starts) * (t.lens > 0) if len(texts) else np.empty(0, np.int64)
                kept = []
                for k, w in enumerate(t.words):
                    if removed[k]:
                        g = gone[t.starts[k] : t.starts[k] + t.lens[k]].tolist()
                        w = [x for x, y in zip(w, g) if not y]
                    kept.append(b" ".join(w))
                yield pa.record_batch([rows.column(0), pa.array(t.lens), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    # rows that are the same in doc_id and text: the first is itself, the others are copies
    with_key = base.mapInArrow(digest, "doc_id long, text string, key long")
    repeated = with_key.select("doc_id", "key").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    joined = with_key.join(places, (with_key["key"] == places["key"]) & with_key["doc_id"].eqNullSafe(places["doc"]), "left").select("doc_id", "text", F.col("__at").alias("places"), with_key["key"].alias("key"))
    repeated = materialize(repeated, "repeated")
    if repeated.isEmpty():
        ready = joined.select("doc_id", "text", "places", F.lit(False).alias("copy"))
    else:
        r = repeated.select(F.col("doc_id").alias("rd"), F.col("key").alias("rk"))
        joined = joined.join(r, (F.col("key") == F.col("rk")) & F.col("doc_id").eqNullSafe(F.col("rd")), "left")
        once = joined.where("rk IS NULL").select("doc_id", "text", "places", F.lit(False).alias("copy"))
        many = joined.where("rk IS NOT NULL").groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.first("places").alias("places"), F.count("*").cast("int").alias("n"))
        ready = once.unionByName(many.select("doc_id", "text", "places", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: k > 1)).alias("copy")))
    return ready.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
