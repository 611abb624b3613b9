"""Quality scores from random-indexing word vectors and a two-layer network.

Words give up to three tokens: the core, the marks after it, its letter case; tokens are hashed to
65,536 slots. A slot's context vector is the sum, over all documents, of fixed sparse random vectors
of its neighbours within two places. Document features are means and deviations of these and of
the tokens' own random vectors, the length and the share of distinct tokens. The network is trained with
numpy on at most `sample` labelled rows, taken by a hash of doc_id; a fifth of them sets the
temperature. Labels, lang, source and doc_id are no inputs.

A null doc_id counts as the empty string for the fold. Null and empty texts have the features of no
tokens and a score like any other. A doc_id with several labels has the lowest. No labelled rows of
both kinds: all scores are 0.5. Repeated rows are scored alike. Empty table: empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import BLOB, CACHE_WORDS, PARTS, _merged, pack, slim, steps, task_number, unpack

SLOTS, DIM = 1 << 16, 32
FEATURES = 3 * DIM + 2
#: Bytes of text, and places of tokens, of one vectorised step: its columns stay in the cache.
STEP, WINDOW = 1 << 18, 1 << 15


def _index_vectors() -> np.ndarray:
    """Sparse ternary vectors: eight places of DIM are 1 or -1."""
    rng = np.random.default_rng(11)
    out = np.zeros((SLOTS, DIM), np.int8)
    places = np.argsort(rng.random((SLOTS, DIM)), axis=1)[:, :8]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.int8), (SLOTS, 8)), axis=1)
    return out


INDEX = _index_vectors()


class _Tokens(dict):
    """Raw word -> its slots as little-endian 32-bit integers."""

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        core, marks = text, ""
        if not text.isalnum():
            core = "".join([c for c in text if c.isalnum()])
            marks = "".join([c for c in text if not c.isalnum()])
        names = ["w" + core.lower()] if core else []
        if marks:
            names.append("m" + marks[:4])
        if len(core) > 1 and core.isupper():
            names.append("UPPER")
        elif not core.isalpha() and any(c.isdigit() for c in core):
            names.append("DIGIT")
        ids = self[word] = b"".join([(xxhash.xxh3_64_intdigest(x) % SLOTS).to_bytes(4, "little") for x in names])
        return ids


_tokens = _Tokens()


def slots(texts):
    """(flat slots, lengths)."""
    blobs = [b"".join(map(_tokens.__getitem__, t.split())) for t in texts]
    return np.frombuffer(b"".join(blobs), "<i4"), np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs))


def context_vectors(docs: DataFrame, reach: int = 2) -> np.ndarray:
    """Unit context vectors of all slots, summed over all documents; a table of fixed size."""
    step = SLOTS // PARTS
    # a last row of zeros for places between documents
    vectors = np.concatenate([INDEX, np.zeros((1, DIM), np.int8)]).astype(np.int8 if reach < 64 else np.int32)

    def scan(batches):
        total = np.zeros((SLOTS, DIM), np.int64)
        for batch in batches:
            for _, texts in steps(batch, limit=STEP):
                flat, lens = slots(texts)
                # documents are parted by `reach` empty places, so that no window spans two
                padded = np.full(len(flat) + reach * (len(lens) + 1), SLOTS, np.int64)
                padded[np.arange(len(flat)) + reach * (1 + np.repeat(np.arange(len(lens)), lens))] = flat
                for at in range(0, len(padded) - 2 * reach, WINDOW):
                    part = padded[at : at + WINDOW + 2 * reach]
                    near, n = vectors[part], len(part) - 2 * reach
                    around = np.zeros((n, DIM), near.dtype)
                    for gap in range(1, reach + 1):
                        around += near[reach - gap : reach - gap + n]
                        around += near[reach + gap : reach + gap + n]
                    words = np.flatnonzero(part[reach : reach + n] < SLOTS)
                    if not len(words):
                        continue
                    x = part[reach : reach + n][words].astype(np.uint16)
                    order = np.argsort(x, kind="stable")
                    x = x[order]
                    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                    total[x[cut]] += np.add.reduceat(around[words[order]].astype(np.int32), cut, axis=0)
        pid = task_number()
        for k in range(PARTS):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pid], pa.int32()), pa.array([pack(total[k * step : (k + 1) * step].astype(np.int32 if np.abs(total).max(initial=0) < 2**31 else np.int64).ravel())], pa.binary())], ["part", "pid", "blob"])

    def add(blobs):
        total = None
        for b in blobs:
            (x,) = unpack(b)
            total = x.astype(np.int64) if total is None else total + x
        return pack(total)

    out = np.zeros((SLOTS, DIM))
    for r in _merged(slim(docs).mapInArrow(scan, BLOB), add).collect():
        out[r.part * step : (r.part + 1) * step] = unpack(r.blob)[0].reshape(step, DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]).astype(np.float32)


def features(texts, context: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), FEATURES), np.float32)
    flat, lens = slots(texts)
    full = np.flatnonzero(lens > 0)
    if len(full):
        start = (np.cumsum(lens) - lens)[full]
        n = lens[full][:, None].astype(np.float32)
        c = context[flat]
        mean = np.add.reduceat(c, start, axis=0) / n
        own = np.add.reduceat(INDEX[flat].astype(np.float32), start, axis=0) / n
        spread = np.sqrt(np.maximum(np.add.reduceat(c * c, start, axis=0) / n - mean * mean, 0))
        pair = np.sort(np.repeat(np.arange(len(full)), lens[full]) << 16 | flat)
        distinct = np.bincount(pair[np.concatenate([[True], pair[1:] != pair[:-1]])] >> 16, minlength=len(full))
        out[full] = np.concatenate([mean, own, spread, np.log1p(n) / 10, (distinct[:, None] / n)], axis=1)
    return out


class Network:
    """Standardised features -> hidden tanh units -> one logit over a temperature."""

    def __init__(self, shift, scale, w1, b1, w2, b2, temperature=1.0):
        self.shift, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = shift, scale, w1, b1, w2, b2, temperature

    def logits(self, x):
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, passes: int = 30, seed: int = 5) -> Network:
    """Adam on cross-entropy; the last fifth of the rows sets the temperature."""
    rng = np.random.default_rng(seed)
    cut = max(1, len(x) * 4 // 5)
    shift, scale = x[:cut].mean(0), x[:cut].std(0) + 1e-3
    net = Network(shift, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    parts = [net.w1, net.b1, net.w2, np.array([0.0])]
    first, second, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    z = (x[:cut] - shift) / scale
    for _ in range(passes):
        order = rng.permutation(cut)
        for k in range(0, cut, 256):
            i = order[k : k + 256]
            h = np.tanh(z[i] @ parts[0] + parts[1])
            d = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3][0], -30, 30))) - y[i]) / len(i)
            back = np.outer(d, parts[2]) * (1 - h * h)
            grads = [z[i].T @ back + 1e-4 * parts[0], back.sum(0), h.T @ d + 1e-4 * parts[2], np.array([d.sum()])]
            t += 1
            for p, g, m, v in zip(parts, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(parts[3][0])
    if cut < len(x):
        logit, target = net.logits(x[cut:]), y[cut:]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        net.temperature = float(grid[np.argmin([np.mean(np.logaddexp(0, logit / g) - target * logit / g) for g in grid])])
    return net


def fold(doc_id):
    """The remainder that says where a row belongs: 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4))


def score(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    base = slim(docs)
    sent = spark.sparkContext.broadcast(context_vectors(docs))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")).where(fold("doc_id") != 2)
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def measure(batches):
        for batch in batches:
            for rows, texts in steps(batch, limit=STEP):
                x = features(texts, sent.value)
                yield pa.record_batch([rows.column(0), rows.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    # at most `sample` ids of eight bytes and a label
    rows = base.join(F.broadcast(taken), "doc_id").select("doc_id", "text", "quality").mapInArrow(measure, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.first("x").alias("x")).collect()
    rows.sort(key=lambda r: xxhash.xxh3_64_intdigest(str(r.doc_id)))
    y = np.array([r.quality for r in rows], np.float64)
    net = None
    if len(set(y.tolist())) > 1:
        net = spark.sparkContext.broadcast(train(np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64), (y > 0).astype(np.float64)))

    def run(batches):
        for batch in batches:
            for rows, texts in steps(batch, limit=STEP):
                s = net.value.scores(features(texts, sent.value).astype(np.float64)) if net else np.full(len(texts), 0.5)
                yield pa.record_batch([rows.column(0), rows.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return base.withColumn("held_out", fold("doc_id") == 2).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
