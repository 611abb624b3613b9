"""Benchmark decontamination by latent semantic retrieval.

Document frequencies are counted over all documents (a table of fixed width). Benchmark passages (24
words, every 12) are TF-IDF vectors, weight sqrt(tf) * idf; a distributed randomised SVD (range finder
with a power step, each step one job over the passages) gives their latent space. Every document
passage is a query against it: passages whose words outside the benchmark's vocabulary alone keep
the cosine under the limit are passed over (an exact bound), the others are projected. Benchmark passages
whose energy the latent space doesn't keep whole are met by their exact TF-IDF cosine as well, found
by their heaviest words. Candidates are checked
by the longest common subsequence of words between the item and the passage with its surroundings:
contaminated at `lcs` of the item, or at `lcs_answer` where the answer (the rarer words of the
item's last sentence) is there in full.

The benchmark is taken in blocks of a bounded size, each against all documents. Words are runs of ASCII
letters, digits and non-ASCII characters other than quotation marks and dashes; A-Z and À-Þ are lower-cased. Null or empty texts and items match nothing. Null ids are carried as they are.
Repeated rows match each for itself. Empty tables: empty result. Other columns stay where rows do.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import BLOB, PARTS, Members, _merged, count_table, pack, settled, slim, span_hashes, steps, task_number, unpack

SLOTS = 1 << 20
WIDTH, STRIDE = 24, 12
#: Benchmark text that one block holds.
BLOCK_BYTES = 1 << 20
#: Share of its energy that a passage may lose in the latent space and still be met there alone.
LOST = 1e-4
#: Cosines held at a time.
CELLS = 4 << 20
MATCH = "doc_id long, item_id long, cosine double, lcs double, answer boolean"
_BYTES = np.arange(256)
_IN_CORE = (_BYTES >= 128) | np.isin(_BYTES, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))


def cores(texts):
    """(flat hashes of the words of texts (bytes), numbers of words), vectorised."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n  ", np.uint8)
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = _IN_CORE[buf]
    if (buf >= 0xC2).any():
        buf = buf.copy()
        # U+00AB and U+00BB, and U+2010 to U+203F with the dashes and quotation marks, part words
        quote = np.flatnonzero((buf[:-1] == 0xC2) & ((buf[1:] == 0xAB) | (buf[1:] == 0xBB)))
        mark = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x80) & (buf[2:] >= 0x90))
        inside[np.concatenate([quote, quote + 1, mark, mark + 1, mark + 2]) + 1] = False
        capital = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        buf[capital] += 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    first = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return span_hashes(buf, starts, ends), np.bincount(np.searchsorted(first, starts, side="right"), minlength=len(texts))[: len(texts)]


def windows(lens):
    """(text, start, end) in the flat words of all passages; the last of a text ends where it ends."""
    n = np.where(lens > WIDTH, -(-(lens - WIDTH) // STRIDE) + 1, np.minimum(lens, 1))
    text = np.repeat(np.arange(len(lens)), n)
    first = np.cumsum(lens) - lens
    k = np.arange(len(text)) - (np.cumsum(n) - n)[text]
    end = np.minimum(k * STRIDE + WIDTH, lens[text]) + first[text]
    return text, np.maximum(end - WIDTH, first[text]), end


def idf_table(docs: DataFrame) -> np.ndarray:
    """Idf by hash slot, from all documents."""

    def slots(batch):
        held, size = [], 0
        for _, texts in steps(batch, limit=1 << 18):
            flat, lens = cores(texts)
            met = np.sort(np.repeat(np.arange(len(lens)), lens) << 20 | (flat % np.uint64(SLOTS)).astype(np.int64))
            held.append(met[np.concatenate([[True], met[1:] != met[:-1]])[: len(met)]] & (SLOTS - 1))
            size += len(held[-1])
            if size >= SLOTS:
                yield np.concatenate(held)
                held, size = [], 0
        if held:
            yield np.concatenate(held)

    counts = count_table(slim(docs), slots, SLOTS)
    n = max(1, docs.count())
    return np.log((1 + n) / (1 + np.minimum(counts, n))).astype(np.float32) + np.float32(0.01)


def _vectors(flat, idf_of, vocab, start, end):
    """Sparse rows (row, column, weight) of passages over the sorted vocabulary."""
    n = end - start
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    col = np.searchsorted(vocab, flat[at])
    col[col == len(vocab)] = 0
    inside = vocab[col] == flat[at]
    code, tf = np.unique((np.repeat(np.arange(len(n)), n)[inside]) << 32 | col[inside], return_counts=True)
    row, col = code >> 32, code & 0xFFFFFFFF
    return row, col, np.sqrt(tf) * idf_of(vocab[col])


def _dense(row, col, weight, rows, matrix, block: int = 32):
    """Sparse rows times a matrix; few rows at a time, so that what is gathered stays in the cache."""
    out = np.zeros((rows, matrix.shape[1]), matrix.dtype)
    if len(row):
        n = np.bincount(row, minlength=rows)
        place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        cols, weights = np.zeros((rows, n.max()), np.int64), np.zeros((rows, n.max()), matrix.dtype)
        cols[row, place], weights[row, place] = col, weight
        for k in range(0, rows, block):
            out[k : k + block] = np.matmul(weights[k : k + block, None, :], matrix[cols[k : k + block]])[:, 0]
    return out


def latent_space(items: DataFrame, idf: np.ndarray, rank: int = 256, seed: int = 7):
    """(sorted vocabulary, basis) of the passages of items: randomised SVD, one job for each step."""
    spark = items.sparkSession

    def words(batches):
        for batch in batches:
            for _, texts in steps(batch):
                yield pa.record_batch([pa.array(np.unique(cores(texts)[0]).view(np.int64))], ["w"])

    vocab = np.sort(np.array([r.w for r in items.mapInArrow(words, "w long").distinct().collect()], np.int64).view(np.uint64))
    if not len(vocab):
        return vocab, np.zeros((0, 0), np.float32)
    idf_of = lambda h: idf[(h % np.uint64(SLOTS)).astype(np.int64)]

    def product(left, rows):
        """Sum over all passages of f(A), a float32 matrix with `rows` rows, added up in slices of its rows."""
        cut = -(-rows // PARTS)

        def run(batches):
            total = None
            for batch in batches:
                for _, texts in steps(batch):
                    flat, lens = cores(texts)
                    _, s, e = windows(lens)
                    if len(s):
                        x = left(*_vectors(flat, idf_of, vocab, s, e), len(s))
                        total = x if total is None else total + x
            if total is not None:
                for k in range(PARTS):
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([task_number()], pa.int32()), pa.array([pack(total[k * cut : (k + 1) * cut].reshape(-1).astype(np.float32))], pa.binary())], ["part", "pid", "blob"])

        def add(blobs):
            total = None
            for b in blobs:
                (x,) = unpack(b)
                total = x if total is None else total + x
            return pack(total)

        got = {r.part: unpack(r.blob)[0] for r in _merged(items.coalesce(8).mapInArrow(run, BLOB), add).collect()}
        return np.concatenate([got[k] for k in range(PARTS) if k in got])

    k = min(rank + 16, len(vocab))
    basis = np.random.default_rng(seed).standard_normal((len(vocab), k), np.float32)
    for _ in range(2):
        held = spark.sparkContext.broadcast(basis)

        def gram(row, col, weight, n):
            m = held.value
            y = _dense(row, col, weight, n, m)
            out = np.zeros_like(m)
            np.add.at(out, col, y[row] * weight[:, None])
            return out

        basis, _ = np.linalg.qr(product(gram, len(vocab)).reshape(len(vocab), k))
        held.destroy()
    final = spark.sparkContext.broadcast(basis)

    def inner(row, col, weight, n):
        y = _dense(row, col, weight, n, final.value)
        return y.T @ y

    values, turn = np.linalg.eigh(product(inner, k).reshape(k, k).astype(np.float64))
    final.destroy()
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-7 * values.max()]
    return vocab, (basis @ turn[:, best]).astype(np.float32)


def common_subsequence(x, y) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    masks: dict = {}
    for k, w in enumerate(x):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(x)) - 1
    v = full
    for w in y:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


def answer_words(text: str, idf: np.ndarray):
    """The rarer half of the words of an item's last sentence."""
    parts = [p for p in text.replace("?", ".").replace("\n", " ").split(". ") if cores([p.encode()])[1].sum()]
    flat = np.unique(cores([parts[-1].encode()])[0]) if parts else np.empty(0, np.uint64)
    weight = idf[(flat % np.uint64(SLOTS)).astype(np.int64)]
    return set(flat[np.argsort(-weight, kind="stable")[: -(-len(flat) // 2)]].tolist())


def find(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.45, lcs: float = 0.7, lcs_answer: float = 0.5, rank: int = 256) -> DataFrame:
    """Matches: doc_id, item_id, cosine, lcs (share of the item), answer."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    idf = idf_table(docs)
    idf_sent = spark.sparkContext.broadcast(idf)
    out = None
    for b in range(blocks):
        block = bench.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        vocab, basis = latent_space(block, idf, rank)
        listed = [(r.doc_id, r.text) for r in block.collect()]
        if not len(vocab) or not listed:
            continue
        found = _search(docs, spark.sparkContext.broadcast(_queries(listed, vocab, basis, idf, cosine)), idf_sent, cosine, lcs, lcs_answer)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], MATCH)


def _postings(row, col, weight, width, cosine):
    """Index for exact cosines with unit rows. A row is listed under its heaviest words: the rest's norm is at
    most a third of the limit, so a passage has to have the remaining two thirds from the listed words."""
    order = np.lexsort((col, -weight, row))
    row, col, weight = row[order], col[order], weight[order]
    square = np.cumsum(weight[::-1] ** 2)[::-1]  # of this word and all after it
    ends = np.searchsorted(row, row, side="right")
    after = np.append(square, 0.0)
    rest = np.sqrt(np.maximum(square - after[ends], 0))  # norm of the words from this one on, in its row
    listed = rest > cosine / 3
    slack = np.zeros(int(row.max()) + 1 if len(row) else 0)
    np.maximum.at(slack, row[~listed], rest[~listed])
    by_col = np.lexsort((row[listed], col[listed]))
    start = np.searchsorted(col[listed][by_col], np.arange(width + 1))
    codes = row << 32 | col
    by_code = np.argsort(codes)
    return {"start": start, "row": row[listed][by_col], "weight": weight[listed][by_col], "slack": slack, "codes": codes[by_code], "weights": weight[by_code]}


def _exact(index, row, col, weight, rows, cosine):
    """(row, benchmark passage, cosine) of all pairs at the limit; row, col, weight: rows over their whole norms."""
    n = index["start"][col + 1] - index["start"][col]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index["start"][col], n)
    width = len(index["slack"])
    pair, product = np.repeat(row, n) * width + index["row"][at], np.repeat(weight, n) * index["weight"][at]
    if rows * width > 8 * len(pair):
        met, place = np.unique(pair, return_inverse=True)
        total = np.bincount(place, product, len(met))
    else:
        total = np.bincount(pair, product, rows * width)
        met = np.flatnonzero(total)
        total = total[met]
    met = met[total >= cosine - index["slack"][met % width] - 1e-6]
    i, j = met // width, met % width
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    m = n[i]
    at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[i], m)
    code = np.repeat(j, m) << 32 | col[at]
    place = np.minimum(np.searchsorted(index["codes"], code), len(index["codes"]) - 1)
    c = np.bincount(np.repeat(np.arange(len(i)), m), weight[at] * index["weights"][place] * (index["codes"][place] == code), len(i))
    ok = c >= cosine
    return i[ok], j[ok], c[ok]


def _queries(listed, vocab, basis, idf, cosine):
    texts = [t.encode() for _, t in listed]
    flat, lens = cores(texts)
    item, s, e = windows(lens)
    idf_of = lambda h: idf[(h % np.uint64(SLOTS)).astype(np.int64)]
    norm = np.array([np.sqrt((idf_of(flat[a:b]).astype(np.float64) ** 2).sum()) for a, b in zip(s, e)])
    row, col, weight = _vectors(flat, idf_of, vocab, s, e)
    q = _dense(row, col, weight, len(s), basis) / np.maximum(norm, 1e-9)[:, None].astype(np.float32)
    short = np.flatnonzero((q.astype(np.float64) ** 2).sum(1) < 1 - LOST)
    place = np.full(len(s), -1)
    place[short] = np.arange(len(short))
    held = place[row] >= 0
    index = _postings(place[row[held]], col[held], (weight / np.maximum(norm, 1e-9)[row])[held].astype(np.float64), len(vocab), cosine) if len(short) else None
    ends = np.cumsum(lens)
    words = [flat[b - n : b].tolist() for b, n in zip(ends.tolist(), lens.tolist())]
    return {"ids": [i for i, _ in listed], "item": item, "q": q.T.copy(), "short": item[short], "index": index, "words": words, "answers": [answer_words(t, idf) for _, t in listed], "vocab": vocab, "basis": basis}


def _search(docs, bench_sent, idf_sent, cosine, lcs, lcs_answer):
    def scan(batches):
        bench, idf = bench_sent.value, idf_sent.value
        vocab, basis, q, item = bench["vocab"], bench["basis"], bench["q"], bench["item"]
        idf_of = lambda h: idf[(h % np.uint64(SLOTS)).astype(np.int64)]
        index, short = bench["index"], bench["short"]
        block = max(1, min(4096, CELLS // max(1, q.shape[1])))
        for batch in batches:
            for rows, texts in steps(batch):
                flat, lens = cores(texts)
                text, s, e = windows(lens)
                if not len(s):
                    continue
                square = idf_of(flat).astype(np.float64) ** 2
                col = np.searchsorted(vocab, flat)
                col[col == len(vocab)] = 0
                known = vocab[col] == flat
                total, inside = (np.concatenate([[0.0], np.cumsum(x)]) for x in (square, square * known))
                norm, part = total[e] - total[s], inside[e] - inside[s]
                near = np.flatnonzero((part >= cosine * cosine * norm - 1e-6) & (part > 1e-3))
                hits: dict = {}
                for k in range(0, len(near), block):
                    w = near[k : k + block]
                    row, col, weight = _vectors(flat, idf_of, vocab, s[w], e[w])
                    x = _dense(row, col, weight, len(w), basis)
                    c = (x @ q) / np.sqrt(norm[w])[:, None]
                    for i, j in zip(*(v.tolist() for v in np.nonzero(c >= cosine))):
                        key = (int(text[w[i]]), int(item[j]))
                        hits.setdefault(key, []).append((int(w[i]), float(c[i, j])))
                    if index is not None:
                        for i, j, v in zip(*(v.tolist() for v in _exact(index, row, col, weight / np.sqrt(norm[w])[row], len(w), cosine))):
                            hits.setdefault((int(text[w[i]]), int(short[j])), []).append((int(w[i]), v))
                if not hits:
                    continue
                first = np.cumsum(lens) - lens
                out = []
                for (t, m), at in hits.items():
                    words, best, answered = bench["words"][m], 0.0, False
                    bag = Counter(words)
                    for w in sorted({w for w, _ in at}):
                        lo, hi = max(int(first[t]), int(s[w]) - len(words)), min(int(first[t] + lens[t]), int(e[w]) + len(words))
                        region = flat[lo:hi].tolist()
                        most = sum((bag & Counter(region)).values())  # no common subsequence is longer
                        if most < lcs_answer * len(words) or most <= best * len(words):
                            continue
                        got = common_subsequence(words, region) / len(words)
                        if got > best:
                            best, answered = got, bench["answers"][m] <= set(region)
                    if best >= lcs or (best >= lcs_answer and answered):
                        out.append((t, m, max(c for _, c in at), best, answered))
                if out:
                    t, m, c, best, answered = zip(*out)
                    ids = rows.column(0).take(pa.array(t))
                    yield pa.record_batch([ids, pa.array([bench["ids"][k] for k in m], pa.int64()), pa.array(c, pa.float64()), pa.array(best, pa.float64()), pa.array(answered, pa.bool_())], ["doc_id", "item_id", "cosine", "lcs", "answer"])

    return slim(docs).mapInArrow(scan, MATCH)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows of docs without a match. A row goes with all others of its doc_id and text. Only rows
    that a bitmap takes to match move."""
    named = docs.withColumn("__vd_key", F.xxhash64("doc_id", "text"))
    keyed = named.select(F.col("__vd_key").alias("doc_id"), "text")
    hit = settled(lambda: find(keyed, benchmark, **limits).select(F.col("doc_id").alias("__vd_hit")).distinct(), "contaminated")
    if hit.isEmpty():
        return docs
    cols = [F.col(f"`{c}`") for c in docs.columns]
    near = Members(hit).column("__vd_key")
    met = named.where(near).join(hit, F.col("__vd_key") == F.col("__vd_hit"), "left_anti")
    return named.where(~near).select(*cols).unionByName(met.select(*cols))
