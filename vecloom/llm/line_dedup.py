"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words. Its tokens are ordered by rarity (classes of a count
table of fixed width over all documents, then by hash); lines at the similarity share a token
of their prefixes, which the length and positional filters and 64-bit parities of each set
(bits that differ are never more than tokens that differ) confirm or refuse, for longer lines also
512-bit parities, before the sets themselves are read. A line goes if an earlier line, by (doc_id, line number), is similar to it;
lines are judged on the input, not on what is left. Lines of under `min_words` distinct words stay;
with `min_words` 1, as the query and the pipeline have it, only lines without words.

Lines with one set are a class; sets so small that only equal ones are similar are settled by it.
Each task sends the first it has seen and settles the others itself. A later line takes up to
`PARTNERS` earlier partners from a token; of all these the one whose parity is nearest is verified
first. Lines that it doesn't settle meet the others, and all the rest where a token had more, in a second round.

Null text stays null and has no lines. A null doc_id is before all others. Rows with one doc_id are
ordered by a hash of their text. A text whose lines all go becomes empty; its row stays. Empty table:
empty result. Other columns stay where rows do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.common import BLOCK, Members, buckets_for, by_bucket, count_table, materialize, mix, pack, release, settled, span_hashes, steps, unpack, word_spans

SLOTS = 1 << 22
PARTNERS = 2
#: Distinct tokens from which on a line has a parity of 512 bits too.
WIDE_FROM, WIDE_BITS = 16, 512
#: Lines that one vectorised step handles: their number takes 14 bits beside 50 of a token.
LINES = 1 << 14
RN = "__vl_rn"
FIRST = -(1 << 63)
#: Class of a token that all documents hold once; no line shares it.
ONCE = np.uint64(2)
_TOKEN = np.uint64((1 << 50) - 1)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with the number of the row among those of its doc_id."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("i")).groupBy("i").agg(F.count("*").alias("n")).where("n > 1")
    if ids.isEmpty():
        return docs.withColumn(RN, F.lit(1))
    return docs.withColumn(RN, F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"))))


def _lines(rows, texts, min_words, wanted=None):
    """Lines of a step that take part: (doc, row number << 32 | line number, hashes of all words,
    numbers of words). wanted: (doc, line) -> which of them."""
    ids, rn = rows.column(0).fill_null(FIRST).to_numpy(), rows.column(2).to_numpy().astype(np.int64)
    buf, starts, ends, text, line = word_spans(texts)
    if not len(starts):
        return
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (line[1:] != line[:-1])]))
    n = np.diff(np.append(new, len(starts)))
    doc, row = ids[text[new]], rn[text[new]] << 32 | line[new]
    take = n >= min_words
    if wanted is not None:
        take &= wanted(doc, row)
    words = np.repeat(take, n)
    doc, row, n = doc[take], row[take], n[take]
    if not len(n):
        return
    h = span_hashes(buf, starts[words], ends[words])
    cuts = np.concatenate([[0], np.cumsum(n)])
    for k in range(0, len(n), LINES):
        e = min(k + LINES, len(n))
        yield doc[k:e], row[k:e], h[cuts[k] : cuts[e]], n[k:e]


def ragged(values, starts, lens, order):
    """Values of the runs (starts, lens) in another order of runs."""
    s, n = starts[order], lens[order]
    ends = np.cumsum(n)
    return values[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(s, n)]


def _wide(tok, lid, n):
    """WIDE_BITS parities, as rows of longs, of the lines with over WIDE_FROM tokens."""
    long_ = n > WIDE_FROM
    sel = long_[lid]
    place = np.cumsum(long_) - 1
    cell = np.sort(place[lid[sel]] * WIDE_BITS + (mix(tok[sel] ^ np.uint64(0x1F83D9ABFB41BD6B)) & np.uint64(WIDE_BITS - 1)).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)])
    odd = cell[first[np.diff(np.append(first, len(cell))) & 1 == 1]]
    rows = int(long_.sum())
    return np.bincount(odd >> 3, 1 << (odd & 7), rows * WIDE_BITS // 8).astype(np.uint8).view(np.uint64).reshape(rows, WIDE_BITS // 64)


def required(nx, ny, percent):
    """Least overlap of sets of these sizes at the similarity."""
    return -(-percent * (nx + ny) // (100 + percent))


def candidates(cols, percent, partners, only=None):
    """(later doc, later line, earlier doc, earlier line, bits that differ, whether both have wide parities) of
    postings that pass all filters, and (token, doc, line) of later lines that have more earlier partners than were tried."""
    tok, doc, line, n, pos, bits = cols
    order = np.lexsort((line, doc, tok))
    tok, doc, line, n, pos, bits = (v[order] for v in (tok, doc, line, n.astype(np.int64), pos.astype(np.int64), bits))
    new = np.concatenate([[True], tok[1:] != tok[:-1]])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    place = np.arange(len(tok)) - start
    later = np.flatnonzero(place > 0) if only is None else np.flatnonzero((place > 0) & only(tok, doc, line))
    found, taken, more, k = [], np.zeros(len(tok), np.int32), [], 0
    while len(later):
        x = start[later] + k
        nx, ny = n[x], n[later]
        need = required(nx, ny, percent)
        apart = np.bitwise_count(bits[x] ^ bits[later])
        ok = (apart <= nx + ny - 2 * need) & (np.minimum(nx - pos[x], ny - pos[later]) >= need) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
        y = later[ok]
        apart = apart[ok]
        if partners is not None:
            full = taken[y] >= partners
            more.append(y[full])
            found.append((y[~full], x[ok][~full], apart[~full]))
            taken[y] += 1
        else:
            found.append((y, x[ok], apart))
        k += 1
        later = later[(place[later] > k) & (taken[later] <= (partners or 0))]
    y, x, apart = (np.concatenate([*v, np.empty(0, np.int64)]).astype(np.int64) for v in (zip(*found) if found else ((), (), ())))
    m = np.unique(np.concatenate([*more, np.empty(0, np.int64)]).astype(np.int64))
    return (doc[y], line[y], doc[x], line[x], apart, np.minimum(n[y], n[x]) > WIDE_FROM), (tok[m], doc[m], line[m])


PAIR = "kind int, bucket long, tok long, yd long, yl long, xd long, xl long, apart int, wide boolean"


def _pair_table(kind, bucket, tok, yd, yl, xd, xl, apart, wide):
    return pa.table({"kind": pa.array(np.full(len(yd), kind, np.int32)), "bucket": np.full(len(yd), bucket, np.int64), "tok": tok, "yd": yd, "yl": yl, "xd": xd, "xl": xl, "apart": apart.astype(np.int32), "wide": wide.astype(bool)})


def _none(n):
    return np.zeros(n, np.int64)


def repeated_lines(docs: DataFrame, percent: int = 80, min_words: int = 3) -> DataFrame:
    """docs: numbered(). The lines that go: doc (null: the smallest long), line (row number << 32 | number).
    Not written; the tables that it reads are its caller's to discard."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(RN).cast("int").alias(RN))

    def slots(batch):
        held, size = [], 0
        for _, texts in steps(batch, limit=BLOCK):
            h = span_hashes(*word_spans(texts)[:3])
            held.append((h % np.uint64(SLOTS)).astype(np.int64))
            size += len(h)
            if size >= SLOTS:
                yield np.concatenate(held)
                held, size = [], 0
        if held:
            yield np.concatenate(held)

    counts = count_table(base, slots, SLOTS)
    rarity = spark.sparkContext.broadcast(np.minimum(63, 2 * np.log2(counts + 1)).astype(np.uint8))
    size = int(counts.sum()) // 6
    per = buckets_for(spark, size // 8, 100_000)
    per_token = buckets_for(spark, size, 400_000)

    def tokens(h, lens):
        """Sorted distinct tokens of each line: (token, its place in its line, lines' lengths, their
        starts, token's line)."""
        lid = np.repeat(np.arange(len(lens), dtype=np.uint64), lens)
        u = np.sort(lid << np.uint64(50) | rarity.value[(h % np.uint64(SLOTS)).astype(np.int64)].astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
        u = u[np.concatenate([[True], u[1:] != u[:-1]])]
        lid = (u >> np.uint64(50)).astype(np.int64)
        n = np.bincount(lid, minlength=len(lens))
        start = np.cumsum(n) - n
        return u & _TOKEN, np.arange(len(u)) - start[lid], n, start, lid

    def send(batches):
        held, gone, seen = [], [], 0

        def flush():
            doc, line, k0, k1, n, bits, p = (np.concatenate(v) for v in zip(*(x[0] for x in held)))
            tok, wide = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            order = np.lexsort((line, doc, k1, k0))
            new = np.concatenate([[True], (k0[order][1:] != k0[order][:-1]) | (k1[order][1:] != k1[order][:-1])])
            rest, order = order[~new], order[new]
            start = np.cumsum(p) - p
            has = (n > WIDE_FROM).astype(np.int64)
            bucket = (k0[order] % np.uint64(per)).astype(np.int64)
            for k, (rows,) in by_bucket(bucket, order):
                yield _row(0, k, pack(doc[rows], line[rows], k0[rows], k1[rows], n[rows], bits[rows], p[rows], ragged(tok, start, p.astype(np.int64), rows), ragged(wide, np.cumsum(has) - has, has, rows).reshape(-1)))
            for k, (rows,) in by_bucket((doc[rest] % per).astype(np.int64), rest):
                yield _row(1, k, pack(doc[rows], line[rows]))

        for batch in batches:
            for rows, texts in steps(batch, limit=BLOCK):
                for doc, line, h, words in _lines(rows, texts, min_words):
                    tok, pos, n, start, lid = tokens(h, words)
                    keep = n >= min_words
                    with np.errstate(over="ignore"):
                        k0, k1 = np.add.reduceat(mix(tok), start), np.add.reduceat(mix(tok ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
                        bits = np.bitwise_xor.reduceat(np.uint64(1) << (mix(tok ^ np.uint64(0x3C3C3C3C)) & np.uint64(63)), start)
                    # words whole, not their tokens' bits alone: sets of one or two are equal if these are
                    first = np.cumsum(words) - words
                    k0, k1 = k0 ^ mix(np.minimum.reduceat(h, first)), k1 ^ mix(np.maximum.reduceat(h, first) ^ np.uint64(0x9696969696969696))
                    # sets too small to be similar to any other but an equal one need no tokens
                    p = (n - -(-percent * n // 100) + 1) * (keep & (100 * n >= percent * (n + 1)))
                    held.append(((doc[keep], line[keep], k0[keep], k1[keep], n[keep].astype(np.int32), bits[keep], p[keep].astype(np.int32)), tok[pos < p[lid]], _wide(tok, lid, n)[keep[n > WIDE_FROM]]))
                    seen += len(doc)
                    if seen >= 200_000:
                        yield from flush()
                        held, seen = [], 0
        if held:
            yield from flush()

    def _row(kind, bucket, blob):
        return pa.record_batch([pa.array([kind], pa.int32()), pa.array([bucket], pa.int64()), pa.array([blob], pa.binary())], ["kind", "bucket", "blob"])

    def classes(t: pa.Table) -> pa.Table:
        kinds, out = t["kind"].to_pylist(), []
        blobs = [unpack(b) for b in t["blob"].to_pylist()]
        gone = [b for k, b in zip(kinds, blobs) if k == 1]
        rows = [b for k, b in zip(kinds, blobs) if k == 0]
        if rows:
            doc, line, k0, k1, n, bits, p, tok, wide = (np.concatenate(v) for v in zip(*rows))
            order = np.lexsort((line, doc, k1, k0))
            new = np.concatenate([[True], (k0[order][1:] != k0[order][:-1]) | (k1[order][1:] != k1[order][:-1])])
            rest, order = order[~new], order[new]
            gone.append((doc[rest], line[rest]))
            p = p.astype(np.int64)
            start = np.cumsum(p) - p
            has = (n > WIDE_FROM).astype(np.int64)
            of = order[(has[order] > 0) & (p[order] > 0)]
            out.append((2, 0, pack(doc[of], line[of], n[of], ragged(wide.reshape(-1, WIDE_BITS // 64), np.cumsum(has) - has, has, of).reshape(-1))))
            tok = ragged(tok, start, p, order)
            m = p[order]
            pos = (np.arange(len(tok)) - np.repeat(np.cumsum(m) - m, m)).astype(np.int32)
            of = np.repeat(order, m)
            shared = np.lexsort((line[of], doc[of], tok))
            shared = shared[tok[shared] >> np.uint64(44) > ONCE]
            tok, pos, of = tok[shared], pos[shared], of[shared]
            blocks = (np.exp2((tok >> np.uint64(44)).astype(np.float64) / 2) // HOT_POSTINGS).astype(np.int64) + 1
            hot = np.flatnonzero(blocks > 1)
            if len(hot):  # two lines with the token meet where the pair of their blocks does
                g = blocks[hot]
                other = np.arange(int(g.sum())) - np.repeat(np.cumsum(g) - g, g)
                own = np.repeat((_key(doc[of[hot]], line[of[hot]]).view(np.uint64) % g.astype(np.uint64)).astype(np.int64), g)
                code = np.minimum(own, other) * np.repeat(g, g) + np.maximum(own, other) + 1
                with np.errstate(over="ignore"):
                    met = mix(np.repeat(tok[hot], g) + code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                cool = np.flatnonzero(blocks == 1)
                tok, pos, of = np.concatenate([tok[cool], met]), np.concatenate([pos[cool], np.repeat(pos[hot], g)]), np.concatenate([of[cool], np.repeat(of[hot], g)])
            for k, cols in by_bucket((mix(tok) % np.uint64(per_token)).astype(np.int64), tok, doc[of], line[of], n[of], pos, bits[of]):
                out.append((1, k, pack(*cols)))
        if gone:
            out.append((0, 0, pack(*(np.concatenate(v) for v in zip(*gone)))))
        return pa.table({"kind": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([x[1] for x in out], pa.int64()), "blob": pa.array([x[2] for x in out], pa.binary())})

    sent = base.mapInArrow(send, "kind int, bucket long, blob binary").groupBy("bucket").applyInArrow(classes, "kind int, bucket long, blob binary")
    written = materialize(sent, "lines")
    postings = written.where("kind = 1").select("bucket", "blob")

    def first_round(t: pa.Table) -> pa.Table:
        b = t["bucket"][0].as_py()
        cols = [np.concatenate(v) for v in zip(*(unpack(x) for x in t["blob"].to_pylist()))]
        (yd, yl, xd, xl, apart, wide), (tok, md, ml) = candidates(cols, percent, PARTNERS)
        # of a later line's partners in this bucket each once
        order = np.lexsort((xl, xd, yl, yd))
        yd, yl, xd, xl, apart, wide = (v[order] for v in (yd, yl, xd, xl, apart, wide))
        new = np.concatenate([[True], (yd[1:] != yd[:-1]) | (yl[1:] != yl[:-1]) | (xd[1:] != xd[:-1]) | (xl[1:] != xl[:-1])])[: len(yd)]
        return pa.concat_tables([_pair_table(0, b, _none(new.sum()), yd[new], yl[new], xd[new], xl[new], apart[new], wide[new]), _pair_table(1, b, tok.view(np.int64), md, ml, md, ml, *(_none(len(md)),) * 2)])

    def second_round(t: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(t) or not len(wanted):
            return _pair_table(0, 0, *(_none(0),) * 7)
        cols = [np.concatenate(v) for v in zip(*(unpack(x) for x in t["blob"].to_pylist()))]
        asked = set(zip(wanted["tok"].to_pylist(), wanted["yd"].to_pylist(), wanted["yl"].to_pylist()))
        tokens_ = np.unique(wanted["tok"].to_numpy().view(np.uint64))
        near = np.isin(cols[0], tokens_)
        cols = [c[near] for c in cols]
        (yd, yl, xd, xl, apart, wide), _ = candidates(cols, percent, None, lambda a, d, l: np.fromiter((x in asked for x in zip(a.view(np.int64).tolist(), d.tolist(), l.tolist())), bool, len(a)))
        return _pair_table(0, 0, _none(len(yd)), yd, yl, xd, xl, apart, wide)

    def wanted_only(tokens_):
        def pick(batches):
            for batch in batches:
                for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    cols = unpack(blob)
                    near = tokens_.test(cols[0].view(np.int64))
                    if near.any():
                        yield pa.record_batch([pa.array([b], pa.int64()), pa.array([pack(*(c[near] for c in cols))], pa.binary())], ["bucket", "blob"])

        return pick

    tried = materialize(postings.groupBy("bucket").applyInArrow(first_round, PAIR), "candidates")
    wide = written.where("kind = 2").select("blob")
    distinct = lambda df: df.groupBy("yd", "yl", "xd", "xl").agg(F.first("apart").alias("apart"), F.first("wide").alias("wide"))
    met = _refuted(distinct(tried.where("kind = 0")), wide, percent)
    best = met.groupBy("yd", "yl").agg(F.min(F.struct("apart", "xd", "xl")).alias("x")).select("yd", "yl", "x.xd", "x.xl")
    best = materialize(best, "best")
    similar = _verified(base, best, percent, min_words)
    # lines that aren't settled: their other partners, and tokens with partners that weren't tried
    others = met.select("yd", "yl", "xd", "xl").join(similar, ["yd", "yl"], "left_anti")
    left = materialize(tried.where("kind = 1").select("tok", "bucket", "yd", "yl").join(similar, ["yd", "yl"], "left_anti").select("tok", "bucket", "yd", "yl"), "left")
    release(tried)
    if not left.isEmpty():
        again = postings.mapInArrow(wanted_only(Members(left)), "bucket long, blob binary").groupBy("bucket").cogroup(left.groupBy("bucket")).applyInArrow(second_round, PAIR)
        more = _refuted(distinct(again), wide, percent)
        others = others.unionByName(more.select("yd", "yl", "xd", "xl")).distinct()
    rest = materialize(others.join(best, ["yd", "yl", "xd", "xl"], "left_anti"), "pairs")
    similar = similar.unionByName(_verified(base, rest, percent, min_words)).distinct()

    def spread(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                doc, line = unpack(b)
                yield pa.record_batch([pa.array(doc), pa.array(line)], ["doc", "line"])

    copies = written.where("kind = 0").select("blob").mapInArrow(spread, "doc long, line long")
    return copies.unionByName(similar.select(F.col("yd").alias("doc"), F.col("yl").alias("line")))


def _key(doc, line):
    """One long for a line; for the line -1, its row's document."""
    with np.errstate(over="ignore"):
        return mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.view(np.uint64)).view(np.int64)


#: Bytes of a word's hash that a set is sent with.
WORD_BYTES = 6
#: Pairs of one line that one task takes at most; a line with more is met in several.
HOT_PAIRS = 50_000
#: Postings of one token that one task takes at most; those of a more frequent token are met in blocks.
HOT_POSTINGS = 400_000


class _Salt:
    """Lines that a thousandth of all pairs or more share (a thousand lines at most) are dealt to several buckets."""

    def __init__(self, pairs: DataFrame, doc: str, line: str, n: int, per: int):
        most = max(HOT_PAIRS, n // 1000)
        rows = pairs.groupBy(doc, line).count().where(F.col("count") > most).collect()
        keys = _key(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))
        order = np.argsort(keys)
        self.keys, self.parts, self.per = keys[order], np.array([-(-r[2] // most) for r in rows], np.int64)[order], per

    def of(self, key):
        """Buckets that lines are dealt to."""
        if not len(self.keys):
            return np.ones(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.parts[at], 1)

    def bucket(self, key, part):
        with np.errstate(over="ignore"):
            return (mix(key.view(np.uint64) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.per)).astype(np.int64)

    def dealt(self, key, other):
        """The bucket of a pair, by its other line."""
        return self.bucket(key, (other.view(np.uint64) % self.of(key).astype(np.uint64)).astype(np.int64))

    def everywhere(self, key):
        """(bucket, number of the line) for each bucket of each line."""
        n = self.of(key)
        at = np.repeat(np.arange(len(key)), n)
        return self.bucket(key[at], np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)), at


#: Told apart in one bitmap: keys of earlier lines.
_EARLIER = np.int64(0x2545F4914F6CDD1D)


def _keys_of(batch):
    """The later lines of pairs and their documents as longs, and the earlier ones marked as such."""
    yd, yl, xd, xl = (batch.column(k).to_numpy() for k in range(4))
    none = _none(len(yd)) - 1
    return np.concatenate([_key(yd, yl), _key(yd, none), _key(xd, xl) ^ _EARLIER, _key(xd, none) ^ _EARLIER])


BLOBS = "kind int, bucket long, blob binary"
MET = "yd long, yl long, xd long, xl long, apart int"


def _blob(kind, bucket, *cols):
    return pa.record_batch([pa.array([kind], pa.int32()), pa.array([bucket], pa.int64()), pa.array([pack(*cols)], pa.binary())], ["kind", "bucket", "blob"])


def _columns(blobs):
    return [np.concatenate(v) for v in zip(*map(unpack, blobs))]


def _place(doc, line, d, l):
    """Place of each (d, l) among the sorted (doc, line); -1 where there is none."""
    both = np.lexsort((np.concatenate([_none(len(doc)), _none(len(d)) + 1]), np.concatenate([line, l]), np.concatenate([doc, d])))
    out = np.empty(len(both), np.int64)
    out[both] = np.maximum.accumulate(np.where(both < len(doc), both, -1))
    out = out[len(doc) :]
    return np.where((out >= 0) & (doc[out] == d) & (line[out] == l), out, -1)


def _meet(pairs: DataFrame, source: DataFrame, read, unit: int, decide) -> DataFrame:
    """The pairs (a written table: yd, yl, xd, xl) that decide() keeps by what is known of their lines.

    read(batch, wanted) gives (doc, line, size, units, payload) of the lines of a batch of source that are
    wanted; the payload is `units` rows of `unit` bytes a line. Lines that pairs don't name are let through rarely
    and meet nothing. What is known of earlier lines goes to the pairs, then both to what is known of
    the later ones, in blobs of many rows. decide(later, earlier), each (size, units, payload), gives (kept, apart)."""
    spark = pairs.sparkSession
    n = pairs.count()
    per = buckets_for(spark, n, 50_000)
    on_x, on_y = _Salt(pairs, "xd", "xl", n, per), _Salt(pairs, "yd", "yl", n, per)
    named = Members(pairs.select("yd", "yl", "xd", "xl"), 4 * n, _keys_of)
    later, earlier = named.test, lambda key: named.test(key ^ _EARLIER)
    wanted = lambda doc, line: later(key := _key(doc, line)) | earlier(key)

    def known(batches):
        held, size = [], 0

        def flush():
            doc, line, size, units, payload = (np.concatenate(v) for v in zip(*held))
            key, start = _key(doc, line), np.cumsum(units) - units
            for kind, side, salt in ((1, later, on_y), (2, earlier, on_x)):
                own = np.flatnonzero(side(key))
                to, at = salt.everywhere(key[own])
                for k, (mine,) in by_bucket(to, own[at]):
                    yield _blob(kind, k, doc[mine], line[mine], size[mine], units[mine], ragged(payload, start, units, mine).reshape(-1))

        for batch in batches:
            for x in read(batch, wanted):
                held.append(x)
                size += x[4].size
                if size >= 16 << 20:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def asked(batches):
        for batch in batches:
            yd, yl, xd, xl = (batch.column(k).to_numpy() for k in range(4))
            for k, cols in by_bucket(on_x.dealt(_key(xd, xl), _key(yd, yl)), yd, yl, xd, xl):
                yield _blob(0, k, *cols)

    def parted(t, kind):
        kinds, blobs = t["kind"].to_pylist(), t["blob"].to_pylist()
        ask, have = ([b for k, b in zip(kinds, blobs) if k == wish] for wish in (0, kind))
        return (_columns(ask), _columns(have)) if ask and have else None

    def earlier_met(t: pa.Table) -> pa.Table:
        got, out = parted(t, 2), []
        if got is not None:
            (yd, yl, xd, xl), (doc, line, size, units, payload) = got
            order = np.lexsort((line, doc))
            at = _place(doc[order], line[order], xd, xl)
            yd, yl, xd, xl, at = (v[at >= 0] for v in (yd, yl, xd, xl, order[at]))
            start, payload = np.cumsum(units) - units, payload.reshape(-1, unit)
            for k, (rows,) in by_bucket(on_y.dealt(_key(yd, yl), _key(xd, xl)), np.arange(len(yd))):
                where = at[rows]
                out.append((k, pack(yd[rows], yl[rows], xd[rows], xl[rows], size[where], units[where], ragged(payload, start, units, where).reshape(-1))))
        return pa.table({"kind": pa.array([0] * len(out), pa.int32()), "bucket": pa.array([x[0] for x in out], pa.int64()), "blob": pa.array([x[1] for x in out], pa.binary())})

    def both_met(t: pa.Table) -> pa.Table:
        got = parted(t, 1)
        yd = yl = xd = xl = apart = _none(0)
        if got is not None:
            (yd, yl, xd, xl, size_x, units_x, payload_x), (doc, line, size, units, payload) = got
            order = np.lexsort((line, doc))
            at = _place(doc[order], line[order], yd, yl)
            ok = np.flatnonzero(at >= 0)
            mine = order[at[ok]]
            y = (size[mine], units[mine], ragged(payload.reshape(-1, unit), np.cumsum(units) - units, units, mine))
            x = (size_x[ok], units_x[ok], ragged(payload_x.reshape(-1, unit), np.cumsum(units_x) - units_x, units_x, ok))
            kept, apart = decide(y, x)
            yd, yl, xd, xl = (v[ok][kept] for v in (yd, yl, xd, xl))
            apart = apart[kept]
        return pa.table({"yd": yd, "yl": yl, "xd": xd, "xl": xl, "apart": apart.astype(np.int32)})

    sides = materialize(source.mapInArrow(known, BLOBS), "sides")
    first = pairs.select("yd", "yl", "xd", "xl").mapInArrow(asked, BLOBS).unionByName(sides.where("kind = 2")).groupBy("bucket").applyInArrow(earlier_met, BLOBS)
    out = materialize(first.unionByName(sides.where("kind = 1")).groupBy("bucket").applyInArrow(both_met, MET), "met")
    release(sides)
    return out


def _refuted(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """yd, yl, xd, xl, apart of the pairs that the wide parities of both lines, where both have them, don't rule out."""
    pairs = materialize(pairs, "pairs")
    hard = materialize(pairs.where("wide").select("yd", "yl", "xd", "xl"), "pairs")

    def read(batch, wanted):
        for blob in batch.column(0).to_pylist():
            doc, line, n, bits = unpack(blob)
            ok = wanted(doc, line)
            if ok.any():
                yield doc[ok], line[ok], n[ok].astype(np.int64), np.ones(int(ok.sum()), np.int64), bits.view(np.uint8).reshape(-1, WIDE_BITS // 8)[ok]

    def decide(y, x):
        apart = np.bitwise_count(y[2] ^ x[2]).sum(axis=1, dtype=np.int64)
        return apart <= y[0] + x[0] - 2 * required(y[0], x[0], percent), apart

    met = _meet(hard, wide, read, WIDE_BITS // 8, decide)
    release(hard)
    return pairs.where("NOT wide").select("yd", "yl", "xd", "xl", "apart").unionByName(met)


def _verified(base: DataFrame, pairs: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Later lines (yd, yl) of pairs (a written table) whose whole sets are similar."""

    def read(batch, wanted):
        ids = batch.column(0).fill_null(FIRST).to_numpy()
        if not len(ids):
            return
        near = wanted(ids, _none(len(ids)) - 1)
        for rows, texts in steps(batch.filter(pa.array(near)), limit=BLOCK):
            for doc, line, h, n in _lines(rows, texts, min_words, wanted):
                lid = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, lid))
                h, lid = h[order], lid[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (lid[1:] != lid[:-1])])
                size = np.bincount(lid[new], minlength=len(n))
                yield doc, line, size, size, np.ascontiguousarray(h[new].view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES :])

    def widen(words):
        out = np.zeros((len(words), 8), np.uint8)
        out[:, 8 - WORD_BYTES :] = words
        return out.reshape(-1).view(np.uint64)

    def decide(y, x):
        h = np.concatenate([widen(y[2]), widen(x[2])])
        pair = np.concatenate([np.repeat(np.arange(len(s[1])), s[1]) for s in (y, x)])
        by = np.lexsort((h, pair))
        h, pair = h[by], pair[by]
        same = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])  # a set holds a word once
        both = np.bincount(pair[1:][same], minlength=len(y[0]))
        return 100 * both >= percent * (y[0] + x[0] - both), _none(len(both))

    return materialize(_meet(pairs, base, read, WORD_BYTES, decide).select("yd", "yl").distinct(), "similar")


def _cut(docs: DataFrame, percent: int, min_words: int) -> DataFrame:
    """docs with the prefixed columns gone (numbers of lines that go) and out (the text that is left).
    Only rows that a bitmap takes to lose lines move."""
    rows = numbered(docs)
    gone = settled(lambda: repeated_lines(rows, percent, min_words), "gone")
    by_row = gone.select(F.col("doc").alias("__vl_doc"), F.shiftright("line", 32).cast("int").alias("__vl_row"), F.col("line").bitwiseAND(0x7FFFFFFF).cast("int").alias("__vl_line"))
    by_row = by_row.groupBy("__vl_doc", "__vl_row").agg(F.collect_set("__vl_line").alias("__vl_gone"))
    rows = rows.withColumn("__vl_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)))
    touched = Members(gone.select("doc")).column("__vl_id")
    moved = rows.where(touched).join(by_row, (F.col("__vl_id") == F.col("__vl_doc")) & (F.col(RN) == F.col("__vl_row")), "left")
    out = moved.unionByName(rows.where(~touched), allowMissingColumns=True)
    kept = "get(transform(array(split(text, '\\n')), l -> transform(array_except(sequence(0, size(l) - 1), __vl_gone), k -> get(l, k))), 0)"
    return out.withColumn("__vl_out", F.when(F.col("__vl_gone").isNull(), F.col("text")).otherwise(F.expr(f"array_join({kept}, '\\n')")))


def deduplicate_lines(docs: DataFrame, percent: int = 80, min_words: int = 3, drop_emptied: bool = False) -> DataFrame:
    """docs with the lines that go taken out of text, and n_chars, where there is one, counted anew.
    drop_emptied: rows that lose lines and are left without a word go."""
    df = _cut(docs, percent, min_words)
    if drop_emptied:
        df = df.where(F.col("__vl_gone").isNull() | F.col("__vl_out").rlike(r"[^\x20\x09-\x0D]"))
    cols = [F.col("__vl_out").alias("text") if c == "text" else F.length("__vl_out").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return df.select(*cols)


def report(docs: DataFrame, percent: int = 80, min_words: int = 3) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_chars, kept_sha256."""
    df = _cut(docs.select("doc_id", "text"), percent, min_words)
    left = F.coalesce("__vl_out", F.lit(""))
    return df.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"), F.when(F.col("__vl_gone").isNull(), 0).otherwise(F.size("__vl_gone")).cast("long").alias("n_removed"), F.length(left).cast("long").alias("kept_chars"), F.sha2(left, 256).alias("kept_sha256"))
