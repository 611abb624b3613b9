"""Near-duplicate documents by b-bit MinHash.

Each document's word shingles give 128 minima. Groups of four minima are 32 band keys, which find
candidates (a pair at similarity 0.8 shares none with a chance of 5e-8); two bits of each minimum,
packed into four longs, estimate a candidate's similarity by counting bits, corrected for the chance
of equal bits. Estimates far under the threshold (five standard deviations and more) go, and so do pairs
whose sizes or whose 1024-bit parities of the sets rule the threshold out (bits that differ are never more
than shingles that differ, so this loses nothing); the rest is confirmed on the full shingle sets.

Documents with one set form a class, whose smallest doc_id stands for it. No group is expanded to
all pairs: first each member of a bucket is held against the bucket's first member; after the
confirmed links have been joined to components, only members of different components are compared,
in blocks, the best estimates of each pair of components first and then all that are left.

Rows with one doc_id are one node. A null doc_id takes no part: component null, kept. Null or empty
text: no shingles, linked with nothing. Empty table: empty result. Other columns stay where rows do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import Members, gram_hashes, hash_words, materialize, mix, release, settled, slim, steps
from vecloom.llm.components import components

ROWS, BANDS, BITS = 4, 32, 2
HASHES = ROWS * BANDS
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
SIGNATURE = "doc_id long, n_shingles long, k0 long, k1 long, s0 long, s1 long, s2 long, s3 long, bands array<long>, parity binary"
#: Members of a bucket that are compared with each other at once.
BLOCK = 2048
#: Estimated pairs that a block gives for each pair of components before the full comparison.
BEST = 4
#: Bits of a set's parity.
PARITY = 1024


def shingle_sets(texts, size: int):
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    words = [t.lower().split() for t in texts]
    flat, lens = hash_words(words)
    grams = gram_hashes(flat, size, 1)
    at = 0
    for n in lens.tolist():
        if n >= size:
            yield np.unique(grams[at : at + n - size + 1])
        elif n:
            yield gram_hashes(flat[at : at + n], n, 100 + n)
        else:
            yield flat[:0]
        at += n


def set_key(s: np.ndarray):
    with np.errstate(over="ignore"):
        return int(np.add.reduce(mix(s)).view(np.int64)), int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64))


def minima(s: np.ndarray) -> np.ndarray:
    """128 minima of a set of hashes."""
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(low, (x[k : k + 512, None] * _A + _B).min(axis=0), out=low)
    return low


def parity(s: np.ndarray) -> bytes:
    """For each of PARITY cells whether an odd number of the hashes falls into it."""
    return np.packbits((np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).tobytes()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    def scan(batches):
        for batch in batches:
            for rows, texts in steps(batch):
                keys, mins, counts, odd = [], [], [], []
                for s in shingle_sets(texts, size):
                    counts.append(len(s))
                    keys.append(set_key(s) if len(s) else (0, 0))
                    mins.append(minima(s))
                    odd.append(parity(s))
                m = np.array(mins, np.uint32).reshape(-1, HASHES)
                with np.errstate(over="ignore"):
                    bands = np.zeros((len(m), BANDS), np.uint64) + _BAND
                    for r in range(ROWS):
                        bands = mix(bands ^ m[:, r::ROWS])
                    bits = (m * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
                lanes = np.zeros((len(m), 4), np.uint64)
                for k in range(HASHES):
                    lanes[:, k // 32] |= bits[:, k].astype(np.uint64) << np.uint64(2 * (k % 32))
                k = np.array(keys, np.int64).reshape(-1, 2)
                yield pa.record_batch(
                    [rows.column(0), pa.array(counts, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), *(pa.array(lanes[:, j].view(np.int64)) for j in range(4)), pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * BANDS, bands.view(np.int64).ravel()), pa.array(odd, pa.binary())],
                    ["doc_id", "n_shingles", "k0", "k1", "s0", "s1", "s2", "s3", "bands", "parity"],
                )

    return slim(docs).mapInArrow(scan, SIGNATURE)


def _same_lanes(n: int = 4):
    """Equal two-bit lanes of two signatures, by bit counts (SQL)."""
    parts = [f"bit_count(((x.s{k} ^ y.s{k}) | shiftrightunsigned(x.s{k} ^ y.s{k}, 1)) & 6148914691236517205L)" for k in range(n)]
    return f"({HASHES} - ({' + '.join(parts)}))"


def least_lanes(threshold: float) -> int:
    """Lanes that agree, at five standard deviations under what a pair at the threshold has."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return max(0, int(HASHES * p - 5 * (HASHES * p * (1 - p)) ** 0.5))


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The shingle sets of the documents in ids. A bitmap tells which texts to read; sets that it lets
    through by chance are joined to nothing."""
    wanted = Members(ids)

    def scan(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            for rows, texts in steps(batch.filter(pa.array(wanted.test(ids))) if len(ids) else batch):
                sets = list(shingle_sets(texts, size))
                yield pa.record_batch([rows.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])

    return slim(docs).mapInArrow(scan, "doc_id long, shingles binary")


def confirm(docs: DataFrame, pairs: DataFrame, size: int, percent: int, repeats: bool) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. repeats: rows may share a doc_id."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    found = _sets(docs, ids, size)
    sets = materialize(found.distinct() if repeats else found, "sets")

    def test(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    out = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long").distinct(), "links")
    release(ids, sets)
    return out


def _apart(members: DataFrame, reps: DataFrame, labels: DataFrame, least: int, percent: int, best: int | None) -> DataFrame:
    """Pairs of different components in one bucket whose estimates, sizes and parities pass. A bucket's largest component
    is held against the others only; both sides come in blocks."""
    named = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = named.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")).where("parts > 1").select("band", F.col("top.component").alias("main"), F.col("all").alias("n_all"), (F.col("all") - F.col("top.n")).alias("n_minor"))
    rows = named.join(main, "band").join(reps.select("doc_id", "n_shingles", "s0", "s1", "s2", "s3", "parity"), "doc_id")
    kj, ki = F.ceil(F.col("n_all") / BLOCK).cast("int"), F.ceil(F.col("n_minor") / BLOCK).cast("int")
    cell = lambda k, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), k).cast("int")
    cols = ["band", "doc_id", "component", "n_shingles", "s0", "s1", "s2", "s3", "parity"]
    minor = rows.where("component <> main").select(*cols, cell(ki, 1).alias("i"), F.explode(F.sequence(F.lit(0), kj - 1)).alias("j"), F.lit(True).alias("minor"))
    every = rows.select(*cols, F.explode(F.sequence(F.lit(0), ki - 1)).alias("i"), cell(kj, 2).alias("j"), F.lit(False).alias("minor"))

    def compare(t: pa.Table) -> pa.Table:
        left, doc, comp, n = (t[c].to_numpy() for c in ("minor", "doc_id", "component", "n_shingles"))
        sig = np.stack([t[f"s{k}"].to_numpy() for k in range(4)], 1).view(np.uint64)
        odd = np.frombuffer(b"".join(t["parity"].to_pylist()), np.uint64).reshape(len(doc), -1)
        x, y, a, b, score = np.flatnonzero(left), np.flatnonzero(~left), [], [], []
        for k in x:
            z = y[(comp[y] != comp[k]) & (100 * np.minimum(n[y], n[k]) >= percent * np.maximum(n[y], n[k]))]
            d = sig[z] ^ sig[k]
            same = HASHES - np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1).astype(np.int64)
            z, same = z[same >= least], same[same >= least]
            apart = np.bitwise_count(odd[z] ^ odd[k]).sum(axis=1, dtype=np.int64)
            ok = apart * (100 + percent) <= (100 - percent) * (n[z] + n[k])
            a.append(np.full(int(ok.sum()), k))
            b.append(z[ok])
            score.append(same[ok])
        a, b, score = (np.concatenate([*v, np.empty(0, np.int64)]).astype(np.int64) for v in (a, b, score))
        if best is not None and len(a):
            order = np.lexsort((-score, np.maximum(comp[a], comp[b]), np.minimum(comp[a], comp[b])))
            lo, hi = np.minimum(comp[a], comp[b])[order], np.maximum(comp[a], comp[b])[order]
            new = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            a, b = a[order[place < best]], b[order[place < best]]
        return pa.table({"a": np.maximum(doc[a], doc[b]), "b": np.minimum(doc[a], doc[b])})

    return minor.unionByName(every).groupBy("band", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def links(docs: DataFrame, sig: DataFrame, size: int, percent: int):
    """(labels of linked class representatives: node, component; classes: k0, k1, doc_id)."""
    least = least_lanes(percent / 100)
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("k0", "k1").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n_shingles", "s0", "s1", "s2", "s3", "bands", "parity"))), "classes")
    banded = classes.select("doc_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub <> last").select("band", "hub")
    members = materialize(banded.join(shared, "band").select("band", "doc_id", "hub").distinct(), "members")
    x, y = (classes.select("doc_id", "n_shingles", "s0", "s1", "s2", "s3").alias(k) for k in "xy")
    pairs = members.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    near = (F.expr(_same_lanes()) >= least) & F.expr(f"100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles)")
    tried = materialize(pairs.join(x, F.col("a") == F.col("x.doc_id")).join(y, F.col("b") == F.col("y.doc_id")).where(near).select("a", "b"), "pairs")
    repeats = not full.groupBy("doc_id").count().where("count > 1").isEmpty()
    made = [members, tried]
    links_ = confirm(docs, tried, size, percent, repeats)
    made.append(links_)
    if repeats:  # a doc_id with several sets joins their classes
        several = full.select("doc_id", "k0", "k1").distinct().groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id")
        alias = full.select("doc_id", "k0", "k1").join(several, "doc_id").join(classes.select("k0", "k1", F.col("doc_id").alias("rep")), ["k0", "k1"])
        made.append(materialize(alias.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct(), "links"))
        links_ = links_.unionByName(made[-1])
    labels = None
    for best in (BEST, None):
        if labels is None:
            labels = materialize(components(links_), "labels")
        again = materialize(_apart(members.select("band", "doc_id"), classes, labels, least, percent, best).join(tried, ["a", "b"], "left_anti"), "pairs")
        made.append(again)
        if again.isEmpty():  # of the best pairs all may have been tried; the round of all pairs tells
            continue
        tried = tried.unionByName(again)
        made.append(confirm(docs, again, size, percent, repeats))
        if not made[-1].isEmpty():
            links_ = links_.unionByName(made[-1])
            release(labels)
            labels = None
    if labels is None:
        labels = materialize(components(links_), "labels")
    release(*made)
    return labels, classes


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. A written table of these alone is left."""

    def groups():
        sig = materialize(signatures(docs, size), "signatures")
        labels, classes = links(docs, sig, size, percent)
        # a class and a doc_id that stands for several sets are nodes of one graph
        of_class = classes.select("k0", "k1", F.col("doc_id").alias("rep")).join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k0", "k1", F.coalesce("component", "rep").alias("component"))
        out = sig.select("doc_id", "n_shingles", "k0", "k1").join(of_class, ["k0", "k1"], "left")
        out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
        out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

    return settled(groups, "groups")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: the smallest doc_id's. Of repeated rows with text and one doc_id the
    one row stays; documents without text all stay. Only rows that a bitmap takes to be copies move."""
    told = near_duplicates(docs, size, percent)
    by_id = told.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_shingles").alias("__vn_n"), F.bool_or("kept").alias("__vn_kept"), F.count("*").alias("__vn_rows"))
    odd = materialize(by_id.where("__vn_n > 0 AND (NOT __vn_kept OR __vn_rows > 1)").select(F.col("doc_id").alias("__vn_id"), "__vn_kept"), "copies")
    release(told)
    if odd.isEmpty():
        return docs
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn("__vn_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))
    hit = Members(odd.select("__vn_id")).column("__vn_key")
    met = rows.where(hit).join(odd, F.col("doc_id") == F.col("__vn_id"), "left")
    stay = rows.where(~hit).select(*cols).unionByName(met.where("__vn_id IS NULL").select(*cols))
    several = odd.where("__vn_kept")
    if several.isEmpty():
        return stay
    return stay.unionByName(met.where("__vn_kept").dropDuplicates(["__vn_id"]).select(*cols))
