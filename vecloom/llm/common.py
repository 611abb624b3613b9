"""Helpers shared by the training-data operators.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``; on UTF-8 bytes that is exactly
``bytes.split()``, and ``bytes.lower()`` lower-cases A-Z alone, so texts are handled as bytes.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a Python worker keeps in a per-word cache; a full cache is emptied.
CACHE_WORDS = 150_000
#: Bytes of text that one vectorised step of a Python worker handles.
STEP_BYTES = 2 << 20

M1 = np.uint64(0xFF51AFD7ED558CCD)
M2 = np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


# ---------------------------------------------------------------- storage


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where none is set and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(scratch_root, "own", None)
    if own is None:
        own = scratch_root.own = tempfile.mkdtemp(prefix="vecloom-")
    return f"file://{own}"


#: Lists that get the paths of the tables made while they are open.
_collectors: list[list[str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/vecloom-{label}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    for made in _collectors:
        made.append(path)
    return path


@contextlib.contextmanager
def collecting():
    """The paths of the tables that are made meanwhile, for discard()."""
    made: list[str] = []
    _collectors.append(made)
    try:
        yield made
    finally:
        _collectors[:] = [x for x in _collectors if x is not made]


def _fs(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


#: A batch of this many rows at most goes to a Python worker at a time, where the session has no limit of its own.
BATCH_ROWS = 2000
#: What Python workers' allocators are told, so that large columns go back to the system once they are freed.
ALLOCATORS = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers that see this folder import the package; elsewhere submit it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    for k, v in ALLOCATORS.items():
        env.setdefault(k, v)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there,
    and a lost executor costs nothing that was written."""
    spark = ship(df.sparkSession)
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vecloom_path = path
    return out


def release(*frames: DataFrame) -> None:
    for df in frames:
        discard(df.sparkSession, df._vecloom_path)


def settled(make, label: str) -> DataFrame:
    """make() as a written table; all other tables that it made go."""
    with collecting() as made:
        out = materialize(make(), label)
    discard(out.sparkSession, *(p for p in made if p != out._vecloom_path))
    return out


# ---------------------------------------------------------------- words


class WordHashes(dict):
    """word -> 64-bit hash, the same on every worker."""

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def hash_words(word_lists):
    """(flat uint64 hashes, lengths) of lists of words."""
    lens = np.fromiter(map(len, word_lists), np.int64, len(word_lists))
    flat = np.fromiter(map(_hashes.__getitem__, itertools.chain.from_iterable(word_lists)), np.uint64, int(lens.sum()))
    return flat, lens


#: Bytes of text that one vectorised hashing step takes, so that its columns stay in the cache.
BLOCK = 1 << 18
_PRIME = 0x9E3779B97F4A7C15
_BYTES = np.arange(256, dtype=np.uint8)
_IN_WORD = ~np.isin(_BYTES, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)


def _powers(n, base):
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


_TIMES, _OVER = _powers(BLOCK, _PRIME), _powers(BLOCK, pow(_PRIME, -1, 1 << 64))


def word_spans(texts):
    """Words of texts (bytes): (all bytes, starts, ends, number of the text, number of the line
    within the text) of each word, as numpy columns."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = _IN_WORD[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(sizes) - sizes
    text = np.searchsorted(first, starts, side="right") - 1
    breaks = np.flatnonzero(buf == 10)
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, first)[text]
    return buf, starts, ends, text, line


def span_hashes(buf, starts, ends):
    """64-bit hashes of words with A-Z lower-cased, by differences of one running polynomial sum."""
    letters = mix((_BYTES + 32 * _UPPER).astype(np.uint64) + np.uint64(0xD1B54A32D192ED03))
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
            a, b = int(starts[i]), int(ends[j - 1])
            times = _TIMES if b - a <= BLOCK else _powers(b - a, _PRIME)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(letters[buf[a:b]] * times[: b - a], out=total[1:])
            s = starts[i:j] - a
            out[i:j] = (total[ends[i:j] - a] - total[s]) * _OVER[np.minimum(s, BLOCK)]
            i = j
    return mix(out)


def mix(x):
    """Finaliser of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> S33)
        x = x * M1
        x = x ^ (x >> S33)
        x = x * M2
        return x ^ (x >> S33)


def gram_hashes(flat, width, seed):
    """Polynomial hash of every run of `width` hashes, by doubling."""
    mul = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1) | 1) & 0xFFFFFFFFFFFFFFFF)
    n = len(flat) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, part, have, power = None, 0, flat, 1, mul
        bits = width
        while bits:
            if bits & 1:
                shifted = part[done:]
                if out is None:
                    out = shifted
                else:
                    out = out[: len(shifted)] * power + shifted[: len(out)]
                done += have
            bits >>= 1
            if bits:
                part = part[: len(part) - have] * power + part[have:]
                have *= 2
                power = power * power
        return mix(out[:n])


# ---------------------------------------------------------------- Arrow batches


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES):
    """Slices of a batch with about `limit` bytes of text each: (slice, texts as bytes; null: empty).
    Only one slice's texts are Python objects at a time."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        end = min(end, n)
        yield batch.slice(start, end - start), [x or b"" for x in texts.slice(start, end - start).to_pylist()]
        start = end


def slim(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone, whatever else the table holds."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


# ---------------------------------------------------------------- packed columns


def _planes(a) -> bytes:
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def pack(*arrays) -> bytes:
    """Little-endian numpy columns as one zstd blob, each column by byte planes."""
    head = np.array([len(arrays), *itertools.chain.from_iterable((len(a), np.dtype(a.dtype).num) for a in arrays)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(_planes(a) for a in arrays)]))


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.int16, np.int32, np.uint32, np.int64, np.uint64, np.float32, np.float64)}


def unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for k in range(n):
        kind = _KINDS[int(head[2 * k + 1])]
        planes = np.frombuffer(raw, np.uint8, kind.itemsize * int(head[2 * k]), at).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += kind.itemsize * int(head[2 * k])
    return out


def by_bucket(bucket, *arrays):
    """(bucket number, columns of its rows) for each bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(bucket[rows[0]]), [a[rows] for a in arrays]


# ---------------------------------------------------------------- bounded sketches

#: A sketch is cut into this many parts, which are merged apart.
PARTS = 16
BLOB = "part int, pid int, blob binary"


def _merged(df: DataFrame, combine, finish=lambda blob: blob) -> DataFrame:
    """Merge the blobs of each part in a tree whose tasks take about 32 blobs each; finish() is applied to what is left."""
    fan = 32
    n = max(1, df.rdd.getNumPartitions()) if not hasattr(df, "_vecloom_parts") else df._vecloom_parts

    def fold(last):
        def run(table: pa.Table) -> pa.Table:
            part, pid = table["part"][0].as_py(), table["pid"][0].as_py()
            blob = combine(b.as_py() for b in table["blob"])
            return pa.table({"part": pa.array([part], pa.int32()), "pid": pa.array([pid], pa.int32()), "blob": pa.array([finish(blob) if last else blob], pa.binary())})

        return run

    while True:
        n = -(-n // fan)
        df = df.withColumn("pid", F.pmod("pid", F.lit(n)).cast("int")).groupBy("part", "pid").applyInArrow(fold(n == 1), BLOB)
        if n == 1:
            return df


def task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def count_table(df: DataFrame, slots_of, width: int) -> np.ndarray:
    """int64 counts of hash slots over all rows of df. slots_of: batch -> slot numbers (with
    repeats). The table has `width` entries however much is counted."""
    ship(df.sparkSession)
    step = width // PARTS

    def scan(batches):
        total, held, size = np.zeros(width, np.int64), [], 0
        for batch in batches:
            for slots in slots_of(batch):
                held.append(slots.astype(np.int32))
                size += len(slots)
                if size >= width // 2:
                    total += np.bincount(np.concatenate(held), minlength=width)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=width)
        pid = task_number()
        for k in range(PARTS):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pid], pa.int32()), pa.array([pack(total[k * step : (k + 1) * step])], pa.binary())], ["part", "pid", "blob"])

    def add(blobs):
        total = None
        for b in blobs:
            (x,) = unpack(b)
            total = x.copy() if total is None else total + x
        return pack(total)

    out = np.zeros(width, np.int64)
    for row in _merged(df.mapInArrow(scan, BLOB), add).collect():
        out[row.part * step : (row.part + 1) * step] = unpack(row.blob)[0]
    return out


def bitmap(df: DataFrame, cells_of, width: int, least: int) -> np.ndarray:
    """Packed bits over `width` cells: set where the cell was met at least `least` (1 or 2) times
    among all rows of df. cells_of: batch -> cell numbers. A saturating count-min row: a cell's
    count is never under that of any key which falls into it. The driver gets bits, never cell numbers."""
    step = width // PARTS

    def split(once, twice):
        return pack(*(np.diff(x, prepend=x.dtype.type(0)) if len(x) else x for x in (once, twice)))

    def scan(batches):
        held, size, once, twice = [], 0, np.empty(0, np.uint32), np.empty(0, np.uint32)

        def take():
            nonlocal once, twice, held, size
            if least == 1:
                twice, held, size = np.unique(np.concatenate([*held, twice])), [], 0
                return
            x, n = np.unique(np.concatenate([*held, once, twice, twice]), return_counts=True)
            once, twice, held, size = x[n == 1], x[n > 1], [], 0

        for batch in batches:
            for cells in cells_of(batch):
                held.append(cells.astype(np.uint32))
                size += len(cells)
                if size >= 4_000_000:
                    take()
        take()
        pid = task_number()
        for k in range(PARTS):
            a, b = ((x[np.searchsorted(x, np.uint32(k * step)) : (np.searchsorted(x, np.uint32((k + 1) * step - 1), side="right"))] - np.uint32(k * step)) for x in (once, twice))
            if len(a) or len(b):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pid], pa.int32()), pa.array([split(a, b)], pa.binary())], ["part", "pid", "blob"])

    def join(blobs):
        seen, more = np.zeros(step, bool), np.zeros(step, bool)
        for b in blobs:
            once, twice = (np.cumsum(x, dtype=np.uint32) for x in unpack(b))
            more[once[seen[once]]] = True
            more[twice] = True
            seen[once] = True
            seen[twice] = True
        return split(np.flatnonzero(seen & ~more).astype(np.uint32), np.flatnonzero(more).astype(np.uint32))

    def finish(blob):
        bits = np.zeros(step, bool)
        bits[np.cumsum(unpack(blob)[1], dtype=np.uint32)] = True
        return pack(np.packbits(bits, bitorder="little"))

    out = np.zeros(width // 8, np.uint8)
    for row in _merged(df.mapInArrow(scan, BLOB), join, finish).collect():
        out[row.part * step // 8 : (row.part + 1) * step // 8] |= unpack(row.blob)[0]
    return out


#: Widths of a bitmap over keys: 16 cells for each, within these bounds.
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 30


def cells_for(n: int) -> int:
    width = LEAST_CELLS
    while width < min(MOST_CELLS, 16 * n):
        width *= 2
    return width


def key_cells(keys: np.ndarray, width: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(width)


class Members:
    """A broadcast bitmap of the longs in a written table's first column, or of the `n` that keys_of gives for
    the batches of a table. test() is never false for one of them and rarely true for another, so that only rows near
    them need move to an exact join."""

    def __init__(self, keys: DataFrame, n: int | None = None, keys_of=lambda batch: batch.column(0).to_numpy()):
        self.width = width = cells_for(keys.count() if n is None else n)
        bits = bitmap(keys, lambda batch: [np.unique(key_cells(keys_of(batch), width))], width, least=1)
        self.sent = keys.sparkSession.sparkContext.broadcast(bits)

    def test(self, keys: np.ndarray) -> np.ndarray:
        return test_bits(self.sent.value, key_cells(keys, self.width))

    def column(self, name: str):
        """test() of a column without nulls."""
        test = self.test

        @F.arrow_udf("boolean")
        def member(keys: pa.Array) -> pa.Array:
            return pa.array(test(keys.to_numpy()))

        return member(name)


def test_bits(bits: np.ndarray, cells) -> np.ndarray:
    cells = cells.astype(np.int64)
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def buckets_for(spark: SparkSession, rows: int, per_bucket: int = 400_000) -> int:
    """Buckets so that each holds about `per_bucket` packed rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_bucket))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir.rstrip(os.sep)}/{name}.parquet")
