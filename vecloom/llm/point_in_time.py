"""Point-in-time join: which version of a key's record was in force when a question was asked.

Each key's time line is cut into chunks of seconds. Within a chunk versions come by falling priority, and each
claims the seconds of its span that none before it has claimed; a union-find of next free seconds
steps over what is painted. A question reads the owner of its second.

Every task first paints what it read itself and passes on the versions that own a second there, so that a chunk
sends at most its length in rows from each task, however many versions it has; sorting and painting are streamed, a task
holds one chunk's time line.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import ship

#: Seconds in a chunk.
CHUNK = 1024
_SPAN = "key string, cell long, kind int, lo int, hi int, event long, arrival long"


class TimeLine:
    """A chunk's seconds, each owned by the first that claims it."""

    def __init__(self, length: int):
        self.free = list(range(length + 1))
        self.owner: list = [None] * length

    def next_free(self, i: int) -> int:
        free = self.free
        root = i
        while free[root] != root:
            root = free[root]
        while free[i] != root:
            free[i], i = root, free[i]
        return root

    def claim(self, lo: int, hi: int, who) -> bool:
        """Gives who the unclaimed seconds of [lo, hi); whether there were any."""
        i = first = self.next_free(lo)
        while i < hi:
            self.owner[i] = who
            self.free[i] = i + 1
            i = self.next_free(i + 1)
        return first < hi


def _cells(batch: pa.RecordBatch):
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "cell", "kind", "lo", "hi")))


def as_of(versions: DataFrame, questions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Two struct columns: `question`, a row of questions, and `winner`, the row of versions that answers it, or null.

    versions: key, event, arrival, expiry (whole seconds), version_id and any other columns; a version is usable at t
    where event <= t and arrival <= t < expiry. The latest event wins, then the latest arrival, then the
    largest version_id; of rows equal in these the one whose other columns sort last. questions: key, t and any other
    columns.

    There is one row for each row of questions, repeated ones too. A null key or time on either side meets
    nothing: such versions are left out, such questions get null. An empty span (expiry at or before event or
    arrival) is never in force. Names of columns may clash, as each side stays in its own struct. A version takes one
    row for each chunk that its span touches; long payloads ride along with versions that may win. Empty tables give an
    empty result or null winners."""
    ship(versions.sparkSession)
    v = versions.select(F.col("key").cast("string").alias("key"), *(F.col(c).cast("long").alias(c) for c in ("event", "arrival", "expiry")), F.struct(*(F.col(c) for c in versions.columns)).alias("winner"))
    v = v.where("key is not null").withColumn("from", F.greatest("event", "arrival"))
    v = v.where("event is not null and arrival is not null and from < expiry")
    cell = lambda t: F.expr(f"({t} - pmod({t}, {chunk}L)) div {chunk}L")
    v = v.withColumn("cell", F.explode(F.sequence(cell("from"), cell("(expiry - 1)"))))
    start = F.col("cell") * chunk
    spans = v.select("key", "cell", F.lit(0).alias("kind"), F.greatest(F.col("from") - start, F.lit(0)).cast("int").alias("lo"), F.least(F.col("expiry") - start, F.lit(chunk)).cast("int").alias("hi"), "event", "arrival", "winner")
    priority = [F.desc("event"), F.desc("arrival"), F.desc("winner.version_id"), F.desc("winner")]

    def local(batches):
        at, line = None, None
        for batch in batches:
            keep = []
            for i, (key, cell, _, lo, hi) in enumerate(_cells(batch)):
                if (key, cell) != at:
                    at, line = (key, cell), TimeLine(chunk)
                if line.claim(lo, hi, True):
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep))

    spans = spans.sortWithinPartitions("key", "cell", *priority).mapInArrow(local, spans.schema)
    q = questions.select(F.col("key").cast("string").alias("key"), F.col("t").cast("long").alias("t"), F.struct(*(F.col(c) for c in questions.columns)).alias("question"))
    lost = F.col("key").isNull() | F.col("t").isNull()  # dealt by their rows, as no cell is theirs
    q = q.select("key", F.when(lost, F.xxhash64("question")).otherwise(cell("t")).alias("cell"), F.when(lost, 2).otherwise(1).alias("kind"), F.pmod("t", F.lit(chunk)).cast("int").alias("lo"), "question")
    both = spans.unionByName(q, allowMissingColumns=True).repartition("key", "cell").sortWithinPartitions("key", "cell", "kind", *priority)
    out = both.select("question", "winner")

    def answer(batches):
        at, line = None, None
        for batch in batches:
            asked, got = [], []
            winners = batch.column(batch.schema.get_field_index("winner"))
            for i, (key, cell, kind, lo, hi) in enumerate(_cells(batch)):
                if (key, cell) != at:
                    at, line = (key, cell), TimeLine(chunk)
                if kind == 0:
                    if line.next_free(lo) < hi:
                        line.claim(lo, hi, winners[i].as_py())
                else:
                    asked.append(i)
                    got.append(line.owner[lo] if kind == 1 else None)
            if asked:
                question = batch.column(batch.schema.get_field_index("question")).take(pa.array(asked))
                yield pa.record_batch([question, pa.array(got, winners.type)], ["question", "winner"])

    return both.mapInArrow(answer, out.schema)


def label_questions(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions and questions of the tables: every document is a version of its source, every label asks about its
    document's source, at times that the sha256 of doc_id gives. A doc_id that occurs with several sources is
    asked about under the last of them in order."""
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    part = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    event = F.pmod(part(0), F.lit(200000))
    v = documents.select(F.col("source").alias("key"), event.alias("event"), (event - 60 + F.pmod(part(1), F.lit(1200))).alias("arrival"), (event + F.pmod(part(2), F.lit(900))).alias("expiry"), F.col("doc_id").cast("long").alias("version_id"), "n_chars", "lang")
    asked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(part(3), F.lit(200000)).alias("t"))
    source = documents.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("source").alias("key"))
    known = asked.where("doc_id is not null").join(source.hint("merge"), "doc_id", "left")
    return v, known.unionByName(asked.where("doc_id is null"), allowMissingColumns=True)


def feature_join(documents: DataFrame, labels: DataFrame, stale: int = 20) -> DataFrame:
    """Per label: doc_id, t, version_id, age, status, n_chars, lang. A version older than `stale` seconds gives no
    features. A null doc_id has no document and no time: its status is none. Other columns of either table
    don't matter; an empty `labels` gives an empty result."""
    w = F.col("winner")
    out = as_of(*label_questions(documents, labels)).withColumn("age", F.col("question.t") - w["event"])
    fresh = F.col("age") <= stale
    return out.select("question.doc_id", "question.t", w["version_id"].alias("version_id"), "age", F.when(w.isNull(), "none").when(fresh, "fresh").otherwise("stale").alias("status"), F.when(fresh, w["n_chars"]).cast("long").alias("n_chars"), F.when(fresh, w["lang"]).alias("lang"))
