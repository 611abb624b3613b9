"""Vocabularies, dictionary encoding, training windows and corpus statistics."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from vecloom.functions.text import UNK
from vecloom.operators.storage import cut_lineage, ship

#: A vocabulary of at most this many rows is sent to every executor.
SENT_ROWS = 200_000
#: One of at most this many rows is sent to Python workers as a table of tokens and indices.
SENT_TOKENS = 1_000_000


def numbered(df: DataFrame, order, first: int = 0) -> DataFrame:
    """df with idx, counting on from `first` in the order of columns. The table is cut into ranges of the
    order and written once; sizes and ranks of the ranges come from what is written, so they always
    fit together, and no task sees the whole table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__i", F.monotonically_increasing_id()))
    part, place = F.shiftright("__i", 33), F.col("__i").bitwiseAND((1 << 33) - 1)
    sizes = parts.groupBy(part.alias("__q")).agg(F.count("*").alias("__n"))
    base = sizes.select("__q", F.coalesce(F.sum("__n").over(W.orderBy("__q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return parts.join(F.broadcast(base), part == F.col("__q")).withColumn("idx", F.col("__base") + place + first).drop("__i", "__q", "__base")


def word_counts(sentences: DataFrame) -> DataFrame:
    return sentences.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def build_vocab(sentences: DataFrame, min_freq: int = 1, by_frequency: bool = True) -> DataFrame:
    """token, idx, freq. Index 0 is the mark of unknown words; then by falling frequency and token,
    or, for graphs, by token alone, each counted once."""
    counts = cut_lineage(word_counts(sentences))
    if not by_frequency:
        counts = counts.withColumn("freq", F.lit(1).cast("long"))
    unk = counts.agg(F.coalesce(F.max(F.when(F.col("token") == UNK, F.col("freq"))), F.lit(0)).alias("freq")).select(F.lit(UNK).alias("token"), F.lit(0).alias("idx"), "freq")
    kept = counts.where((F.col("token") != UNK) & (F.col("freq") >= min_freq))
    order = [F.col("freq").desc(), F.col("token")] if by_frequency else [F.col("token")]
    # indices of tokens are ints; a vocabulary of 2**31 or more fails rather than wraps
    return unk.unionByName(numbered(kept, order, 1).select("token", F.when(F.col("idx") < 1 << 31, F.col("idx")).otherwise(F.raise_error("too many tokens for an int")).cast("int").alias("idx"), "freq"))


def word_frequency(vocab: DataFrame) -> DataFrame:
    """Counts of tokens in the vocabulary; the unknown mark only where the text holds it."""
    return vocab.where("freq > 0").select("token", "freq")


def top_words(vocab: DataFrame, n: int) -> DataFrame:
    """The n most frequent tokens with their indices; ties by token."""
    return vocab.where("freq > 0").orderBy(F.col("freq").desc(), "token").limit(n)


def maybe_sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def _looked_up(lists: DataFrame, key: str, column: str, out: str, kind: str, table: pa.Table) -> DataFrame:
    """key, out: each entry of a list column looked up in table (found, given), null where it isn't there. Lists stay whole, so nothing is shuffled."""
    spark = ship(lists.sparkSession)
    sent = spark.sparkContext.broadcast(table.combine_chunks())
    wanted = "array<string>" if column == "tokens" else "array<int>"
    rows = lists.select(key, F.col(column).cast(wanted).alias(column)).where(F.size(column) > 0)

    def run(batches):
        found, given = (c.combine_chunks() for c in sent.value.columns)
        for b in batches:
            x = b.column(1)
            ends = pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy())]).astype(np.int32))
            flat = x.flatten()
            flat = given.take(pc.index_in(flat, value_set=found.cast(flat.type)))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(ends, flat)], [key, out])

    return rows.mapInArrow(run, StructType([rows.schema[key], StructField(out, ArrayType(kind))]))


def _sent_table(vocab: DataFrame, columns: list[str]) -> pa.Table | None:
    """Two columns of a vocabulary of at most SENT_TOKENS rows."""
    return None if vocab.limit(SENT_TOKENS + 1).count() > SENT_TOKENS else vocab.select(*columns).toArrow()


def encode(sentences: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """key, ids: indices in order; tokens outside the vocabulary are 0. Keys are distinct. A vocabulary that can be sent is looked up
    sentence by sentence; only a larger one meets the tokens in a join."""
    if (table := _sent_table(vocab, ["token", "idx"])) is not None:
        found = _looked_up(sentences, key, "tokens", "ids", IntegerType(), table)
        return found.select(key, F.transform("ids", lambda x: F.coalesce(x, F.lit(0))).alias("ids"))
    flat = sentences.select(key, F.posexplode("tokens").alias("at", "token"))
    found = flat.join(vocab.select("token", "idx"), "token", "left").select(key, F.struct("at", F.coalesce("idx", F.lit(0)).alias("idx")).alias("x"))
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["idx"]).alias("ids"))


def decode_sentences(sentences: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """key, tokens: those of the ids in order. Keys are distinct."""
    if (table := _sent_table(vocab, ["idx", "token"])) is not None:
        return _looked_up(sentences, key, "ids", "tokens", StringType(), table)
    back = decode(sentences.select(key, F.posexplode("ids").alias("at", "idx")), vocab)
    return back.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("tokens"))


def decode(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows with idx and their tokens."""
    return ids.join(maybe_sent(vocab.select("idx", "token")), "idx", "left")


def windows(sentences: DataFrame, radius: int, mode: str = "sg", tokens: str = "tokens") -> DataFrame:
    """One row for each full window: input and targets (sg), or the two swapped (cbow)."""
    mode = mode.lower()
    if mode not in ("sg", "cbow"):
        raise ValueError(f"mode {mode!r}: 'sg' or 'cbow'")
    rest = [c for c in sentences.columns if c != tokens]
    at = F.explode(F.sequence(F.lit(radius), F.size(tokens) - radius - 1))
    rows = sentences.where(F.size(tokens) >= 2 * radius + 1).select(*rest, tokens, at.alias("at"))
    around = F.concat(F.slice(tokens, F.col("at") - radius + 1, radius), F.slice(tokens, F.col("at") + 2, radius))
    center = F.array(F.get(tokens, F.col("at")))
    a, b = (center, around) if mode == "sg" else (around, center)
    return rows.select(*rest, "at", a.alias("inputs"), b.alias("targets"))


def pair_counts(sentences: DataFrame, radius: int, tokens: str = "tokens") -> DataFrame:
    """center, ctx, n over all full windows. A pair of places is counted once for both directions, which come apart after the counting."""
    t, last = F.col(tokens), F.size("t") - radius - 1
    # each place with the `radius` after it
    i = sentences.where(F.size(t) >= 2 * radius + 1).select(t.alias("t"), F.explode(F.sequence(F.lit(0), (F.size(t) - 1) * radius - 1)).alias("i"))
    place = (F.col("i") / radius).cast("int")
    places = i.select("t", place.alias("at"), (place + 1 + F.col("i") % radius).alias("to"))
    # a window is full around a place that has `radius` others on both sides
    is_center = lambda c: F.col(c).between(F.lit(radius), last)
    places = places.where((F.col("to") < F.size("t")) & (is_center("at") | is_center("to")))
    pairs = places.select(F.get("t", "at").alias("x"), F.get("t", "to").alias("y"), is_center("at").cast("long").alias("there"), is_center("to").cast("long").alias("back"))
    turned = F.coalesce(F.col("x") > F.col("y"), F.col("y").isNull() & F.col("x").isNotNull())
    either = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    sums = pairs.select(either("x", "y").alias("a"), either("y", "x").alias("b"), either("there", "back").alias("there"), either("back", "there").alias("back")).groupBy("a", "b").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    way = lambda center, ctx, n: F.struct(F.col(center).alias("center"), F.col(ctx).alias("ctx"), n.alias("n"))
    both = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(way("a", "b", F.col("there") + F.col("back")))).otherwise(F.array(way("a", "b", F.col("there")), way("b", "a", F.col("back"))))
    return sums.select(F.explode(both).alias("p")).select("p.center", "p.ctx", "p.n").where("n > 0")


def examples(sentences: DataFrame, radius: int, mode: str = "sg", tokens: str = "ids") -> DataFrame:
    """inputs, target, n over all full windows: what a trainer takes."""
    if mode.lower() == "sg":
        return pair_counts(sentences, radius, tokens).select(F.array("center").alias("inputs"), F.col("ctx").alias("target"), "n")
    w = windows(sentences.select(tokens), radius, mode, tokens)
    return w.select("inputs", F.explode("targets").alias("target")).groupBy("inputs", "target").agg(F.count("*").alias("n"))


def batch_examples(sentences: DataFrame, order: list[str], size: int, radius: int, mode: str = "sg", tokens: str = "ids") -> DataFrame:
    """batch, inputs, target, n: the examples of each batch of `size` sentences, in the order of columns, whose values are distinct.
    Sentences without a window don't count."""
    long = sentences.where(F.size(tokens) >= 2 * radius + 1).select(*order, tokens)
    # a batch's sentences meet before they become windows, so that examples are counted where they arise
    dealt = batches(long, order, size).select("batch", tokens).repartition("batch")
    if mode.lower() == "sg" and isinstance(long.schema[tokens].dataType.elementType, (IntegerType, LongType)):
        ship(sentences.sparkSession)
        kind = long.schema[tokens].dataType.elementType.simpleString()
        rows = dealt.where("batch IS NOT NULL").sortWithinPartitions("batch").select("batch", F.col(tokens).cast("array<long>").alias("t"))
        return rows.mapInArrow(functools.partial(_batch_pairs, radius=radius), "batch long, input long, target long, n long").select("batch", F.array(F.col("input").cast(kind)).alias("inputs"), F.col("target").cast(kind).alias("target"), "n")
    w = windows(dealt, radius, mode, tokens)
    return w.select("batch", "inputs", F.explode("targets").alias("target")).groupBy("batch", "inputs", "target").agg(F.count("*").alias("n"))


def _batch_pairs(batches, radius: int):
    """Rows (batch, list of indices) in the order of batches as batch, input, target, n: the pairs of each batch, counted. What a task holds is one batch of
    sentences and its pairs."""

    def counted(batch, parts):
        t, width = (np.concatenate(x) for x in zip(*parts))
        end = np.repeat(np.cumsum(width), width)
        start = end - np.repeat(width, width)
        at = np.arange(len(t))
        center = np.flatnonzero((at - start >= radius) & (end - at > radius))
        shifts = np.r_[-radius:0, 1 : radius + 1]
        pairs = np.empty((len(center), 2 * radius, 2), np.int64)
        pairs[:, :, 0] = t[center, None]
        pairs[:, :, 1] = t[center[:, None] + shifts]
        pairs = pairs.reshape(-1, 2)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(1)][: len(pairs)])
        n = np.diff(np.append(first, len(pairs)))
        return pa.record_batch([pa.array(np.full(len(first), batch, np.int64)), pa.array(pairs[first, 0]), pa.array(pairs[first, 1]), pa.array(n)], ["batch", "input", "target", "n"])

    held, batch = [], None
    for b in batches:
        if not b.num_rows:
            continue
        of = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and of[lo] != batch:
                yield counted(batch, held)
                held = []
            batch, x = of[lo], b.column(1).slice(lo, hi - lo)
            held.append((x.flatten().to_numpy(), pc.list_value_length(x).to_numpy()))
    if held:
        yield counted(batch, held)


def batches(sentences: DataFrame, order: list[str], size: int) -> DataFrame:
    """sentences with batch: `size` sentences each, in the order of columns."""
    cols = [F.col(c) for c in order]
    return numbered(sentences, cols).withColumn("batch", F.floor(F.col("idx") / size).cast("long")).drop("idx")


def length_histogram(sentences: DataFrame) -> DataFrame:
    return sentences.where(F.size("tokens") > 0).groupBy(F.size("tokens").alias("length")).agg(F.count("*").alias("n"))


def totals(sentences: DataFrame) -> DataFrame:
    return word_counts(sentences).agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_distinct"))


def frequency_histogram(sentences: DataFrame, bins: int = 50, below: int = 100_000) -> DataFrame:
    """bin, n: tokens by frequency in equal bins over [1, below)."""
    width = -(-(below - 1) // bins)
    return word_counts(sentences).where(F.col("freq") < below).groupBy(F.floor((F.col("freq") - 1) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def threshold_curve(sentences: DataFrame, upto: int = 100) -> DataFrame:
    """threshold, n: tokens that occur at least so often. Frequencies are capped at the last threshold first,
    so that the running sum is over `upto` rows."""
    capped = word_counts(sentences).groupBy(F.least("freq", F.lit(upto - 1)).alias("f")).agg(F.count("*").alias("c"))
    steps = sentences.sparkSession.range(upto).withColumnRenamed("id", "threshold")
    return steps.join(F.broadcast(capped), F.col("f") >= F.col("threshold"), "left").groupBy("threshold").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
