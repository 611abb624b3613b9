"""Token functions. Null text has no tokens."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vecloom.operators.storage import cut_lineage, settled, ship, written

#: Fixed value: a token holds an ASCII letter, or is the mark of unknown words.
TOKEN = r"[A-Za-z]+[\p{L}\p{N}_^']*|[\p{L}\p{N}_^']*[A-Za-z]+[\p{L}\p{N}_^']*|<unk>"
UNK = "<unk>"


def tokenize(text) -> Column:
    """Lower-cased tokens of a text, in order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def long_enough(tokens, radius: int) -> Column:
    """Whether a sentence has one full window."""
    return F.size(tokens) >= 2 * radius + 1


def clip(tokens, max_length: int | None, radius: int) -> Column:
    """The first max_length tokens; a limit under one window is an error."""
    if max_length is None:
        return F.col(tokens) if isinstance(tokens, str) else tokens
    if max_length < 2 * radius + 1:
        raise ValueError(f"max_length {max_length} is under one window of {2 * radius + 1} tokens")
    return F.slice(tokens, 1, max_length)


def sentences(df: DataFrame, text: str = "text", radius: int | None = None, max_length: int | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """df with `tokens`; with a radius only rows that hold a full window, then clipped."""
    if lemmas is not None:
        df = lemmatize(df, lemmas, text)
    if radius is None:
        return df.withColumn("tokens", tokenize(text))
    # the list comes out of a generator, through which later filters on it aren't pushed, so a text is tokenised once
    fit = F.filter(F.array(tokenize(text)), lambda t: long_enough(t, radius))
    return df.withColumn("tokens", F.explode(F.transform(fit, lambda t: clip(t, max_length, radius))))


#: Parts of speech in the order in which they are looked up: fixed value.
PARTS_OF_SPEECH = ["a", "r", "n", "v"]
#: A table of at most this many changed forms is sent to every executor as one map (which is searched in order).
SENT_FORMS = 200
#: A table of at most this many is sent to every executor for a join by hash.
SENT_WORDS = 200_000
#: Words of texts that meet the changed forms together.
PIECE_WORDS = 1 << 17


def lemmatize(df: DataFrame, lemmas: DataFrame, text: str = "text") -> DataFrame:
    """text lower-cased, split at single spaces, each word replaced by its lemma for each part of
    speech in turn, joined again. lemmas: form, pos, lemma. The four look-ups become one table
    of final forms, which words join by hash."""
    step = lemmas.groupBy("form", "pos").agg(F.min("lemma").alias("lemma"))
    forms = step.select(F.col("form").alias("word")).distinct().withColumn("final", F.col("word"))
    for pos in PARTS_OF_SPEECH:
        one = step.where(F.col("pos") == pos).select(F.col("form").alias("final"), F.col("lemma").alias("next"))
        forms = forms.join(one, "final", "left").select("word", F.coalesce("next", "final").alias("final"))
    return _replaced(df, forms.where("word <> final"), text)


def _replaced(df: DataFrame, changed: DataFrame, text: str, counted: str | None = None) -> DataFrame:
    """text lower-cased, its words parted by single spaces, with each word of changed (word, final) replaced. counted: a column that
    tells how many were."""
    if changed.limit(SENT_FORMS + 1).count() <= SENT_FORMS:  # a look-up in one map, row by row
        table = changed.agg(F.map_from_entries(F.collect_list(F.struct("word", "final"))).alias("__forms"))
        words = F.split(F.lower(text), " ")
        new = F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at("__forms", w), w)), " ")
        met = F.size(F.filter(words, lambda w: F.element_at("__forms", w).isNotNull())).cast("long")
        out = df.crossJoin(F.broadcast(table))
        out = out if counted is None else out.withColumn(counted, F.when(F.col(text).isNotNull(), met))
        return out.withColumn(text, new).drop("__forms")
    # texts lie in pieces; each distinct word of a piece meets the forms once, those that change return to it, and texts move once, to their piece
    ship(df.sparkSession)
    lower = df.withColumn(text, F.lower(text))
    at = lower.columns.index(text)
    pieces = written(lower.mapInArrow(functools.partial(_dealt, at=at, size=PIECE_WORDS), StructType([*lower.schema.fields, StructField("__piece", LongType())])), "pieces")
    words = pieces.select("__piece", text).where(F.col(text).isNotNull()).mapInArrow(_piece_words, "__piece long, word string")
    met = words.join(F.broadcast(changed) if changed.limit(SENT_WORDS + 1).count() <= SENT_WORDS else changed, "word").select("__piece", "word", "final")
    put = functools.partial(_put, at=at, counted=counted)
    schema = lower.schema if counted is None else StructType([*lower.schema.fields, StructField(counted, LongType())])
    return pieces.groupBy("__piece").cogroup(met.groupBy("__piece")).applyInArrow(put, schema)


def _dealt(batches, at: int, size: int):
    """Rows with the number of their piece, of some `size` words."""
    from pyspark import TaskContext

    first, before = TaskContext.get().partitionId() << 33, 0
    for b in batches:
        ends = before + np.cumsum(pc.fill_null(pc.count_substring(b.column(at), " "), 0).to_numpy().astype(np.int64) + 1)
        yield pa.record_batch([*b.columns, pa.array(first + ends // size)], [*b.schema.names, "__piece"])
        before = int(ends[-1]) if len(ends) else before


def _piece_words(batches):
    """The distinct words of each piece; rows of a piece follow one another."""
    piece, words = None, set()
    out = lambda: pa.record_batch([pa.array([piece] * len(words), pa.int64()), pa.array(list(words), pa.string())], ["__piece", "word"])
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1)):
            if k != piece:
                if words:
                    yield out()
                piece, words = k, set()
            words.update(x.as_py().split(" "))
    if words:
        yield out()


def _put(rows: pa.Table, met: pa.Table, at: int, counted: str | None) -> pa.Table:
    forms = dict(zip(met["word"].to_pylist(), met["final"].to_pylist()))
    new, n = [], []
    for x in rows.column(at):
        words = None if (x := x.as_py()) is None else x.split(" ")
        new.append(None if words is None else " ".join([forms.get(w, w) for w in words]) if forms else x)
        n.append(None if words is None else sum(map(forms.__contains__, words)) if counted and forms else 0)
    out = rows.drop_columns(["__piece"]).set_column(at, rows.field(at), pa.array(new, rows.schema.field(at).type))
    return out if counted is None else out.append_column(counted, pa.array(n, pa.int64()))


#: Endings and what takes their place, for each part of speech, in order: fixed values.
ENDINGS = {
    "a": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
    "r": [],
    "n": [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "v": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
}
#: Endings that come off one word for one part of speech, one after the other; a word that needs more stays.
MOST_ENDINGS = 16


def _detached(forms: DataFrame, pos: str) -> DataFrame:
    """forms (word, form, path) with one more ending taken off, by each rule that fits; path: the rules' numbers."""
    made = [F.when(F.col("form").endswith(old), F.struct(F.concat(F.expr(f"left(form, length(form) - {len(old)})"), F.lit(new)).alias("form"), F.concat("path", F.lit(str(k))).alias("path"))) for k, (old, new) in enumerate(ENDINGS[pos])]
    return forms.select("word", F.explode(F.array_compact(F.array(*made))).alias("x")).select("word", "x.form", "x.path")


def rule_lemmas(words: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """word, final: words (word, distinct) that change, with their lemmas, each part of speech starting from what the one before gave.

    dictionary: lemma, pos. exceptions: form, pos, lemma; these forms meet no rule. Of a form itself and what one
    rule makes of it the dictionary's shortest is taken, by ties the form, then the first rule; where it has none, endings come off
    what the rules made until it has one. Forms that stay without any are left as they are. Each step is one
    join of the forms that are still open, once for each distinct one."""
    state = words.select("word", F.col("word").alias("final"))
    for pos in PARTS_OF_SPEECH:
        known = dictionary.where(F.col("pos") == pos).select(F.col("lemma").alias("form")).distinct()
        shortest = lambda forms: forms.join(known, "form", "left_semi").groupBy("word").agg(F.min(F.struct(F.length("form").alias("n"), "path", "form")).alias("x")).select("word", F.col("x.form").alias("lemma"))  # noqa: B023, E731
        asked = cut_lineage(state.select(F.col("final").alias("word")).distinct())
        found, open_ = [], asked
        if exceptions is not None:
            own = exceptions.where(F.col("pos") == pos).select(F.col("form").alias("word"), F.col("lemma").alias("form"))
            hit = asked.join(own.select("word").distinct(), "word", "left_semi")
            # the form itself comes first among equals, then by lemma
            choices = hit.select("word", F.col("word").alias("form"), F.lit("").alias("path")).unionByName(own.join(hit, "word", "left_semi").select("word", "form", F.lit("1").alias("path")))
            found.append(shortest(choices))
            open_ = asked.join(own, "word", "left_anti")
        if ENDINGS[pos]:
            itself = open_.select("word", F.col("word").alias("form"), F.lit("").alias("path"))
            marked = lambda forms: cut_lineage(forms.join(known.withColumn("hit", F.lit(True)), "form", "left"))  # noqa: B023, E731
            # words that end in none of the endings have no other form
            forms = marked(itself.unionByName(_detached(itself, pos)).withColumn("more", F.max(F.length("path")).over(W.partitionBy("word"))).where("more > 0").drop("more"))
            for _ in range(MOST_ENDINGS):
                hits = forms.where("hit")
                found.append(hits.groupBy("word").agg(F.min(F.struct(F.length("form").alias("n"), "path", "form")).alias("x")).select("word", F.col("x.form").alias("lemma")))
                rest = forms.where("path <> ''").join(hits.select("word").distinct(), "word", "left_anti").select("word", "form", "path")
                forms = marked(_detached(rest, pos).groupBy("word", "form").agg(F.min("path").alias("path")))
                if forms.isEmpty():
                    break
        if found:
            lemmas = functools.reduce(DataFrame.unionByName, found).select(F.col("word").alias("final"), "lemma")
            state = state.join(lemmas, "final", "left").select("word", F.coalesce("lemma", "final").alias("final"))
    return cut_lineage(state.where("word <> final"))


def lemmatize_by_rules(df: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None, text: str = "text", counted: str | None = None) -> DataFrame:
    """lemmatize() with lemmas found by endings, as rule_lemmas() has them. Null text stays null. counted: a column that tells how many words changed."""
    words = df.select(F.explode(F.split(F.lower(text), " ")).alias("word")).distinct()
    return _replaced(df, settled(lambda: rule_lemmas(words, dictionary, exceptions), "lemmas"), text, counted)


def normalised_id(column, width: int | None = None, prefix: str = "n") -> Column:
    """Node ids as strings with a letter in front; padded to a width, counted from one."""
    c = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(prefix), c.cast("string")) if width is None else F.format_string(f"{prefix}%0{width}d", c + 1)
