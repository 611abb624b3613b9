"""Quality rules by distribution divergence (DataFrame functions only).

A document's character-class histogram and its histogram of common function words are compared
with the mean histograms of its language by Jensen-Shannon distance (base 2, 0 to 1). The mean
histograms are learnt from all documents of the table. Either distance counts only for documents
that are long enough (`min_words`, `min_chars`).

Null text: no words, so the base rules reject it. Null or unknown lang: its own reference ("*").
Repeated rows are judged alike, each for itself. Empty table: empty result. Other columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import materialize

P = "__vq_"
#: Frequent function words by language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for"],
    "fr": ["de", "la", "le", "les", "des", "et", "en", "un", "que", "pour"],
    "de": ["der", "die", "und", "in", "den", "das", "von", "zu", "mit", "ist"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "un", "por"],
}
#: Each class takes what the ones before have left of the text without lower-case letters and
#: spaces; what remains is non-ASCII.
CLASSES = {"upper": "[A-Z]+", "symbol": "[#*$%&|<>]+", "digit": "[0-9]+", "punct": "[!-~]+"}
SPACES = ["\t", "\n", "\x0b", "\x0c", "\r"]
MAX_CHAR_JSD = 0.30
MAX_WORD_JSD = 0.265


def _histograms(docs: DataFrame) -> DataFrame:
    """docs with the word array and the two histograms, under prefixed names."""
    df = docs.withColumn(f"{P}t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn(f"{P}key", F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("*"))
    spaced = F.col(f"{P}t")
    for c in SPACES:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    df = df.withColumn(f"{P}w", F.array_remove(F.split(spaced, " "), ""))
    df = df.withColumn(f"{P}n", F.size(f"{P}w").cast("long"))
    # two spaces between words, so that neighbours don't share one
    df = df.withColumn(f"{P}joined", F.concat(F.lit(" "), F.array_join(f"{P}w", "  "), F.lit(" ")))
    df = df.withColumn(f"{P}word_chars", F.greatest(F.length(f"{P}joined").cast("long") - 2 * F.greatest(F.col(f"{P}n"), F.lit(1)), F.lit(0)))
    df = df.withColumn(f"{P}rest_lower", F.regexp_replace(f"{P}t", r"[a-z\x20\x09-\x0D]+", ""))
    left, counts = f"{P}rest_lower", []
    for name, pattern in CLASSES.items():
        rest = f"{P}rest_{name}"
        df = df.withColumn(rest, F.regexp_replace(left, pattern, ""))
        df = df.withColumn(f"{P}c_{name}", (F.length(left) - F.length(rest)).cast("long"))
        counts.append(F.col(f"{P}c_{name}"))
        left = rest
    spaces = F.length(f"{P}t") - F.col(f"{P}word_chars")
    chars = F.array(*(x.cast("double") for x in (spaces, F.col(f"{P}word_chars") - F.length(f"{P}rest_lower"), *counts, F.length(left))))
    words = []
    for k in range(10):
        word = F.lit(f" {COMMON['en'][k]} ")
        for lang in ("fr", "de", "es"):
            word = F.when(F.col(f"{P}key") == lang, F.lit(f" {COMMON[lang][k]} ")).otherwise(word)
        words.append((F.length(f"{P}joined") - F.length(F.replace(f"{P}joined", word, F.lit("")))) / F.length(word))
    df = df.withColumn(f"{P}chars", chars).withColumn(f"{P}found", F.array(*words))
    return df.withColumn(f"{P}words", F.array_append(f"{P}found", F.col(f"{P}n") - F.aggregate(f"{P}found", F.lit(0.0), lambda a, x: a + x)))


#: Bins of the two histograms.
BINS = {"chars": 7, "words": 11}


def _shares(column: str):
    total = F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
    return F.transform(column, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def references(measured: DataFrame, min_words: int = 100) -> DataFrame:
    """Mean histograms by language over all documents that pass the base rules and are long enough: five rows at most."""
    df = measured.where((F.col(f"{P}n") >= min_words) & ~F.col(f"{P}base_failed")).select(F.col(f"{P}key").alias(f"{P}ref"), *(_shares(f"{P}{h}").alias(h) for h in BINS))
    means = df.groupBy(f"{P}ref").agg(*(F.avg(F.get(h, F.lit(k))).alias(f"{h}{k}") for h, n in BINS.items() for k in range(n)))
    return means.select(f"{P}ref", *(F.array(*(f"{h}{k}" for k in range(n))).alias(f"{P}{h}_ref") for h, n in BINS.items()))


def _distance(column: str):
    """Jensen-Shannon distance of a row's histogram from its reference."""

    def part(p, q):
        m = (p + q) / 2
        return F.when(p > 0, p * F.ln(p / m)).otherwise(0.0) + F.when(q > 0, q * F.ln(q / m)).otherwise(0.0)

    total = F.aggregate(F.zip_with(_shares(column), F.col(f"{column}_ref"), part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), total / (2 * math.log(2))))


def repeated_words(words: str, n: str):
    """Words in 3-word windows that the array holds twice or more, as a long.

    Each window is one long: its hash above, its place in the low bits. Sorted, equal windows
    are neighbours, and no array is searched within another. With b bits for places 64-b bits
    of hash remain; the windows that meet are sorted again by their words, so none is counted by chance.
    """
    grams = f"transform(sequence(0, cast({n} as int) - 3), i -> shiftleft(xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2)), b) | i)"
    again = "filter(s, (x, j) -> shiftrightunsigned(x, b) = shiftrightunsigned(get(s, j + 1), b) OR shiftrightunsigned(x, b) = shiftrightunsigned(get(s, j - 1), b))"
    met = f"transform({again}, x -> cast(x & (shiftleft(1L, b) - 1) as int))"
    read = f"sort_array(transform({met}, i -> struct(get({words}, i) as u, get({words}, i + 1) as v, get({words}, i + 2) as w, i as i)))"
    same = lambda k: f"(x.u = get(t, {k}).u AND x.v = get(t, {k}).v AND x.w = get(t, {k}).w)"
    places = f"get(transform(array({read}), t -> transform(filter(t, (x, j) -> {same('j + 1')} OR {same('j - 1')}), x -> x.i)), 0)"
    covered = "size(array_union(array_union(p, transform(p, x -> x + 1)), transform(p, x -> x + 2)))"
    return F.expr(
        f"CASE WHEN {n} < 4 THEN 0L ELSE cast(get(transform(array(length(bin({n}))), b -> get(transform(array(sort_array({grams})), s -> get(transform(array({places}), p -> {covered}), 0)), 0)), 0) as bigint) END"
    )


def judge(docs: DataFrame, keep: list[str], min_words: int = 100, min_chars: int = 300, max_char_jsd: float = MAX_CHAR_JSD, max_word_jsd: float = MAX_WORD_JSD) -> DataFrame:
    """The columns `keep` of docs, with n, word_chars, c_symbol, dup, repeat, base_failed, char_jsd,
    word_jsd and kept under the prefix `__vq_`. Texts are measured once; the figures go to a table
    in the shared folder, from which the references and the verdicts are read."""
    df = _histograms(docs)
    df = df.withColumn(f"{P}lines", F.filter(F.split(f"{P}t", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != ""))
    df = df.withColumn(f"{P}dup", (F.size(f"{P}lines") - F.size(F.array_distinct(f"{P}lines"))).cast("long"))
    df = df.withColumn(f"{P}repeat", repeated_words(f"{P}w", f"{P}n"))
    figures = ["key", "n", "word_chars", "c_symbol", "dup", "repeat", *BINS]
    df = materialize(df.select(*(F.col(f"`{c}`") for c in keep), *(f"{P}{x}" for x in figures)), "quality")
    df = df.withColumn(f"{P}base_failed", (F.col(f"{P}n") < 50) | (100 * F.col(f"{P}repeat") > 50 * F.col(f"{P}n")))
    df = df.join(F.broadcast(references(df, min_words)), F.col(f"{P}key") == F.col(f"{P}ref"), "left")
    df = df.withColumn(f"{P}char_jsd", _distance(f"{P}chars")).withColumn(f"{P}word_jsd", _distance(f"{P}words"))
    far = ((F.col(f"{P}word_chars") >= min_chars) & (F.col(f"{P}char_jsd") > max_char_jsd)) | ((F.col(f"{P}n") >= min_words) & (F.col(f"{P}word_jsd") > max_word_jsd))
    return df.withColumn(f"{P}kept", ~F.col(f"{P}base_failed") & ~F.coalesce(far, F.lit(False)))


def report(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: the base figures and the verdict."""
    named = {"n_words": "n", "word_chars": "word_chars", "n_symbols": "c_symbol", "n_dup_lines": "dup", "n_repeat_words": "repeat", "base_failed": "base_failed", "kept": "kept"}
    return judge(docs.select("doc_id", "text", "lang"), ["doc_id"], **limits).select("doc_id", *(F.col(f"{P}{v}").alias(k) for k, v in named.items()))


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    return judge(docs, docs.columns, **limits).where(f"{P}kept").select(*(F.col(f"`{c}`") for c in docs.columns))
