"""The queries of the training-data operators and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

import secrets

from pyspark.sql import functions as F

from vecloom.llm import classifier, decontaminate, licenses, line_dedup, near_dup, negatives, packing, pieces, point_in_time, quality, substring, surrogates, wavelet
from vecloom.llm.common import table
from vecloom.llm.oracles import ORACLE  # noqa: F401


def op1_wavelet_matrix(spark, sf_dir):
    return wavelet.read_shards(wavelet.write_shards(table(spark, sf_dir, "documents")))


def op2_distribution_divergence(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"))


def op3_surrogates(spark, sf_dir):
    # a key of this run's own, unless the session has one for surrogates that are to be the same again
    key = spark.conf.get("spark.vecloom.surrogateKey", None) or secrets.token_hex(16)
    out = surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return out.select("doc_id", "n_entities", "text")


def op4_bbit_minhash(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_random_indexing(spark, sf_dir):
    return classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_count_min_windows(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_latent_semantic(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", F.round("lcs", 6).alias("lcs"), "answer")


def op8_license_digest(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_line_set_join(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"), min_words=1)


def op10_hierarchical_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_painted_timeline(spark, sf_dir):
    return point_in_time.feature_join(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_table(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"))


def op13_bit_sliced_negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_wavelet_matrix, op2_distribution_divergence, op3_surrogates, op4_bbit_minhash, op5_random_indexing, op6_count_min_windows, op7_latent_semantic, op8_license_digest, op9_line_set_join, op10_hierarchical_packing, op11_painted_timeline, op12_prefix_table, op13_bit_sliced_negatives)}
