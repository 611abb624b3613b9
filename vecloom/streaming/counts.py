"""Token counts over a stream of document files (an extension; the batch operators are the core)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.text import tokenize


def token_counts(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    """A streaming DataFrame of token, freq over parquet files as they come."""
    docs = spark.readStream.schema(schema).parquet(folder)
    return docs.select(F.explode(tokenize("text")).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))
