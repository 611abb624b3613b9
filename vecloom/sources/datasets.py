"""Named sources of sentences and graphs, and readers for their files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.text import normalised_id
from vecloom.operators.graph import Graph, canonical_edges

REGISTRY: dict[str, Callable] = {}


def register_dataset(name: str):
    """Decorator: a source by name; a name is taken once."""

    def add(f):
        if name in REGISTRY:
            raise ValueError(f"data set {name!r} is registered already")
        REGISTRY[name] = f
        return f

    return add


def dataset(spark: SparkSession, name: str, **options):
    if name not in REGISTRY:
        raise ValueError(f"data set {name!r}: one of {sorted(REGISTRY)}")
    return REGISTRY[name](spark, **options)


def sentences(spark: SparkSession, texts: list[str]) -> DataFrame:
    """sent_id, text of a list."""
    return spark.createDataFrame(list(enumerate(texts)), "sent_id long, text string")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """text, one line each."""
    return spark.read.text(path).withColumnRenamed("value", "text")


#: The sentences of the test set: fixed values.
TEST = ["a, a, c, b, b", "hello world! hello world!", "test here, test there, here there", "."]


@register_dataset("test")
def _test(spark):
    return sentences(spark, TEST)


#: The sentences of the abcde set: fixed values.
ABCDE = [
    "a b a b a b a b a b",
    "a b a b a b",
    "b a b a",
    "a b a b a b a b",
    "c d c d c d c d",
    "d c d c d c",
    "c d c d c d",
    "e e e e e e e e",
    "e e e",
]


@register_dataset("abcde")
def _abcde(spark):
    return sentences(spark, ABCDE)


def _wiki(name):
    def read(spark, split: str = "train", assets: str = "assets"):
        return text_lines(spark, f"{assets}/{name}/wiki.{split}.tokens")

    return read


register_dataset("wiki-text-2")(_wiki("wikitext-2"))
register_dataset("wiki-text-103")(_wiki("wikitext-103"))


@register_dataset("shakespeare")
def _shakespeare(spark, assets: str = "assets"):
    return spark.read.option("header", True).csv(f"{assets}/Shakespeare_data.csv").select(F.col("PlayerLine").alias("text")).where("text IS NOT NULL")


def edge_table(spark, pairs) -> DataFrame:
    return spark.createDataFrame([(a, b, None) for a, b in pairs], "src string, dst string, weight double")


@register_dataset("graph_triplets")
def _triplets(spark):
    edges = edge_table(spark, [(f"{c}{k}", f"{c}{k + 1}") for c in "abc" for k in (1, 2)])
    labels = spark.createDataFrame([(f"{c}{k}", str(i)) for i, c in enumerate("abc") for k in (1, 2, 3)], "node string, label string")
    return Graph(edges, labels)


#: Zachary's karate club: members from 1, each friendship once as (member, member, weight); the factions: fixed values.
KARATE = [
    (1, 2, 4), (1, 3, 5), (1, 4, 3), (1, 5, 3), (1, 6, 3), (1, 7, 3), (1, 8, 2), (1, 9, 2), (1, 11, 2), (1, 12, 3), (1, 13, 1), (1, 14, 3), (1, 18, 2), (1, 20, 2), (1, 22, 2), (1, 32, 2),
    (2, 3, 6), (2, 4, 3), (2, 8, 4), (2, 14, 5), (2, 18, 1), (2, 20, 2), (2, 22, 2), (2, 31, 2),
    (3, 4, 3), (3, 8, 4), (3, 9, 5), (3, 10, 1), (3, 14, 3), (3, 28, 2), (3, 29, 2), (3, 33, 2),
    (4, 8, 3), (4, 13, 3), (4, 14, 3), (5, 7, 2), (5, 11, 3), (6, 7, 5), (6, 11, 3), (6, 17, 3), (7, 17, 3),
    (9, 31, 3), (9, 33, 3), (9, 34, 4), (10, 34, 2), (14, 34, 3), (15, 33, 3), (15, 34, 2), (16, 33, 3), (16, 34, 4), (19, 33, 1), (19, 34, 2), (20, 34, 1), (21, 33, 3), (21, 34, 1), (23, 33, 2), (23, 34, 3),
    (24, 26, 5), (24, 28, 4), (24, 30, 3), (24, 33, 5), (24, 34, 4), (25, 26, 2), (25, 28, 3), (25, 32, 2), (26, 32, 7), (27, 30, 4), (27, 34, 2), (28, 34, 4), (29, 32, 2), (29, 34, 2),
    (30, 33, 4), (30, 34, 2), (31, 33, 3), (31, 34, 3), (32, 33, 4), (32, 34, 4), (33, 34, 5),
]
KARATE_LABELS = {"1": [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 17, 18, 20, 22], "2": [10, 15, 16, 19, 21, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34]}


@register_dataset("graph_karate_club")
def _karate(spark):
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", float(w)) for a, b, w in KARATE], "src string, dst string, weight double")
    return Graph(edges, spark.createDataFrame([(f"n{k:02d}", label) for label, members in KARATE_LABELS.items() for k in members], "node string, label string"))


@register_dataset("graph_cora")
def _cora(spark, assets: str = "assets"):
    cites = spark.read.option("sep", "\t").schema("target string, source string").csv(f"{assets}/cora/cora.cites")
    edges = canonical_edges(cites.select(normalised_id("source").alias("src"), normalised_id("target").alias("dst"), F.lit(None).cast("double").alias("weight")))
    words = [f"w_{k}" for k in range(1433)]
    content = spark.read.option("sep", "\t").schema(", ".join(["paper_id string", *(f"{w} int" for w in words), "subject string"])).csv(f"{assets}/cora/cora.content")
    nodes = content.select(normalised_id("paper_id").alias("node"), F.col("subject").alias("label"), F.array(*(F.col(w).cast("double") for w in words)).alias("feats"))
    return Graph(edges, nodes.select("node", "label"), nodes.select("node", "feats"))


def parquet_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, text of every line of documents."""
    return parquet_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite graph of suppliers and parts; weight: lines of orders."""
    # counted by the keys themselves, which are smaller than the names made of them
    pairs = parquet_table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight"))
    return pairs.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "weight")


def part_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph of parts that are in one order; weight: orders."""
    # counted by the keys themselves, which are smaller than the names made of them
    li = parquet_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = li.select("l_orderkey", F.col("l_partkey").alias("other"))
    pairs = li.join(other, "l_orderkey").where("l_partkey < other").groupBy("l_partkey", "other").agg(F.count("*").cast("double").alias("weight"))
    a, b = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("p"), "other")
    return pairs.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "weight")
