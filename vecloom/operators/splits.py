"""Seeded splits. Rows get `split`: train, val or test, by ranks of a counter-based draw of a key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions import rng


def test_size(n: int, train_ratio: float) -> int:
    """Rows of the test part: rounded up."""
    return math.ceil(round((1 - train_ratio) * n, 9))


def ranks(df: DataFrame, draw, order, by=(), n: int | None = None) -> DataFrame:
    """df with __r, the rank from 1 by (draw, columns of order), within `by`. draw: of rng.bits(). Rows are ranked within
    ranges of the draw of some 2**16 rows each, which count on from the ones before, so no task sorts the whole
    table. n: rows of df, where they are known."""
    cols = [F.col(c) for c in by]
    width = min(30, max(8, ((df.count() if n is None else n) >> 16).bit_length()))
    rows = df.withColumn("__d", draw).withColumn("__bin", F.shiftright("__d", (rng.SPAN.bit_length() - 1) - width).cast("int"))
    sizes = rows.groupBy(*cols, "__bin").agg(F.count("*").alias("__n"))
    base = sizes.select(*(c.alias(f"__b{k}") for k, c in enumerate(cols)), F.col("__bin").alias("__bb"), F.coalesce(F.sum("__n").over(W.partitionBy(*cols).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    same = F.col("__bin") == F.col("__bb")
    for k, c in enumerate(cols):
        same = same & c.eqNullSafe(F.col(f"__b{k}"))
    ranked = rows.withColumn("__k", F.row_number().over(W.partitionBy(*cols, "__bin").orderBy("__d", *order)))
    return ranked.join(base, same).withColumn("__r", F.col("__k") + F.col("__base")).drop("__d", "__bin", "__k", "__bb", "__base", *(f"__b{k}" for k in range(len(cols))))


def allocation(df: DataFrame, label: str, total: int, n: int) -> DataFrame:
    """Rows of each class for the test part, largest remainders first, ties by class."""
    c = df.groupBy(label).agg(F.count("*").alias("n")).withColumn("exact", F.col("n") * F.lit(float(total)) / F.lit(float(n))).withColumn("base", F.floor("exact"))
    left = F.lit(total) - F.sum("base").over(W.partitionBy())
    return c.withColumn("k", F.row_number().over(W.orderBy((F.col("exact") - F.col("base")).desc(), label))).select(label, (F.col("base") + F.when(F.col("k") <= left, 1).otherwise(0)).alias("take"))


def train_test(df: DataFrame, key: str, train_ratio: float, seed: int = 42, label: str | None = None, test_all: bool = False) -> DataFrame:
    """label: stratify by it. test_all: the test part is the whole table (train rows come twice)."""
    n = df.count()
    test, draw = test_size(n, train_ratio), rng.bits(seed, F.col(key))
    if label is None:
        out = ranks(df, draw, [key], n=n).withColumn("split", F.when(F.col("__r") <= test, "test").otherwise("train")).drop("__r")
    else:
        ranked = ranks(df, draw, [key], [label], n)
        out = ranked.join(allocation(df, label, test, n), label).withColumn("split", F.when(F.col("__r") <= F.col("take"), "test").otherwise("train")).drop("__r", "take")
    return out if not test_all else out.where("split = 'train'").unionByName(df.withColumn("split", F.lit("test")))


def train_val_test(df: DataFrame, key: str, train_ratio: float, val_ratio: float, seed: int = 42, label: str | None = None) -> DataFrame:
    """val_ratio is the share of train and val together. label: stratify by it, train against the rest first, then the rest in two;
    rows without a label go."""
    if not 0 < train_ratio < val_ratio < 1:
        raise ValueError("0 < train_ratio < val_ratio < 1; val_ratio counts from the start")
    n = df.count()
    rest = test_size(n, train_ratio)
    test = math.ceil(round(rest * (1 - val_ratio) / (1 - train_ratio), 9))
    draw, part = rng.bits(seed, F.col(key)), F.when(F.col("__r") <= F.col("take"), "test").when(F.col("__r") <= F.col("rest"), "val").otherwise("train")
    if label is None:
        return ranks(df, draw, [key], n=n).withColumn("take", F.lit(test)).withColumn("rest", F.lit(rest)).withColumn("split", part).drop("__r", "take", "rest")
    ranked = ranks(df, draw, [key], [label], n).join(allocation(df, label, rest, n).withColumnRenamed("take", "rest"), label)
    second = allocation(ranked.where(F.col("__r") <= F.col("rest")), label, test, rest)
    # a class may have no row in the rest
    return ranked.join(second, label, "left").withColumn("take", F.coalesce("take", F.lit(0))).withColumn("split", part).drop("__r", "take", "rest")


def n_per_class(df: DataFrame, key: str, label: str, train: int, val: int, test: int | None = None, seed: int = 42) -> DataFrame:
    """Fixed numbers of each class; without `test`, what is left. Rows of no part go."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    if least is None or least < train + val + (test or 0):
        raise ValueError("a class has too few rows")
    r = ranks(df, rng.bits(seed, F.col(key)), [key], [label])
    last = F.lit(True) if test is None else F.col("__r") <= train + val + test
    split = F.when(F.col("__r") <= train, "train").when(F.col("__r") <= train + val, "val").when(last, "test")
    return r.withColumn("split", split).where("split IS NOT NULL").drop("__r")


def label_index(df: DataFrame, label: str) -> DataFrame:
    """label, idx: labels in order, from 0."""
    return df.select(label).distinct().withColumn("idx", (F.dense_rank().over(W.orderBy(label)) - 1).cast("int"))


#: Splits by name; register_split adds one.
SPLITS = {"train_test": train_test, "train_val_test": train_val_test, "n_per_class": n_per_class}


def register_split(name: str):
    """Decorator: a split f(rows, key, ..., seed) by name; a name is taken once."""

    def add(f):
        if name in SPLITS:
            raise ValueError(f"split {name!r} is registered already")
        SPLITS[name] = f
        return f

    return add
