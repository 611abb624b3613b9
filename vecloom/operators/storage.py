"""Lineage cuts and model storage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back, so that its plan ends there. It goes with the step that made it
    (settled()), at the session's end otherwise."""
    return written(df, "cut")


def _folder(spark) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(_folder, "own"):
        _folder.own = f"file://{tempfile.mkdtemp(prefix='vecloom-')}"
    return _folder.own


#: What the shuffles of a table that is being written leave goes once it is written.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _freeing(spark):
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


#: Lists that get the tables made while they are open.
_collectors: list[list[DataFrame]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back; drop() removes it. It goes at the session's end too."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/vecloom-{label}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    with _freeing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vecloom_path = path
    for made in _collectors:
        made.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables of written() and cut_lineage()."""
    for df in tables:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._vecloom_path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(make, label: str = "settled") -> DataFrame:
    """make() as a written table; all other tables that it made go."""
    made: list[DataFrame] = []
    _collectors.append(made)
    try:
        out = written(make(), label)
    finally:
        _collectors[:] = [x for x in _collectors if x is not made]
    drop(*(t for t in made if t is not out))
    return out


def _path(path: str):
    """A path and its file system, the one that Spark's readers and writers take for it."""
    spark = SparkSession.builder.getOrCreate()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(path: str) -> bool:
    p, fs = _path(path)
    return fs.exists(p)


def make_folder(path: str) -> None:
    p, fs = _path(path)
    fs.mkdirs(p)


def write_text(path: str, content: str) -> None:
    """A small file, replaced if it is there."""
    p, fs = _path(path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()


def ship(spark):
    """Let Python workers that see this folder import the package; elsewhere submit it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark


def save_embeddings(embeddings: DataFrame, folder: str, epoch: int, step: int) -> None:
    """A checkpoint of the epoch, and the last one."""
    embeddings.write.mode("overwrite").parquet(f"{folder}/checkpoint_{epoch:06d}_{step:09d}")
    embeddings.write.mode("overwrite").parquet(f"{folder}/last")


def load_embeddings(spark, folder: str, name: str = "last") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")
