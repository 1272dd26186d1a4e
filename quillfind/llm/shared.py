"""The folder that driver and executors share, and file access to it from Python workers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut at either bound, so a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20
#: Keys that a join by broadcast takes at most.
HOT_KEYS = 50_000


def session(df: DataFrame) -> SparkSession:
    """The DataFrame's session, with the Arrow batch bounds set and a checkpoint folder present."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    shared_root(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where the setting is absent, a local session (tests) gets one of its own;
    on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillfind-")
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """URI of a new, not yet existing folder below the shared one."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    uri = fresh_folder(spark, kind)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, total: int | None = None) -> DataFrame:
    """Inner join where `right` has one row per key and says in `count` how many rows of `left` have it. Keys with more
    than a HOT_KEYS-th of all rows, so fewer than HOT_KEYS, are broadcast: their rows stay where they are. The others'
    rows, none of which is many, are shuffled. `left` is read twice; `right` is stored unless `total`, the number of
    rows that its counts sum up to, is given."""
    if total is None:
        right = stored(right, "join-keys")
        total = right.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot = F.col(count) > max(total // HOT_KEYS, 1000)
    return left.join(F.broadcast(right.filter(hot).drop(count)), key).unionByName(left.join(right.filter(~hot).drop(count).hint("merge"), key))


def without_hot(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """The rows of `left` whose key is null or not in `right`; sides and hot keys as in join_hot."""
    total = right.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot = F.col(count) > max(total // HOT_KEYS, 1000)
    return left.join(F.broadcast(right.filter(hot).select(key)), key, "left_anti").join(right.filter(~hot).select(key).hint("merge"), key, "left_anti")


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the files of shuffles that nothing refers to any more: they lie beside what is stored."""
    gc.collect()
    spark._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def filesystem(uri: str):
    """(pyarrow filesystem, path) for any scheme that pyarrow can open; plain paths are local."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_file(uri: str, parts: Iterable[bytes]) -> None:
    """Write whole or not at all: a repeated or speculative task replaces the file by an equal one."""
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    half = f"{path}.{uuid.uuid4().hex}.half"
    with system.open_output_stream(half) as out:
        for part in parts:
            out.write(part)
    system.move(half, path)


def map_file(uri: str, dtype):
    """A file as a read-only numpy array: memory-mapped in place where the store is mounted, else through an
    unnamed scratch file that vanishes with the worker."""
    import numpy as np
    from pyarrow import fs

    system, path = filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    size = system.get_file_info(path).size
    if not size:
        return np.zeros(0, dtype)
    scratch = tempfile.TemporaryFile()
    with system.open_input_stream(path) as src:
        while block := src.read(8 << 20):
            scratch.write(block)
    scratch.flush()
    return np.memmap(scratch, dtype=dtype, mode="r")
