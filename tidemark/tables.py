"""Tables of the engine's own: the cluster's shared folder, results that are written there, and sweeps over sorted ranges."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and all tasks run in this process, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tidemark-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths that open scratch blocks have made, the innermost block last.
_scratch: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under a folder of this application."""
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def _at(spark: SparkSession, path: str):
    """The file system of a path and the path in it, by Spark's own means."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """One small file, by the file system of the path, in place of what was there."""
    fs, at = _at(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's content, by the file system of the path."""
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    fs, at = _at(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a ``stash`` whose tables stay; every other table made inside the block is deleted at its end.

    What leaves the block must be read from the tables that stay.
    """
    _scratch.append([])
    stay: set[str] = set()

    def keep(df: DataFrame, label: str) -> DataFrame:
        out = stash(df, label)
        stay.add(_scratch[-1][-1])
        return out

    try:
        yield keep
    finally:
        for path in _scratch.pop():
            if path not in stay:
                delete(spark, path)
            elif _scratch:
                _scratch[-1].append(path)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.

    The files stay until the application's folder is removed, as later reads of the result need them, or until the
    ``scratch`` block ends that they were made in.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def range_dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ranges of ``keys`` and keep each row's partition as ``pid``, written down so that it stays put.

    The keys should tell rows apart: then a frequent leading key is split over several partitions.
    """
    n = shuffle_partitions(df.sparkSession)
    return stash(df.repartitionByRange(n, *keys).withColumn("pid", F.spark_partition_id()), "ranges")


def carried(dealt: DataFrame, **sums: Column) -> DataFrame:
    """One row per ``pid`` with, for each named sum, its total over all earlier pids (as many rows as partitions)."""
    parts = dealt.groupBy("pid").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"own_{name}") for name, c in sums.items()])
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("pid", *[F.coalesce(F.sum(f"own_{name}").over(before), F.lit(0)).alias(name) for name in sums])
