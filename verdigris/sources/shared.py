"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint directory. Only a session on one machine that has none (tests) gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named is None and current.isDefined():
        named = current.get()
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="verdigris-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read back: what several branches of a plan need is computed once.

    The table outlives lost executors, cuts lineage, and keeps column pruning. With `by` it has a folder for each value of
    that column, and filters on it read only theirs; adaptive execution splits large folders and joins small ones.
    """
    path = f"{shared_dir(df.sparkSession)}/verdigris/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance", by).write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    """A path's file system and name, whatever store it is in."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def file_names(spark: SparkSession, folder: str) -> list[str]:
    fs, name = _file(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(name)) if fs.exists(name) else []


def read_file(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, name = _file(spark, path)
    stream = fs.open(name)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_file_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small text file under a name that nothing has yet; False if there is one. Readers see the whole file or none."""
    fs, name = _file(spark, path)
    if fs.exists(name):
        return False
    draft = _file(spark, f"{path}.{uuid.uuid4().hex}.draft")[1]
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.mkdirs(name.getParent())
    if fs.rename(draft, name):
        return True
    fs.delete(draft, False)
    return False


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, name = _file(spark, path)
    fs.delete(name, True)
