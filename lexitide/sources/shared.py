"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexitide-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def take_parts(spark: SparkSession, folder: str, column: str, prefix: str) -> None:
    """Rename the only part of each number of a column that folder is partitioned by to `prefix.number`, some at a time,
    and delete folder. The parts are listed in one call."""
    fs, parts = filesystem(spark, f"{folder}/{column}=*/part-*")
    _, target = filesystem(spark, prefix)
    fs.mkdirs(target.getParent())
    listed, path = fs.globStatus(parts), spark._jvm.org.apache.hadoop.fs.Path

    def move(i: int) -> str:
        source = listed[i].getPath()
        to = f"{prefix}.{source.getParent().getName().partition('=')[2]}"
        if not fs.rename(source, path(to)):
            raise OSError(f"{to} could not be written")
        return to

    with ThreadPoolExecutor(8) as pool:
        made = set(pool.map(move, range(len(listed))))
    if len(made) < len(listed):
        raise ValueError("a number has several parts")
    fs.delete(filesystem(spark, folder)[1], True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = [path]
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables, and those that a result is read from, when nothing reads them any more."""
    for df in tables:
        for path in getattr(df, "_staged_at", []):
            fs, p = filesystem(df.sparkSession, path)
            fs.delete(p, True)
