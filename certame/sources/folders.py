"""Folders of any file system that Spark reads, listed, moved and deleted by the driver; files' contents never pass through it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def files(spark: SparkSession, path: str) -> list[str]:
    """Full paths of the files in a folder and below, sorted; none if it isn't there."""
    fs, where = _at(spark, path)
    out = []
    if fs.exists(where):
        found = fs.listFiles(where, True)
        while found.hasNext():
            out.append(found.next().getPath().toString())
    return sorted(out)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames, with the folders above made; fails if the new name is taken or the old one missing."""
    fs, where = _at(spark, old)
    to = _at(spark, new)[1]
    fs.mkdirs(to.getParent())
    if fs.exists(to) or not fs.rename(where, to):
        raise OSError(f"cannot move {old} to {new}")
