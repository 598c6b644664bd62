"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from certame.sources import folders

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one on one machine, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="certame-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet. What is written there goes when the driver exits."""
    path = f"{shared_dir(spark)}/certame/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Writes rows as Parquet and reads them back: what follows sees the same rows whatever happens to an executor."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows over spark.sql.shuffle.partitions tasks, by key or in turn: ahead of work that takes long for each row, since a file that is small may hold many rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


@contextmanager
def temporary() -> Iterator[None]:
    """Within it, tables may be staged; they go at its end, so results are to be written or collected inside. For sessions that run long."""
    before = len(_made)
    try:
        yield
    finally:
        own = _made[before:]
        del _made[before:]
        for spark, path in own:
            folders.delete(spark, path)


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            folders.delete(spark, path)
        except Exception:  # the session has ended
            return
