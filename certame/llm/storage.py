"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
#: Rows of an Arrow batch at most, where the session has Spark's own default: texts are long, and a batch stands in the JVM and in Python at once.
BATCH_ROWS = 1000
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a Parquet reader decodes at a time, where the session has Spark's own default: 4,096 long texts stand in one array, which doubles as it fills.
READ_ROWS = 512
READ = "spark.sql.parquet.columnarReaderBatchSize"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Sets the session's Arrow batches to `rows` rows and those of Parquet readers to READ_ROWS, unless someone has set them."""
    if spark.conf.get(RECORDS) == "10000":
        spark.conf.set(RECORDS, rows)
    if spark.conf.get(READ) == "4096":
        spark.conf.set(READ, READ_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one on one machine (tests), and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        at = spark.sparkContext.getCheckpointDir()
        if at is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="certame-"))
            at = spark.sparkContext.getCheckpointDir()
        named = at
    return named.rstrip("/")


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove() -> None:
    for path, spark in _made.items():
        try:
            _delete(path, spark)
        except Exception:  # the session has ended; the folder's own cleaning takes over
            return


def keep_until_exit(spark: SparkSession, path: str) -> str:
    """Notes a folder that goes when the driver exits."""
    _made[path] = spark
    return path


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables from staged() that no later step reads."""
    for df in tables:
        files = df.inputFiles()
        for path in [p for p in _made if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files[:1])]:
            _delete(path, _made.pop(path))


atexit.register(_remove)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage, survives the loss of executors, and gives the
    optimiser exact sizes for its choice of joins. The files go when the driver exits.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/certame/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(keep_until_exit(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that are no longer referenced.

    The event of the last query keeps its plan until another one follows, so a small query goes first.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of df whose key is not in ids (one column of that name).

    ids are written first, so that Spark knows their size and broadcasts them only below its threshold.
    """
    return df.join(staged(ids.distinct(), "ids"), key, "left_anti")
