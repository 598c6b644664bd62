"""Tables of a remote database: searched with filters, order, limit and counts pushed down, or read whole by many tasks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = ("url", "user", "password")
CATALOG = "remoto"
#: Databases that take a limit with a pushed order. Others (Derby among them) would give all rows where Spark counts on the first few.
TAKE_LIMITS = ("jdbc:postgresql:", "jdbc:mysql:", "jdbc:mariadb:")


def settings(spark: SparkSession) -> dict[str, str]:
    """Address and credentials, from spark.certame.jdbc.* alone (driver and schema may be named too); says what is missing."""
    found = {k: spark.conf.get(f"spark.certame.jdbc.{k}", None) for k in (*SETTINGS, "driver", "schema")}
    missing = [k for k in SETTINGS if not found[k]]
    if missing:
        raise ValueError("set " + ", ".join(f"spark.certame.jdbc.{k}" for k in missing))
    return {k: v for k, v in found.items() if v}


def attach(spark: SparkSession) -> str:
    """Makes the database a catalog of the session, whose scans take over filters and aggregates, and order and limit where it takes those; returns the prefix of its tables."""
    told = settings(spark)
    schema = told.pop("schema", None)
    spark.conf.set(f"spark.sql.catalog.{CATALOG}", "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    limits = str(told["url"].startswith(TAKE_LIMITS)).lower()
    for k, v in {**told, "pushDownAggregate": "true", "pushDownLimit": limits, "pushDownOffset": limits}.items():
        spark.conf.set(f"spark.sql.catalog.{CATALOG}.{k}", v)
    return f"{CATALOG}.{schema}" if schema else CATALOG


def table(spark: SparkSession, name: str) -> DataFrame:
    """A remote table for lookups and searches: what follows (where, order and limit, counts by group) runs there where the database can."""
    return spark.table(f"{attach(spark)}.{name}")


def whole(spark: SparkSession, name: str, by: str, tasks: int, where: Column | None = None) -> DataFrame:
    """A remote table by `tasks` tasks, each a range of the whole-numbered column `by`.

    The range's ends are asked of the database, under `where`. Rows that are null or beyond the ends, as the table grows meanwhile, come with the first and last range.
    """
    told = settings(spark)
    schema = told.pop("schema", None)
    asked = table(spark, name)
    low, high = (asked if where is None else asked.where(where)).agg(F.min(by), F.max(by)).first()
    reader = spark.read.format("jdbc").options(**told, dbtable=f"{schema}.{name}" if schema else name)
    if low is not None and low < high and tasks > 1:
        reader = reader.options(partitionColumn=by, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(tasks))
    rows = reader.load()
    return rows if where is None else rows.where(where)
