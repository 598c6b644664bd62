"""Sinks: partitioned tables and merges into them, JSON exports, batches with quarantine, object tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certame.operators.changes import upsert
from certame.schemas import LOCAL_ONLY
from certame.sources import folders
from certame.sources.json_arrays import JsonArrays
from certame.sources.staging import staged

UNIT = ("fonte", "tipo", "ano", "turno")


def write_table(rows: DataFrame, path: str, by: tuple[str, ...] = UNIT, mode: str = "overwrite") -> None:
    """One folder for each unit; rows meet by unit, and a large unit keeps several tasks."""
    rows.drop(*LOCAL_ONLY).repartition(*by, F.pmod(F.xxhash64("id"), F.lit(8)) if "id" in rows.columns else F.lit(0)).sortWithinPartitions(*by).write.mode(mode).partitionBy(*by).parquet(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with null fields left out."""
    rows.write.mode(mode).json(path)


def write_json_arrays(rows: DataFrame, path: str, unit: tuple[str, ...] = (), required: tuple[str, ...] = (), rows_per_file: int = 0, spread: int = 1, mode: str = "overwrite") -> None:
    """K1, K2, K4: files that hold one JSON array each, named by unit, or by task without one.

    rows_per_file cuts files; a unit in `spread` tasks gives as many files at least. Rows without a required column, and such that JSON can't
    express, are set aside in _rejected. Nothing shows before all tasks have ended, and a task that runs again leaves nothing twice.
    """
    spark = rows.sparkSession
    spark.dataSource.register(JsonArrays)
    rows = rows.drop(*LOCAL_ONLY)
    if unit:
        dealt = [F.pmod(F.xxhash64(*rows.columns), F.lit(spread))] if spread > 1 else []
        rows = rows.repartition(*unit, *dealt).sortWithinPartitions(*unit)
    options = {"path": path, "unit": ",".join(unit), "required": ",".join(required), "rows_per_file": str(rows_per_file), "numbered": str(spread > 1).lower()}
    rows.write.format("json_arrays").options(**options).mode(mode).save()


def _partitions(spark: SparkSession, path: str, by: tuple[str, ...]) -> dict[tuple[str | None, ...], str]:
    """Folders of a partitioned table by their values as text."""
    out = {}
    for file in folders.files(spark, path):
        parts = file.split("/")[:-1]
        named = parts[-len(by) :]
        if all(p.startswith(f"{c}=") for p, c in zip(named, by, strict=True)):
            values = tuple(unquote(p.split("=", 1)[1]) for p in named)
            out[tuple(None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in values)] = "/".join(parts)
    return out


def merge_table(new: DataFrame, path: str, key: tuple[str, ...], by: tuple[str, ...] = UNIT) -> None:
    """M1, K3, K8: upsert() into a table partitioned by `by`, of which only the partitions that change are written anew.

    Those are where rows of new's keys stand now, found by reading keys alone, and where they go. Rows may move to another partition; one
    that loses all its rows goes. new has a row for each key (latest_per_key(); an error otherwise); columns that it lacks stay. What is written is complete before any
    partition is replaced; a merge that dies between two partitions is completed by running it again. One writer at a time.
    """
    spark = new.sparkSession
    table = spark.read.parquet(path)
    kinds = {c: "string" for c, kind in table.dtypes if kind == "void"} | dict(new.dtypes)  # a partition column of nulls alone has no type
    old = table.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in table.columns])
    new = staged(new, "merge")
    if not new.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"a key comes twice: {', '.join(key)}")
    asked = new.select(*[F.col(c).alias(f"__k_{c}") for c in key]).distinct()
    held = old.select(*dict.fromkeys([*key, *by])).join(asked, [old[c].eqNullSafe(asked[f"__k_{c}"]) for c in key], "left_semi").select(*by)
    if set(by) <= set(new.columns):
        held = held.unionByName(new.select(*by))
    touched = held.distinct().collect()  # a row for each folder at most
    if not touched:
        return
    hit = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in by]) for r in touched])
    there = old.where(hit)
    same = [there[c].eqNullSafe(asked[f"__k_{c}"]) for c in key]
    # a merge that died may have left a key in two partitions
    changed = upsert(there.join(asked, same, "left_semi").dropDuplicates(list(key)), new, key)
    after = staged(there.join(asked, same, "left_anti").unionByName(changed), "merged")
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    text = [F.col(c).cast("string").alias(c) for c in by]
    left = {tuple(r) for r in after.select(*text).distinct().collect()}
    at = _partitions(spark, path, by)
    for r in touched:
        values = tuple(None if v is None else str(v) for v in r)
        if values not in left and values in at:
            folders.delete(spark, at[values])


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes beside the table, then swaps: a table is never overwritten while it is read."""
    spark = rows.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    if folders.exists(spark, path):
        folders.move(spark, path, old)
    folders.move(spark, fresh, path)
    folders.delete(spark, old)


SENT = "chave string, ok boolean, erro string"


def send(rows: DataFrame, key: str, open_sink: Callable[[], Callable[[list[dict]], None]], batch: int = 50, dry_run: bool = False) -> DataFrame:
    """K4: sends rows in batches; where one fails its rows go one by one, so that only bad ones are reported.

    open_sink() opens a connection in the task and returns what takes a list of rows. Returns (chave, ok, erro) for every row.
    """
    if dry_run:
        return rows.select(F.col(key).cast("string").alias("chave"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("erro"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        put = open_sink()
        for f in frames:
            records, out = f.to_dict("records"), []
            for lo in range(0, len(records), batch):
                own = records[lo : lo + batch]
                try:
                    put(own)
                    out += [(str(r[key]), True, None) for r in own]
                except Exception:
                    for r in own:
                        try:
                            put([r])
                            out.append((str(r[key]), True, None))
                        except Exception as e:
                            out.append((str(r[key]), False, str(e)))
            yield pd.DataFrame(out, columns=["chave", "ok", "erro"])

    return rows.drop(*LOCAL_ONLY).mapInPandas(run, SENT)


def put_objects(old: DataFrame, new: DataFrame, force: bool = True) -> DataFrame:
    """K5-K7: the object table (path, content) with new ones; without force, what is there stays."""
    if force:
        return old.join(new.select("path").distinct(), "path", "left_anti").unionByName(new)
    return old.unionByName(new.join(old.select("path").distinct(), "path", "left_anti"))


def public_urls(objects: DataFrame, base: str) -> DataFrame:
    """K7."""
    return objects.select("path", F.concat(F.lit(base.rstrip("/") + "/"), F.col("path")).alias("url"))
