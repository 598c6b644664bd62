"""Answer events as a stream: the latest state of each answer, and mocks that run out of time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from certame import fixed
from certame.operators.changes import latest_per_key
from certame.sources import folders


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files as they come."""
    return spark.readStream.schema(schema).parquet(folder)


#: Folders of a state table that wait for the next merge.
LIVE_FOLDERS = 8


class StateTable:
    """T4: a table of the last row of each key, fed batch by batch, with a bounded number of folders.

    Each batch writes its keys as one folder. A manifest of the batch names the folders that make up the table; it counts once it is complete. When more than
    `live` folders would be named, they are merged into one, a row a key. Folders that neither this manifest nor the one before
    names are deleted, so a reader has a batch's time to finish, and a batch that runs again (after a failure at any point) finds what it read and leaves the same.
    """

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...], order: list[str], live: int = LIVE_FOLDERS):
        self.spark, self.path, self.key, self.order, self.live = spark, path.rstrip("/"), key, order, live

    def _manifests(self) -> list[int]:
        return sorted(int(n) for n in folders.names(self.spark, f"{self.path}/_manifests") if n.isdigit() and folders.exists(self.spark, f"{self.path}/_manifests/{n}/_SUCCESS"))

    def _named(self, version: int) -> list[str]:
        """Folders of a manifest: a short list."""
        return [r.value for r in self.spark.read.text(f"{self.path}/_manifests/{version}").orderBy("value").collect()]

    def folders(self, before: int | None = None) -> list[str]:
        """What makes up the table, as of the last batch (before a given one)."""
        versions = [v for v in self._manifests() if before is None or v < before]
        return self._named(versions[-1]) if versions else []

    def put(self, batch: DataFrame, number: int) -> None:
        """Takes a batch in, once however often it runs."""
        then = self.folders(number)
        own = f"lote={number:012d}"
        latest_per_key(batch, self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/{own}")
        now = [*then, own]
        if len(now) > self.live:
            merged = f"base={number:012d}"
            latest_per_key(self._read(now), self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/{merged}")
            now = [merged]
        self.spark.createDataFrame([(n,) for n in now], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_manifests/{number}")
        for name in folders.names(self.spark, self.path):
            if name.startswith(("lote=", "base=")) and name not in (*then, *now):
                folders.delete(self.spark, f"{self.path}/{name}")
        for version in self._manifests()[:-2]:
            folders.delete(self.spark, f"{self.path}/_manifests/{version}")

    def _read(self, names: list[str]) -> DataFrame:
        first, *rest = [self.spark.read.parquet(f"{self.path}/{n}") for n in names]
        for more in rest:
            first = first.unionByName(more, allowMissingColumns=True)
        return first

    def current(self) -> DataFrame:
        """The last row of each key; fails before the first batch."""
        return latest_per_key(self._read(self.folders()), self.key, self.order)


def latest_answers(events: DataFrame, key: tuple[str, ...], order: list[str], path: str, checkpoint: str, late: str = "10 minutes", live: int = LIVE_FOLDERS):
    """T4: keeps a StateTable of the last event of each key; repeated events within the watermark are dropped."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    table = StateTable(events.sparkSession, path, key, order, live)
    return once.writeStream.foreachBatch(table.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: tuple[str, ...], order: list[str]) -> DataFrame:
    return StateTable(spark, path, key, order).current()


EXPIRED = "simulado_id long, respostas long, expirou boolean"
#: Event time after a mock's end for which it is remembered that its row went out.
REMEMBER_MS = 24 * 3_600_000
#: Answers of a mock that stand in memory at once.
CHUNK = 10_000
EPOCH, MILLISECOND = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(milliseconds=1)


class Countdown(StatefulProcessor):
    """Counts a mock's answers until its end by event time; then its one row goes out, and a tombstone stays for REMEMBER_MS.

    The first timer stands at the mock's end, the second one REMEMBER_MS later, where the tombstone goes. Events that old
    open no state, so a mock whose tombstone is gone gives no second row. Mocks are many and small: rows come as they are, as a frame for each mock
    costs more than its answers, and the store, which each call reaches by a socket, is asked once and told only what changed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mock = handle.getValueState("mock", "respostas long, fim long, saiu boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.mock.get()
        n, before, out = state or (0, None, False)
        end, known = before, state is not None
        while chunk := list(islice(rows, CHUNK)):
            if out:
                continue
            last = max(ends for _, _, ends in chunk)
            end = last if end is None else max(end, last)
            times = [at for _, ts, _ in chunk if (at := (ts - EPOCH) // MILLISECOND) <= end + REMEMBER_MS]
            known = known or bool(times)
            n += sum(at <= end for at in times)
        if known and not out:
            if end != before:  # the timer of a mock whose end stays stands already, and one without state has none
                for t in list(self.handle.listTimers()) if state else ():
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
            if (n, end, False) != state:
                self.mock.update((n, end, False))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, end, out = self.mock.get()
        if out:
            self.mock.clear()
            return
        self.mock.update((n, end, True))
        self.handle.registerTimer(max(end + REMEMBER_MS, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(simulado_id=key[0], respostas=n, expirou=True)

    def close(self) -> None:
        pass


def timeouts(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Events (simulado_id, ts, iniciado_em, total_questoes) to one row for each mock whose time has run out.

    A mock ends three minutes a question after its start (the latest end that its events tell). All events move the watermark, those after
    a mock's end too; they are not counted. Events later than the watermark are left out by Spark. Rows without a mock, a time or an end tell nothing.
    Its state needs the RocksDB state store: start the query within timers().
    """
    end = (F.unix_millis("iniciado_em") + F.col("total_questoes") * (fixed.MINUTES_PER_QUESTION * 60_000)).cast("long")
    timed = events.withWatermark("ts", late).withColumn("fim_ms", end)
    # three columns: each value of a row is handed to Python by itself
    known = timed.where("simulado_id is not null and ts is not null and fim_ms is not null").select("simulado_id", "ts", "fim_ms")
    return known.groupBy("simulado_id").transformWithState(Countdown(), EXPIRED, "Append", "EventTime")


STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """A session whose queries, started within, keep state in RocksDB; the session's own store is back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
