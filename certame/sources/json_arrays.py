"""A Spark data source that writes files of one JSON array each, in two phases.

A task writes beside the table, under a name of its own attempt; the driver moves the files of the attempts that count, when
all have ended. So a task that dies, runs twice or runs speculatively leaves nothing behind, and readers see all or nothing of a job.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PENDING, REJECTED = "_pending", "_rejected"


def plain(value: object) -> object:
    """What JSON has no type for, as text."""
    if isinstance(value, datetime | date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    raise TypeError(f"{type(value).__name__} has no JSON form")


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they wait, and their names in the table."""

    files: list[tuple[str, str]]


class JsonArrays(DataSource):
    """Options: path (of any file system that Arrow opens), unit and required (columns, comma-separated), rows_per_file, numbered."""

    @classmethod
    def name(cls) -> str:
        return "json_arrays"

    def schema(self) -> str:
        raise NotImplementedError("read the files with sources.files")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArrayWriter(self.options, overwrite)


class ArrayWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        columns = lambda k: [c for c in options.get(k, "").split(",") if c]
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.unit, self.required = columns("unit"), columns("required")
        self.most, self.numbered = int(options.get("rows_per_file", "0")), options.get("numbered") == "true"

    def _open(self) -> tuple[arrow_fs.FileSystem, str]:
        return arrow_fs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        """In a task: one file is open at a time, and a row in memory."""
        task = TaskContext.get()
        store, root = self._open()
        pending = f"{root}/{PENDING}/{self.job}/{task.taskAttemptId()}-{uuid.uuid4().hex}"
        store.create_dir(pending, recursive=True)
        files: list[tuple[str, str]] = []
        array = rejected = None
        unit, count, taken = None, 0, {}
        for row in rows:
            own = tuple(str(row[c]) for c in self.unit)
            try:
                missing = [c for c in self.required if row[c] is None]
                if missing:
                    raise ValueError(f"{', '.join(missing)} missing")
                text = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=plain, allow_nan=False)
            except (TypeError, ValueError) as e:
                if rejected is None:
                    rejected = self._file(store, pending, files, f"{REJECTED}/part-{task.partitionId():05d}-{self.job}.json")
                rejected.write(json.dumps({"erro": str(e), "linha": repr(row)}, ensure_ascii=False).encode() + b"\n")
                continue
            if array is None or own != unit or (self.most and count == self.most):
                if array is not None:
                    array.write(b"\n]\n")
                    array.close()
                stem = "_".join(own) if own else f"part-{task.partitionId():05d}"
                n = taken[stem] = taken.get(stem, -1) + 1
                task_mark = f"-{task.partitionId():05d}" if self.numbered else ""
                name = f"{stem}{task_mark}{f'-{n:05d}' if n or self.most else ''}{'' if self.overwrite else '-' + self.job}.json"
                array, unit, count = self._file(store, pending, files, name.replace("/", "%2F")), own, 0
                array.write(b"[\n")
            array.write((b",\n" if count else b"") + text.encode())
            count += 1
        if array is not None:
            array.write(b"\n]\n")
            array.close()
        if rejected is not None:
            rejected.close()
        return Written(files)

    def _file(self, store: arrow_fs.FileSystem, pending: str, files: list[tuple[str, str]], name: str):
        at = f"{pending}/{len(files):05d}"
        files.append((at, name))
        return store.open_output_stream(at)

    def commit(self, messages: list[Written | None]) -> None:
        """On the driver: only names move. An overwrite drops the table's other files afterwards. While names move there is no _SUCCESS, so a table whose driver died then is told from a whole one."""
        store, root = self._open()
        store.create_dir(root, recursive=True)
        if store.get_file_info(f"{root}/_SUCCESS").type == arrow_fs.FileType.File:
            store.delete_file(f"{root}/_SUCCESS")
        names = set()
        for at, name in (f for m in messages if m for f in m.files):
            if name in names:
                raise ValueError(f"two tasks wrote {name}: deal out rows by unit")
            names.add(name)
            store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
            store.move(at, f"{root}/{name}")
        if self.overwrite:
            for info in store.get_file_info(arrow_fs.FileSelector(root, recursive=True)):
                relative = info.path.removeprefix(root.rstrip("/") + "/")
                if info.is_file and relative.endswith(".json") and not relative.startswith(PENDING) and relative not in names:
                    store.delete_file(info.path)
        self._clear(store, root)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, store: arrow_fs.FileSystem, root: str) -> None:
        """What attempts left that do not count; the folder goes with the last job."""
        for own in (f"{root}/{PENDING}/{self.job}", f"{root}/{PENDING}"):
            if store.get_file_info(own).type == arrow_fs.FileType.Directory and (own.endswith(self.job) or not store.get_file_info(arrow_fs.FileSelector(own))):
                store.delete_dir(own)
