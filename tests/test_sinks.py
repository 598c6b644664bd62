"""Merges that leave other partitions alone, and JSON arrays that are complete or not there."""

from __future__ import annotations

import json
import subprocess
import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest

from certame.sources import files, folders, json_arrays, sinks

BANK = "id long, fonte string, tipo string, ano int, turno string, texto string, nota double"
ROWS = [(k, "ENEM" if k % 2 else "U/F T", "PROVA", None if k % 5 == 0 else 2000 + k % 3, None, f"t{k}", 1.0) for k in range(60)]


def parts(spark, path):
    found = {}
    for f in folders.files(spark, path):
        if f.endswith(".parquet"):
            found.setdefault(f.rsplit("/", 1)[0], set()).add(f.rsplit("/", 1)[1])
    return found


@pytest.fixture
def bank(spark, tmp_path):
    path = str(tmp_path / "bank")
    sinks.write_table(spark.createDataFrame(ROWS, BANK), path)
    return path


def read(spark, path):
    return {r.id: (r.fonte, r.tipo, r.ano, r.turno, r.texto, r.nota) for r in spark.read.parquet(path).collect()}


def test_merge_writes_what_it_touches(spark, bank):
    before, want = parts(spark, bank), {r[0]: r[1:] for r in ROWS}
    new = [(1, "ENEM", "PROVA", 2001, None, "changed", 2.0), (10, "U/F T", "PROVA", None, None, "changed too", 2.0), (100, "ENEM", "PROVA", 2001, None, "new", None)]
    sinks.merge_table(spark.createDataFrame(new, BANK), bank, ("id",))
    assert read(spark, bank) == want | {r[0]: r[1:] for r in new}
    after = parts(spark, bank)
    changed = {p for p in before if before[p] != after[p]}
    assert len(before) == len(after) == 8 and len(changed) == 2


def test_merge_moves_rows(spark, bank):
    """To another partition, to one that is new, and out of one that is empty then."""
    want = {r[0]: r[1:] for r in ROWS}
    new = [(r[0], "EXATO", "SIMULADO", 2030, "a=b c", r[5], 3.0) for r in ROWS if r[1] == "ENEM" and r[3] is None] + [(2, "ENEM", "PROVA", 2000, None, "moved", 3.0)]
    sinks.merge_table(spark.createDataFrame(new, BANK), bank, ("id",))
    assert read(spark, bank) == want | {r[0]: r[1:] for r in new}
    assert sum("fonte=EXATO" in p for p in parts(spark, bank)) == 1 and not any("fonte=ENEM" in p and "ano=__HIVE" in p for p in parts(spark, bank))


def test_merge_again(spark, bank, monkeypatch):
    """A merge that dies before it has cleared what moved away leaves rows twice; the next run puts that right. A key that comes twice is refused."""
    want = {r[0]: r[1:] for r in ROWS}
    new = [(r[0], "EXATO", "SIMULADO", 2030, None, r[5], 3.0) for r in ROWS if r[1] == "ENEM" and r[3] is None]
    rows = spark.createDataFrame(new, BANK)
    with monkeypatch.context() as patch:
        patch.setattr(sinks.folders, "delete", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.merge_table(rows, bank, ("id",))
    assert spark.read.parquet(bank).count() == 60 + len(new)
    for _ in range(2):
        sinks.merge_table(rows, bank, ("id",))
        assert spark.read.parquet(bank).count() == 60 and read(spark, bank) == want | {r[0]: r[1:] for r in new}
    with pytest.raises(ValueError, match="twice"):
        sinks.merge_table(rows.union(rows), bank, ("id",))


def test_merge_of_some_columns(spark, bank):
    before = parts(spark, bank)
    sinks.merge_table(spark.createDataFrame([(3, 9.5)], "id long, nota double"), bank, ("id",))
    assert read(spark, bank)[3] == (*ROWS[3][1:6], 9.5) and len(read(spark, bank)) == 60
    assert sum(before[p] != v for p, v in parts(spark, bank).items()) == 1
    sinks.merge_table(spark.createDataFrame([], BANK), bank, ("id",))
    assert len(read(spark, bank)) == 60


def test_json_arrays_by_unit(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(k, "é" * k, 2000 + k % 3, Decimal("1.5"), date(2024, 1, 2)) for k in range(9)], "numero int, comando string, ano int, d decimal(3,1), dia date").drop("d", "dia")
    for _ in range(2):
        sinks.write_json_arrays(rows.coalesce(1), path, unit=("ano",))
    assert sorted(p.name for p in Path(path).iterdir() if p.suffix == ".json") == ["2000.json", "2001.json", "2002.json"]
    text = Path(path, "2001.json").read_text(encoding="utf-8")
    assert [r["numero"] for r in json.loads(text)] == [1, 4, 7] and "éééé" in text and text.startswith("[\n{\n  ")
    assert sorted(r.numero for r in files.read_json_strict(spark, f"{path}/*.json").collect()) == list(range(9))
    sinks.write_json_arrays(rows.where("ano = 2000"), path, unit=("ano",))
    assert sorted(p.name for p in Path(path).iterdir()) == ["2000.json", "_SUCCESS"]
    sinks.write_json_arrays(rows.where("ano = 2001"), path, unit=("ano",), mode="append")
    assert len(files.read_json_strict(spark, f"{path}/*.json").collect()) == 6


def test_json_arrays_set_bad_rows_aside(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(k, float("nan") if k == 4 else 0.5, None if k == 7 else "x", Decimal("2.50"), date(2024, 5, 6), b"z" if k == 9 else None) for k in range(23)], "id int, v double, nome string, preco decimal(5,2), dia date, raw binary").coalesce(1)
    sinks.write_json_arrays(rows, path, required=("nome",), rows_per_file=10)
    arrays = [json.loads(p.read_text()) for p in sorted(Path(path).glob("*.json"))]
    assert [len(a) for a in arrays] == [10, 10]
    assert [r["id"] for a in arrays for r in a] == [k for k in range(23) if k not in (4, 7, 9)] and arrays[0][0]["preco"] == "2.50" and arrays[0][0]["dia"] == "2024-05-06"
    aside = [json.loads(x) for p in Path(path, "_rejected").glob("*.json") for x in p.read_text().splitlines()]
    assert len(aside) == 3 and {a["erro"] for a in aside} >= {"nome missing"}


def test_json_arrays_whose_driver_dies(spark, tmp_path, monkeypatch):
    """While names move the table is marked as not whole; writing it again makes it so."""
    path = str(tmp_path / "out")
    rows = spark.range(40).repartition(4)
    sinks.write_json_arrays(rows, path)
    writer = json_arrays.ArrayWriter({"path": path}, True)
    with pytest.raises(FileNotFoundError):
        writer.commit([json_arrays.Written([(f"{path}/_pending/gone", "part-00000.json")])])
    assert not (tmp_path / "out" / "_SUCCESS").exists()
    sinks.write_json_arrays(rows, path)
    assert (tmp_path / "out" / "_SUCCESS").exists() and sorted(r["id"] for p in Path(path).glob("*.json") for r in json.loads(p.read_text())) == list(range(40))


def test_json_arrays_of_nothing(spark, tmp_path):
    sinks.write_json_arrays(spark.createDataFrame([], "a int"), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["_SUCCESS"]


RETRY = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from certame.sources import sinks
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
always = sys.argv[2] == "always"

def dies(frames):
    for n, f in enumerate(frames):
        for k in range(len(f)):
            if k == 30 and TaskContext.get().partitionId() == 0 and (always or TaskContext.get().attemptNumber() == 0):
                os._exit(1)  # the worker is killed while its file is open
            yield f.iloc[k : k + 1]

rows = spark.range(100).repartition(2).mapInPandas(dies, "id long")
sinks.write_json_arrays(rows, sys.argv[1], rows_per_file=7)
"""


@pytest.mark.parametrize("mode", ["once", "always"])
def test_a_task_that_is_killed(tmp_path, mode):
    (tmp_path / "job.py").write_text(RETRY)
    out = tmp_path / "out"
    out.mkdir()
    (out / "old.json").write_text("[]")
    ran = subprocess.run([sys.executable, str(tmp_path / "job.py"), str(out), mode], env={**__import__("os").environ, "PYTHONPATH": str(Path(__file__).parent.parent)}, capture_output=True, text=True, timeout=240)
    assert not (out / "_pending").exists()
    if mode == "once":
        assert ran.returncode == 0, ran.stderr[-2000:]
        assert sorted(r["id"] for p in out.glob("*.json") for r in json.loads(p.read_text())) == list(range(100))
    else:
        assert ran.returncode and [p.name for p in out.iterdir()] == ["old.json"]
