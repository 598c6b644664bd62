"""Places, neighbours and runs against plain Python: ties, nulls, groups over many ranges, edges of blocks."""

from __future__ import annotations

import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from certame.operators import exams, ranks, search
from certame.plans import questions
from certame.sources import folders, staging

ROWS = "id long, fonte string, ano int, numero int, area string, dia string, __extra int"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    areas = [*exams.fixed.AREAS, "unknown", "other", None]
    made = [(k, rnd.choices(["A", "B", None, "C"], [90, 5, 4, 1])[0], rnd.choice([None, 2010, 2011, 2012]), rnd.choice([None, 1, 2, 3]), rnd.choice(areas), "d", 0) for k in range(700)]
    rnd.shuffle(made)
    return made


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(5)


@pytest.fixture(params=[3, 1024])
def block(request, monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK", request.param)


def up(v):
    return (v is None, v or 0)


def down(v):
    return (v is not None, -(v or 0))


def first(v):
    return (v is not None, v or "")


def test_neighbours(table, rows, block):
    want = {}
    for _, own in groupby(sorted(rows, key=lambda r: (first(r[1]), up(r[2]), up(r[3]), r[0])), key=lambda r: r[1]):
        ids = [None, *[r[0] for r in own], None]
        want |= {i: (a, b) for a, i, b in zip(ids, ids[1:], ids[2:], strict=False)}
    assert {r.id: (r.anterior, r.proximo) for r in search.neighbours(table).collect()} == want


def test_places_of_equals(table, rows):
    place = lambda r: (down(r[2]), up(r[3]))
    want = {r[0]: sum(o[1] == r[1] and place(o) <= place(r) for o in rows) for r in rows}
    assert {r.id: r.posicao for r in search.list_position(table).collect()} == want


def test_layout_with_areas_that_alternate(table, rows):
    rank = lambda a: exams.fixed.AREAS.index(a) if a in exams.fixed.AREAS else -1
    want = {}
    for _, own in groupby(sorted(rows, key=lambda r: (first(r[1]), rank(r[4]), up(r[2]), up(r[3]), r[0])), key=lambda r: r[1]):
        own = list(own)
        for n, r in enumerate(own, 1):
            same = [k for k, o in enumerate(own, 1) if o[4] == r[4]]
            want[r[0]] = (n, same[0], same[-1], 1 if same.index(n) + 1 <= -(-len(same) // 2) else 2, (n - 1) // 5, (n - 1) // 10)
    got = exams.layout(table, "fonte")
    assert {r.id: (r.num, r.area_inicio, r.area_fim, r.coluna, r.linha, r.pagina) for r in got.collect()} == want


def test_runs(table, rows, block):
    want = []
    for fonte, own in groupby(sorted(rows, key=lambda r: (first(r[1]), up(r[3]), r[0])), key=lambda r: r[1]):
        n = 1
        for grupo, (area, run) in enumerate(groupby(own, key=lambda r: r[4]), 1):
            size = len(list(run))
            want.append((fonte, grupo, area, n, n + size - 1))
            n += size
    got = exams.islands(table, "fonte", [F.col("numero").asc_nulls_last(), F.col("id").asc()], "area")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_file_order(table, rows):
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (up(r[3]), r[0])), 1)}
    assert {r.id: r.lugar for r in search.file_order(table, "d").collect()} == want
    assert search.file_order(table, "none").collect() == []


def test_nothing(spark):
    empty = spark.createDataFrame([], ROWS)
    for df in (search.neighbours(empty), search.list_position(empty), exams.layout(empty, "fonte"), exams.islands(empty, "fonte", [F.col("id").asc()], "area")):
        assert df.collect() == []


def test_staged_tables_go(spark, table):
    at = f"{staging.shared_dir(spark)}/certame"
    before = folders.names(spark, at)
    with staging.temporary():
        assert search.neighbours(table).count() == 700
        assert len(folders.names(spark, at)) > len(before)
    assert folders.names(spark, at) == before


@pytest.mark.parametrize("name", ["neighbours", "list_position", "print_layout", "area_islands", "file_order", "spread_pages"])
def test_no_window_over_a_group(spark, sf_dir, name):
    plan = getattr(questions, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[.*?windowspecdefinition\((\w+)#", plan)
    assert set(windows) <= {"__block"}
