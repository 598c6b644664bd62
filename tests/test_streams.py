"""Streams: the latest answers in a table of few folders, and mocks that run out of time."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from certame.sources import folders
from certame.streaming import answers

EVENTS = "event_id long, ts timestamp, usuario_id string, questao_id long, acertou boolean"
KEY, ORDER = ("usuario_id", "questao_id"), ["ts", "event_id"]
START = datetime(2024, 1, 1, 10, 0)


def minute(n):
    return START + timedelta(minutes=n)


def test_stream_keeps_the_last_answer(spark, tmp_path):
    source, table, check = (str(tmp_path / k) for k in ("in", "table", "check"))
    first = [(1, minute(0), "u", 1, False), (1, minute(0), "u", 1, False), (2, minute(1), "u", 2, True)]
    for rows in (first, [(3, minute(2), "u", 1, True)]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        answers.latest_answers(answers.event_stream(spark, source, EVENTS), KEY, ORDER, table, check).awaitTermination()
    got = {(r.usuario_id, r.questao_id): r.acertou for r in answers.current(spark, table, KEY, ORDER).collect()}
    assert got == {("u", 1): True, ("u", 2): True}


def live(spark, table):
    return [n for n in folders.names(spark, str(table)) if n.startswith(("lote=", "base="))]


def test_state_table_keeps_few_folders(spark, tmp_path):
    table = answers.StateTable(spark, str(tmp_path), KEY, ORDER, live=3)
    want, sizes = {}, []
    for n in range(20):
        rows = [(n * 10 + k, minute(n * 10 + k), "u", (n + k) % 7, k == 1) for k in range(2)]
        batch = spark.createDataFrame(rows, EVENTS)
        table.put(batch, n)
        want |= {r[3]: r[0] for r in rows}
        sizes.append(len(live(spark, tmp_path)))
        if n % 7 == 3:
            table.put(batch, n)  # the batch runs again
            assert len(live(spark, tmp_path)) <= sizes[-1] + 1
    assert max(sizes) <= 2 * 3 + 1 and len(table.folders()) <= 3
    assert len(folders.names(spark, f"{tmp_path}/_manifests")) == 2
    assert {r.questao_id: r.event_id for r in table.current().collect()} == want


@pytest.mark.parametrize("step", ["lote", "base", "manifest"])
def test_state_table_after_a_failure(spark, tmp_path, monkeypatch, step):
    """A batch that dies after one of its steps, and runs again, leaves what one that lives does."""
    table = answers.StateTable(spark, str(tmp_path), KEY, ORDER, live=2)
    batches = [spark.createDataFrame([(n, minute(n), "u", n % 2, True)], EVENTS) for n in range(4)]
    for n in range(2):
        table.put(batches[n], n)
    before = {r.questao_id: r.event_id for r in table.current().collect()}
    with monkeypatch.context() as patch:
        if step == "lote":
            patch.setattr(table, "live", 99)
            patch.setattr(spark, "createDataFrame", lambda *a, **b: 1 / 0)
        elif step == "base":
            patch.setattr(spark, "createDataFrame", lambda *a, **b: 1 / 0)
        else:
            patch.setattr(answers.folders, "delete", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.put(batches[2], 2)
    seen = {r.questao_id: r.event_id for r in table.current().collect()}
    assert seen == (before | {0: 2} if step == "manifest" else before)
    for n in (2, 3):
        table.put(batches[n], n)
    assert {r.questao_id: r.event_id for r in table.current().collect()} == {0: 2, 1: 3}
    assert len(table.folders()) <= 2


MOCKS = "simulado_id long, ts timestamp, iniciado_em timestamp, total_questoes int"


def expired(spark, tmp_path, batches):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for own in batches:
        spark.createDataFrame(own, MOCKS).coalesce(1).write.mode("append").parquet(source)
        with answers.timers(spark):
            rows = answers.timeouts(answers.event_stream(spark, source, MOCKS))
            rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.simulado_id, r.respostas, r.expirou) for r in spark.read.schema(answers.EXPIRED).parquet(out).collect())


def test_mock_with_late_answers_alone(spark, tmp_path):
    """Only events after its end follow, and no other mock moves time."""
    own = lambda n: (1, minute(n), START, 2)
    assert expired(spark, tmp_path, [[own(1)], [own(120)], [own(180)], [own(240)]]) == [(1, 1, True)]


def test_mocks_run_out_once(spark, tmp_path):
    one, two = (lambda n: (1, minute(n), START, 2)), (lambda n: (2, minute(n), minute(119), 60))
    batches = [[one(1), one(2)], [two(120)], [two(125)], [one(126), one(3), (None, minute(126), START, 2), (3, None, START, 2), (4, minute(126), None, 2)], [two(129)], [two(400)], [one(401), two(402)], [two(2000)], [one(2001), two(2002)], [two(2100)], [one(2101)]]
    assert expired(spark, tmp_path, batches) == [(1, 2, True), (2, 3, True)]
    assert spark.conf.get(answers.STORE).endswith("HDFSBackedStateStoreProvider")


def test_mock_whose_end_moves(spark, tmp_path):
    """More questions, more time: the later end counts."""
    batches = [[(1, minute(1), START, 2)], [(1, minute(5), START, 10)], [(1, minute(20), START, 10)], [(2, minute(200), minute(190), 5)], [(2, minute(201), minute(190), 5)]]
    assert expired(spark, tmp_path, batches) == [(1, 3, True)]
