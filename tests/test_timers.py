"""What a mock's timers ask of the state store."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Row

from certame.streaming import answers

START = datetime(2024, 1, 1, 10, 0, tzinfo=timezone.utc)


class Store:
    """A state of one value and its timers; notes each call."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, *_):
        return self

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "clear", "listTimers", "registerTimer", "deleteTimer"):
            self.calls.append(name)
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_few_calls_for_a_mock():
    """Each call is a trip through a socket: one to read, and others for what changes alone."""
    store, mock = Store(), answers.Countdown()
    mock.init(store)
    end = int((START + timedelta(minutes=6)).timestamp() * 1000)
    rows = lambda *minutes, more=0: iter([Row(simulado_id=1, ts=START + timedelta(minutes=m), fim_ms=end + more) for m in minutes])

    def calls(it):
        store.calls.clear()
        assert list(mock.handleInputRows((1,), it, store)) == []
        return list(store.calls)

    assert calls(rows(3 * 24 * 60)) == ["get"] and store.value is None and not store.timers  # too old to open a state
    assert calls(rows(1, 2, 6, 7)) == ["get", "registerTimer", "update"]
    assert store.value == (3, end, False) and store.timers == {end}
    assert calls(rows(3, 4)) == ["get", "update"] and store.value == (5, end, False)
    assert calls(rows(7, 8)) == ["get"] and store.timers == {end}
    assert calls(rows(8, more=180_000)) == ["get", "listTimers", "deleteTimer", "registerTimer", "update"]
    assert store.value == (6, end + 180_000, False) and store.timers == {end + 180_000}
    (row,) = mock.handleExpiredTimer((1,), store, None)
    assert row.asDict() == {"simulado_id": 1, "respostas": 6, "expirou": True}
    assert calls(rows(*[5] * (answers.CHUNK + 1))) == ["get"] and store.value == (6, end + 180_000, True)
