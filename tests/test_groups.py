"""A group of keys in one call of a processor, with a state store in memory."""

import pandas as pd

from quire.streaming.streams import Expiry, Limit


class Cell:
    def __init__(self):
        self.rows = []

    def get(self):
        return list(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def clear(self):
        self.rows = []


class Value(Cell):
    def exists(self):
        return self.rows != []

    def get(self):
        return self.rows

    def update(self, value):
        self.rows = value


class Handle:
    def __init__(self):
        self.timers, self.now = [], 0

    def getListState(self, *_):  # noqa: N802
        return Cell()

    def getValueState(self, *_):  # noqa: N802
        return Value()

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def played(processor, names, rows, now):
    handle = Handle()
    processor.init(handle)
    assert list(processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=names)]), handle)) == []
    assert len(handle.timers) == 1  # one for the group, however many keys
    handle.now = now
    return [tuple(r) for pdf in processor.handleExpiredTimer((0,), handle, None) for r in pdf.itertuples(index=False)], handle


def test_limits_of_two_users():
    rows = [(2, 3000, 9), (1, 1000, 1), (2, 2000, 2), (1, 9_000_000, 5)]
    got, handle = played(Limit("long", 1, 3_600_000_000), ["key", "micros", "seq"], rows, 5)
    assert [(*r[:3], bool(r[3]), r[4]) for r in got] == [(1, 1000, 1, True, 1), (2, 2000, 2, True, 1), (2, 3000, 9, False, 1)]
    assert handle.timers == [1, 9000]


def test_shares_end_apart():
    got, _ = played(Expiry("string"), ["key", "micros", "seq", "end"], [("a", 1000, 0, 3000), ("b", 1000, 0, 90_000), ("a", 2000, 0, 4000)], 10)
    assert got == [("a", 4000)]
