"""Session histories of one key on stand-ins for the state store."""

import pandas as pd

from gridair.streaming.sessions import History


class State:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held if self.held is not None else []

    def exists(self):
        return self.held is not None

    def put(self, rows):
        self.held = list(rows)
    update = put

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, *_):
        return State()
    getValueState = getListState

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.add(at)


def test_a_key_gives_one_frame_however_many_sessions_end():
    h = History(3, 3_600_000, False)
    h.init(Handle())
    hours = lambda *at: pd.DataFrame({"ts": [pd.Timestamp("2024-01-01") + pd.Timedelta(hours=x) for x in at], "turn": [int(10 * x) for x in at]})
    first = list(h.handleInputRows((7,), iter([hours(0, 0.1, 0.2, 0.3, 5), hours(9, 9.5)]), None))
    assert len(first) == 1
    rows = first[0].values.tolist()
    at = lambda x: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=x)
    assert rows == [[7, 4, 3, 1, 3, at(0.3), True], [7, 1, 1, 50, 50, at(5), True], [7, 2, 2, 90, 95, at(9.5), False]]
    second = list(h.handleInputRows((7,), iter([hours(9.5, 10)]), None))  # the first of them is known
    assert [f.values.tolist() for f in second] == [[[7, 3, 3, 90, 100, at(10), False]]]
    assert h.handle.timers == {int(at(11).timestamp() * 1000)}
    assert [f.values.tolist() for f in h.handleExpiredTimer((7,), None, None)] == [[[7, 3, 3, 90, 100, at(10), True]]]
    assert not list(h.handleExpiredTimer((7,), None, None))
