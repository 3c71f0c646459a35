"""Calls to the state store of the tallies."""

import pandas as pd

from tidewater.streaming import tally


class Store(dict):
    calls = 0

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def iterator(self):
        self.calls += 1
        return iter(self.items())

    def exists(self):
        return False


class Handle:
    def __init__(self):
        self.timers, self.stores = [], {}

    def getValueState(self, name, *schemas):
        return self.stores.setdefault(name, Store())

    getMapState = getValueState

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_new_key_asks_for_no_days():
    own, handle = tally.Tally(), Handle()
    own.init(handle)
    frame = pd.DataFrame({"ts": pd.to_datetime(["2024-01-03 00:00:09", "2024-01-01 00:00:01", "2024-01-03 00:00:05", "2024-01-03 00:00:05"]), "value": [1.25, 2.0, 0.5, 1.0]})
    (out,) = own.handleInputRows((7,), iter([frame[:2], frame[2:]]), None)
    assert out.values.tolist() == [[7, 4, 475, 172804]] and handle.stores["open"].calls == 0
    (out,) = own.handleInputRows((7,), iter([pd.DataFrame({"ts": pd.to_datetime(["2024-01-02 00:00:00", "2024-01-03 00:00:07"]), "value": [1.0, 1.0]})]), None)
    assert out.values.tolist() == [[7, 6, 675, 86405]] and len(handle.timers) == 1
