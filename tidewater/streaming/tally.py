"""Tallies of each key in state that is bounded by the delay allowed for.

Events of a key come in any order, but gaps are between neighbours in time.  So the
seconds at which something happened stay in a map, a row for each day, until the
watermark has passed the day; then a timer closes it into four numbers: number, sum,
last second and longest gap.  What a batch reports is the closed numbers
and the days still open.  Events behind the watermark are dropped by Spark, so
the map holds no more days than the delay has, and one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that holds maps and timers.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET = 86400
RESULT = "user_id long, n long, hundredths long, longest_s long"


def longest_gap(seconds: list[int], last: int | None, longest: int) -> tuple[int | None, int]:
    """The last of ``last`` and the sorted ``seconds`` after it, and the longest gap between neighbours."""
    for s in seconds:
        if last is not None:
            longest = max(longest, s - last)
        last = s
    return last, longest


class Tally(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "n long, hundredths long, last long, longest long")
        self.open = handle.getMapState("open", "day long", "n long, hundredths long, seconds array<long>")

    def _closed(self) -> tuple[int, int, int | None, int]:
        return tuple(self.closed.get()) if self.closed.exists() else (0, 0, None, 0)

    def handleInputRows(self, key, rows: Iterable, timerValues) -> Iterator:
        days: dict[int, tuple[int, int, set[int]]] = {}
        for frame in rows:  # a part of the batch at a time
            seconds = frame["ts"].astype("datetime64[us]").astype("int64") // 1_000_000
            for second, h in zip(seconds.tolist(), (frame["value"] * 100).round().tolist(), strict=True):
                n, hundredths, held = days.setdefault(second // BUCKET, (0, 0, set()))
                held.add(second)
                days[second // BUCKET] = n + 1, hundredths + (int(h) if h == h else 0), held
        # a key without a timer has no open days: none is asked for, and what is reported is at hand
        first = not any(True for _ in self.handle.listTimers())
        for day, (n, hundredths, held) in days.items():
            if not first and self.open.containsKey((day,)):
                old = self.open.getValue((day,))
                n, hundredths, held = n + old[0], hundredths + old[1], held | set(old[2])
            self.open.updateValue((day,), (n, hundredths, sorted(held)))
        if first:
            self._wake(days)
        yield self._report(key, days if first else {k[0]: v for k, v in self.open.iterator()})

    def _wake(self, days: Iterable[int]) -> None:
        self.handle.registerTimer((min(days) + 1) * BUCKET * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        n, hundredths, last, longest = self._closed()
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        days = sorted((k[0], v) for k, v in self.open.iterator())
        left = [day for day, _ in days if (day + 1) * BUCKET > passed]
        for day, own in days[: len(days) - len(left)]:
            n, hundredths = n + own[0], hundredths + own[1]
            last, longest = longest_gap(own[2], last, longest)
            self.open.removeKey((day,))
        self.closed.update((n, hundredths, last, longest))
        if left:
            self._wake(left)
        yield from ()

    def _report(self, key, days: dict[int, tuple]):
        import pandas as pd

        n, hundredths, last, longest = self._closed()
        for day in sorted(days):
            own = days[day]
            n, hundredths = n + own[0], hundredths + own[1]
            last, longest = longest_gap(sorted(own[2]), last, longest)
        return pd.DataFrame({"user_id": [key[0]], "n": [n], "hundredths": [hundredths], "longest_s": [longest]})

    def close(self) -> None:
        pass


def tallied(events: DataFrame, delay: str) -> DataFrame:
    """``RESULT`` of a stream (user_id, ts, value), in update mode: a key's row replaces the one before.

    A user's numbers are exact for events that come at most ``delay`` behind the newest one of
    earlier batches.  The query has to be started with the state store ``STORE``.
    """
    keyed = events.withWatermark("ts", delay).groupBy("user_id")
    return keyed.transformWithStateInPandas(Tally(), RESULT, "update", "eventTime")
