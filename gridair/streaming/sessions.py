"""Session histories in the state store: the last turns of every session, its expiry by event time or by the clock.

State lives in list and value variables of ``transformWithStateInPandas`` on the RocksDB store, so that it may outgrow an
executor's memory; a timer for each session ends it, and nothing is scanned to find idle ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HISTORY = "conv_id bigint, messages bigint, kept int, first_turn bigint, last_turn bigint, last_ts timestamp, expired boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class History(StatefulProcessor):
    """The last ``keep`` turns of a session.  ``by_clock``: entries live ``idle_ms`` on the processing clock (TTL); else a timer on event time ends the session."""

    def __init__(self, keep: int, idle_ms: int, by_clock: bool):
        self.keep, self.idle, self.by_clock = keep, idle_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.idle if self.by_clock else None
        self.handle = handle
        self.turns = handle.getListState("turns", "ts bigint, turn bigint", ttl)
        self.count = handle.getValueState("messages", "n bigint", ttl)

    def _row(self, key, n: int, kept: list[tuple[int, int]], expired: bool) -> tuple:
        return int(key[0]), n, len(kept), kept[0][1], kept[-1][1], kept[-1][0], expired

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        """All rows of a key in one frame: a frame for each costs far more than the row."""
        out = pd.DataFrame(rows, columns=["conv_id", "messages", "kept", "first_turn", "last_turn", "last_ts", "expired"])
        out["last_ts"] = pd.to_datetime(out["last_ts"], unit="us")
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(ts), int(turn)) for ts, turn in self.turns.get()]
        n = int(self.count.get()[0]) if held and self.count.exists() else 0
        new = set()
        for pdf in rows:
            new.update(zip(pdf["ts"].astype("datetime64[us]").astype("int64").tolist(), pdf["turn"].tolist(), strict=True))
        new = sorted(new.difference(held))
        if not new:
            return
        run, n, out = sorted(held + new), n + len(new), []
        if not self.by_clock:
            # Every idle stretch ends a session; its turns so far are counted from the back.
            cuts = [i for i in range(1, len(run)) if run[i][0] - run[i - 1][0] >= self.idle * 1000]
            before = n - len(run)  # turns of the first session that are no longer held
            for a, b in zip([0, *cuts], cuts, strict=False):
                out.append(self._row(key, b - a + (before if a == 0 else 0), run[a:b][-self.keep:], True))
            if cuts:
                run = run[cuts[-1]:]
                n = len(run)
            for timer in list(self.handle.listTimers()) if held else ():  # no turn, no timer
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-run[-1][0] // 1000) + self.idle)
        run = run[-self.keep:]
        self.turns.put(run)
        self.count.update((n,))
        yield self._rows([*out, self._row(key, n, run, False)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(int(ts), int(turn)) for ts, turn in self.turns.get()]
        if held:
            yield self._rows([self._row(key, int(self.count.get()[0]), held, True)])
        self.turns.clear()
        self.count.clear()

    def close(self) -> None:
        pass


def session_histories(messages: DataFrame, keep: int = 50, idle_s: int = 3600, watermark: str = "2 hours") -> DataFrame:
    """Histories of sessions (conv_id, turn, ts) that end after ``idle_s`` without a message, by event time.

    A row for every session a batch has touched (``expired`` false), and one for every session that has ended, either
    because its next message came after the idle time or because the watermark passed it.  A message sent twice counts once as
    long as it is held.  Run it with the RocksDB store (``run_available(..., provider=ROCKSDB)``).
    """
    rows = messages.select("conv_id", "turn", "ts").withWatermark("ts", watermark)
    return rows.groupBy("conv_id").transformWithStateInPandas(History(keep, idle_s * 1000, False), HISTORY, "Append", "EventTime")


def live_histories(messages: DataFrame, keep: int = 50, idle_s: int = 3600) -> DataFrame:
    """Histories whose turns are forgotten ``idle_s`` after they arrived, by the clock (time to live of the state); no rows at the end.

    State by the clock asks for a batch at every trigger, also without data: run it on an interval, or, to take what is
    available and stop, with ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    return messages.select("conv_id", "turn", "ts").groupBy("conv_id").transformWithStateInPandas(History(keep, idle_s * 1000, True), HISTORY, "Update", "ProcessingTime")
