"""Login rules and sessions on live streams: keyed state that event-time timers clear.

A stream decides each attempt as it arrives: within a micro-batch in the order of (ms, event_id), between
micro-batches in their order. Rows older than the watermark are dropped before they reach a rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyroom.operators.access import IDLE_MS

#: The state store that rules with keyed state and timers need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Key of rows that only move the watermark on, so that a stream without new activity closes its sessions.
BEAT = "\u0000beat"


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch in the order of time."""
    return pd.concat(list(rows)).sort_values(["ms", "event_id"])


def throttled(ms: np.ndarray, count: int, reset_at: int, limit: int, window_ms: int) -> tuple[np.ndarray, int, int]:
    """Allowed flags of ordered attempts that go on from a window (count so far, its end), and the window after."""
    out = np.zeros(len(ms), bool)
    i = int(np.searchsorted(ms, reset_at, "left")) if count else 0
    out[: max(0, min(i, limit - count))] = True
    count += i
    while i < len(ms):
        reset_at = int(ms[i]) + window_ms
        end = int(np.searchsorted(ms, reset_at, "left"))
        out[i : min(end, i + limit)] = True
        i, count = end, end - i
    return out, count, reset_at


class _Keyed(StatefulProcessor):
    """What both rules share: one timer a key, at the time when nothing that is held matters any more."""

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _timer(self, before: int | None, after: int | None) -> None:
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Throttle(_Keyed):
    """State of a key: attempts of its window and the window's end, which is also its timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("window", "count long, reset_at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = _ordered(rows)
        count, before = self.state.get() if self.state.exists() else (0, None)
        allowed, count, reset_at = throttled(pdf["ms"].to_numpy(), int(count), before or 0, self.limit, self.window_ms)
        self.state.update((count, reset_at))
        self._timer(before, reset_at)
        yield pdf.assign(allowed=allowed)[["event_id", "key", "ms", "allowed"]]


class _Burst(_Keyed):
    """State of a key: the times of its recorded attempts, as many as the limit at most."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getListState("recorded", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = _ordered(rows)
        recent = [int(r[0]) for r in self.state.get()] if self.state.exists() else []
        before, refused = max(recent, default=None), []
        for at, success in zip(pdf["ms"].tolist(), pdf["success"].tolist(), strict=True):
            recent = [t for t in recent if t > at - self.window_ms]
            refused.append(len(recent) >= self.limit)
            if not refused[-1]:
                recent = [] if success else [*recent, at]
        if recent:
            self.state.put([(t,) for t in recent])
        else:
            self.state.clear()
        ends = lambda newest: None if newest is None else newest + self.window_ms
        self._timer(ends(before), ends(max(recent, default=None)))
        yield pdf.assign(refused=refused)[["event_id", "key", "ms", "refused"]]


def _timed(attempts: DataFrame, late: str) -> DataFrame:
    return attempts.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", late)


def stream_login_throttle(attempts: DataFrame, limit: int = 10, window_ms: int = 15 * 60 * 1000, late: str = "1 minute") -> DataFrame:
    """ST4 on a stream of (event_id, key, ms): ``allowed`` for each attempt as it arrives.

    A window is kept until event time passes its end, however long the stream is down; needs ``ROCKSDB``.
    """
    rows = _timed(attempts.select("event_id", "key", "ms"), late).groupBy("key")
    return rows.transformWithStateInPandas(_Throttle(limit, window_ms), "event_id long, key string, ms long, allowed boolean", outputMode="Append", timeMode="EventTime")


def stream_failed_login_burst(attempts: DataFrame, limit: int = 8, window_ms: int = 60_000, late: str = "1 minute") -> DataFrame:
    """ST5 on a stream of (event_id, key, ms, success): ``refused`` for each attempt as it arrives.

    A key's recorded times are kept until event time passes the newest by the window; needs ``ROCKSDB``.
    """
    rows = _timed(attempts.select("event_id", "key", "ms", "success"), late).groupBy("key")
    return rows.transformWithStateInPandas(_Burst(limit, window_ms), "event_id long, key string, ms long, refused boolean", outputMode="Append", timeMode="EventTime")


def stream_idle_sessions(activity: DataFrame, late: str = "1 hour") -> DataFrame:
    """ST6 on a stream of (key, ms): sessions (key, started, ended, n) with gaps under 15 minutes, given once closed.

    Rows up to ``late`` behind the newest are put into their session, wherever it is still open, and may join two;
    older ones are dropped. A gap of exactly 15 minutes ends a session: windows that touch are one, so the
    window is a millisecond short. Rows of key BEAT move time on; whoever reads the sessions leaves that key out (a filter here would be
    moved below the watermark and take the rows away before they count).
    """
    rows = activity.select("key", "ms", F.timestamp_millis("ms").alias("ts")).withWatermark("ts", late)
    sessions = rows.groupBy("key", F.session_window("ts", f"{IDLE_MS - 1} milliseconds").alias("w"))
    out = sessions.agg(F.min("ms").alias("started"), F.max("ms").alias("ended"), F.count("*").alias("n"))
    return out.select("key", "started", "ended", "n")
