"""Keyed state with timers: quiet periods of changing files, and rows that failed and come back.

Both need a checkpoint and the RocksDB state provider
(``spark.sql.streaming.stateStore.providerClass``); timers are those of event time, so the input
has a watermark and results do not depend on when a batch runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


class _Debounce(StatefulProcessor):
    """For each path the open quiet periods: their bounds, number of events and last action. An event joins what it is near to, also late ones and those between two periods."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "started long, last long, action string, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        periods = [tuple(p) for p in self.open.get()]
        for part in rows:
            periods += [(_ms(ts), _ms(ts), action, 1) for ts, action in zip(part["ts"], part["action"], strict=True)]
        merged: list[tuple] = []
        for start, last, action, n in sorted(periods, key=lambda p: p[:2]):
            if merged and start < merged[-1][1] + self.gap:
                a, b, said, m = merged[-1]
                merged[-1] = (a, max(b, last), action if last >= b else said, m + n)
            else:
                merged.append((start, last, action, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(timer))
        self.open.put(merged)
        for _, last, _, _ in merged:
            self.handle.registerTimer(last + self.gap)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        periods = [tuple(p) for p in self.open.get()]
        over = [p for p in periods if p[1] + self.gap <= due]
        left = [p for p in periods if p[1] + self.gap > due]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        if over:
            yield pd.DataFrame({"path": [key[0]] * len(over), "started": pd.to_datetime([p[0] for p in over], unit="ms"), "ended": pd.to_datetime([p[1] + self.gap for p in over], unit="ms"), "last_action": [p[2] for p in over], "n_events": [p[3] for p in over]})

    def close(self) -> None:
        pass


def debounced(events: DataFrame, gap_ms: int) -> DataFrame:
    """``path, started, ended, last_action, n_events``: one row for each quiet period of a path, once no event of it can come any more.

    ``events``: ``path``, ``ts`` (with a watermark) and ``action``. Each event starts its path's
    period anew for ``gap_ms``; the last action by time wins, of equally late ones any. The rows
    are those of :func:`lectern.operators.sync.debounced` over the same events.
    """
    schema = "path string, started timestamp, ended timestamp, last_action string, n_events long"
    return events.groupBy("path").transformWithStateInPandas(_Debounce(gap_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class _Retry(StatefulProcessor):
    """For each job its failed attempts, the last error and when it may come back (null once it has)."""

    def __init__(self, base_ms: int, most_ms: int, attempts: int):
        self.base, self.most, self.attempts = base_ms, most_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failed = handle.getValueState("failed", "attempts long, error string, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.failed.get()) if self.failed.exists() else (0, "", None)
        out = []
        said = sorted(((_ms(ts), bool(ok), error) for part in rows for ts, ok, error in zip(part["ts"], part["ok"], part["error"], strict=True)), key=lambda r: r[0])
        for at, ok, error in said:
            attempts, last, due = held
            if due is not None and due <= at:  # it came back before this outcome, though the timer has not run out yet
                out.append((key[0], due, "retry", attempts, last))
            if ok or attempts + 1 >= self.attempts:
                out.append((key[0], at, "completed", 0, "") if ok else (key[0], at, "dead", attempts + 1, error))
                held = (0, "", None)
            else:
                held = (attempts + 1, error, at + min(self.base * 2**attempts, self.most))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(timer))
        if held[0]:
            self.failed.update(held)
            if held[2] is not None:
                self.handle.registerTimer(held[2])
        elif self.failed.exists():
            self.failed.clear()
        yield _job_rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.failed.exists():
            attempts, error, due = self.failed.get()
            if due is not None:
                self.failed.update((attempts, error, None))
                yield _job_rows([(key[0], due, "retry", attempts, error)])

    def close(self) -> None:
        pass


def _job_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"job": [r[0] for r in rows], "at": pd.to_datetime([r[1] for r in rows], unit="ms"), "status": [r[2] for r in rows], "attempts": [r[3] for r in rows], "error": [r[4] for r in rows]}) if rows else pd.DataFrame()


def retried(outcomes: DataFrame, base_ms: int = 60_000, most_ms: int = 3_600_000, attempts: int = 3) -> DataFrame:
    """``job, at, status, attempts, error`` from outcomes of attempts (``job, ts`` with a watermark, ``ok, error``).

    ``retry``: a failed job's delay is over (``base_ms``, doubled with each attempt, ``most_ms``
    at most) and no other outcome has come; ``dead``: it has failed ``attempts`` times and goes
    to the dead list; ``completed``: an attempt succeeded, and its failures are forgotten.
    """
    schema = "job string, at timestamp, status string, attempts long, error string"
    rows = outcomes.withColumn("error", F.coalesce("error", F.lit("")))
    return rows.groupBy("job").transformWithStateInPandas(_Retry(base_ms, most_ms, attempts), outputStructType=schema, outputMode="Append", timeMode="EventTime")
