"""Staleness of feeds, decided on the stream: a feed that stops turns stale by its own timer.

The state of a feed is its newest bar. A timer stands one millisecond after that bar's age reaches the
limit; a newer bar moves it. With the processing clock the timer needs no further row, so a feed that is
silent is reported while it is silent. With the event clock (replays, audits) ages are held against the
watermark, and a gap between two bars is found when the second one comes. A failed poll (a row with an
error) makes its feed stale at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT_MS = 180_000
CHANGES = "feed string, at timestamp, as_of timestamp, age_s double, stale boolean, error string"


def millis(stamp: pd.Timestamp) -> int:
    return (stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp).value // 1_000_000


def stamp(ms: int | None) -> pd.Timestamp | None:
    return None if ms is None else pd.Timestamp(ms, unit="ms")


class FreshnessProcessor(StatefulProcessor):
    """Changes between fresh and stale of one feed."""

    def __init__(self, event_clock: bool):
        self.event_clock = event_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "as_of bigint, stale boolean, limit_ms bigint")

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    @staticmethod
    def _row(feed: str, at: int, as_of: int | None, stale: bool, error: str | None = None) -> tuple:
        age = None if as_of is None else max(0, at - as_of) / 1000
        return feed, stamp(at), stamp(as_of), age, stale, error

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        as_of, stale, limit = self.last.get() if self.last.exists() else (None, None, None)
        new = pd.concat(list(rows), ignore_index=True).sort_values("ts", ignore_index=True, kind="stable")
        limit, out = int(new["limit_ms"].iloc[0]), []
        for ts, error in zip(new["ts"], new["error"], strict=True):
            at = millis(ts)
            now = at if self.event_clock else max(at, timerValues.getCurrentProcessingTimeInMs())
            if error is not None and not pd.isna(error):
                if not stale:
                    out.append(self._row(key[0], now, as_of, True, error))
                stale = True
                continue
            if as_of is not None and at <= as_of:
                continue  # a repeat, or a bar older than the newest
            if self.event_clock and as_of is not None and not stale and at - as_of > limit:
                out.append(self._row(key[0], as_of + limit + 1, as_of, True))
                stale = True
            as_of, old = at, now - at > limit
            if stale is None or stale != old:
                out.append(self._row(key[0], now, as_of, old))
            stale = old
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if as_of is not None and not stale:
            self.handle.registerTimer(as_of + limit + 1)
        self.last.update((as_of, stale, limit))
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        as_of, stale, limit = self.last.get()
        out = []
        if not stale and as_of is not None:
            due = as_of + limit + 1
            now = due if self.event_clock else max(due, timerValues.getCurrentProcessingTimeInMs())
            out.append(self._row(key[0], now, as_of, True))
            self.last.update((as_of, True, limit))
        yield from self._frame(out)

    def close(self) -> None:
        pass


def freshness(bars: DataFrame, limit_ms: int | Column = LIMIT_MS, delay: str | None = None) -> DataFrame:
    """Changes of ``feed``s, from rows ``feed, ts`` and, if there is one, ``error`` (a failed poll at ``ts``).

    Without ``delay`` the processing clock runs; with it, the watermark.
    """
    rows = bars if "error" in bars.columns else bars.withColumn("error", F.lit(None).cast("string"))
    rows = rows.select("feed", "ts", "error", (F.lit(limit_ms) if isinstance(limit_ms, int) else limit_ms).cast("long").alias(
        "limit_ms"))
    if delay is not None:
        rows = rows.withWatermark("ts", delay)
    return rows.groupBy("feed").transformWithStateInPandas(
        FreshnessProcessor(delay is not None), CHANGES, "append", "ProcessingTime" if delay is None else "EventTime")
