"""Fingerprints assembled on the stream, minute by minute, from events and triggers.

A key is a stretch of FOLLOW bars. Triggers go to the stretch of their bar and the one before, so that an
event finds all its follow-ups in its own key; a key holds at most two stretches of triggers and is emptied
when the watermark leaves them. Every event has a timer per revealed minute; when the watermark passes it,
the print as seen then is emitted: origins, and the first follow-up of every other asset so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.graph import FOLLOW
from .freshness import millis

SLOT = "struct<ordinal:int,present:boolean,direction:int,magnitude:double,delay:int>"
PRINTS = f"universe string, t0 bigint, minutes int, fp array<{SLOT}>"
FEED = "universe string, kind string, idx bigint, ts timestamp, asset string, direction int, magnitude double, origins array<string>"


class PrintProcessor(StatefulProcessor):
    """Prints of the events of one (universe, stretch)."""

    def __init__(self, assets: dict[str, list[str]], step_ms: dict[str, int]):
        self.assets, self.step_ms = assets, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.triggers = handle.getMapState("triggers", "idx bigint, asset string", "direction int, magnitude double")
        self.events = handle.getMapState("events", "t0 bigint", "at bigint, origins array<string>, shown int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        step = self.step_ms[key[0]]
        for pdf in rows:
            for row in pdf[pdf["kind"] != "clock"].itertuples():
                idx, at = int(row.idx), millis(row.ts)
                if row.kind == "event":
                    self.events.updateValue((idx,), (at, list(row.origins), 0))
                    for minute in range(1, FOLLOW + 1):
                        self.handle.registerTimer(at + minute * step)
                else:
                    self.triggers.updateValue((idx, row.asset), (int(row.direction), float(row.magnitude)))
                self.handle.registerTimer(at + ((int(key[1]) + 2) * FOLLOW - idx) * step)  # the key's end
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        step, due, out = self.step_ms[key[0]], timerValues.getCurrentWatermarkInMs(), []
        seen = sorted((*k, *v) for k, v in self.triggers.iterator())
        for (t0,), (at, origins, shown) in sorted(self.events.iterator()):
            last = min(FOLLOW, (due - at) // step)
            for minute in range(shown + 1, last + 1):
                out.append((key[0], t0, minute, self._print(key[0], t0, minute, set(origins), seen)))
            if last > shown:
                self.events.updateValue((t0,), (at, list(origins), int(last)))
        if not any(timer > due for timer in self.handle.listTimers()):  # the watermark is past the key's end
            self.triggers.clear()
            self.events.clear()
        if out:
            yield pd.DataFrame(out, columns=["universe", "t0", "minutes", "fp"])

    def _print(self, universe: str, t0: int, minute: int, origins: set[str], seen: list[tuple]) -> list[tuple]:
        slots: dict[str, tuple] = {}
        for idx, asset, direction, magnitude in seen:
            delay = idx - t0
            if asset not in slots and (delay == 0 if asset in origins else 0 < delay <= minute):
                slots[asset] = (direction, magnitude, delay)
        return [(i, asset in slots, *slots.get(asset, (None, None, None))) for i, asset in enumerate(self.assets[universe])]

    def close(self) -> None:
        pass


def growing_prints(feed: DataFrame, assets: dict[str, list[str]], step_ms: dict[str, int], delay: str) -> DataFrame:
    """One print per event and revealed minute, from rows of FEED: events, triggers, and bars as clock.

    ``assets`` are the declared assets of each universe, in order. One clock row per bar time is enough; the
    processor drops them, since the optimizer would move a filter below the watermark they are there for.
    """
    rows = feed.withWatermark("ts", delay)
    own = F.expr(f"idx div {FOLLOW}")
    stretches = F.when(F.col("kind") == "trigger", F.array(own, own - 1)).otherwise(F.array(own))
    return (rows.withColumn("stretch", F.explode(stretches)).groupBy("universe", "stretch")
            .transformWithStateInPandas(PrintProcessor(assets, step_ms), PRINTS, "append", "EventTime"))
