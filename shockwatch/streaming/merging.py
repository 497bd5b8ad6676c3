"""Fixed-anchor merge of online triggers, cut into time chunks.

The rule is sequential: a trigger that no open event blocks opens one and blocks the next MERGE bars. Only
the number of bars still blocked at a chunk's border (0 to MERGE) reaches over it, so a chunk keeps its own
triggers and decides them for every such entry at once; an anchor carries the set of entries it stands for.
A second, small stage per (universe, k) knows which entry is the true one: it keeps the current chunk, its
entry and the borders the chunk would hand over, lets the anchors of the true entry pass, and holds no
trigger. Nothing waits for a chunk to end: a trigger is decided when the watermark is MERGE bars beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.shocks import MERGE, SYSTEMIC_ASSETS
from .freshness import millis, stamp

CHUNK = 512
ANCHORS = ("universe string, k int, chunk bigint, ts timestamp, t0 bigint, at timestamp, origins string, direction int, "
           "magnitude double, systemic_assets bigint, entries int, borders array<int>")
EVENT_SCHEMA = ("universe string, k int, t0 bigint, ts timestamp, origins string, direction int, "
                "magnitude double, systemic_assets bigint, systemic boolean")


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class ChunkProcessor(StatefulProcessor):
    """Anchors of one (universe, k, chunk), for every number of bars blocked at its start.

    The triggers of neighbours within MERGE bars of the border come along, for the systemic count only.
    """

    def __init__(self, step_ms: dict[str, int], chunk: int):
        self.step_ms, self.chunk = step_ms, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "idx bigint, asset string", "at bigint, direction int, magnitude double")
        self.decided = handle.getValueState("decided", "last bigint, free array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        step, end = self.step_ms[key[0]], (int(key[2]) + 1) * self.chunk
        for pdf in rows:
            for row in pdf.itertuples():
                idx, at = int(row.idx), millis(row.ts)
                self.seen.updateValue((idx, row.asset), (at, int(row.direction), float(row.magnitude)))
                if idx // self.chunk == int(key[2]):
                    self.handle.registerTimer(at + MERGE * step)
                self.handle.registerTimer(at + (end + 2 * MERGE - idx) * step)  # the key's end
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        step, start, due = self.step_ms[key[0]], int(key[2]) * self.chunk, timerValues.getCurrentWatermarkInMs()
        end = start + self.chunk
        seen = sorted((*k, *v) for k, v in self.seen.iterator())
        last, free = self.decided.get() if self.decided.exists() else (start - 1, range(start, start + MERGE + 1))
        free, out = list(free), []
        at = {idx: ms for idx, _, ms, *_ in seen if last < idx < end and ms + MERGE * step <= due}
        for idx in sorted(at):
            entries = [e for e, first in enumerate(free) if first <= idx]
            last = idx
            if not entries:
                continue
            for e in entries:
                free[e] = idx + MERGE + 1
            origins = [row for row in seen if row[0] == idx]
            signs = {row[3] for row in origins}
            out.append((key[0], int(key[1]), int(key[2]), stamp(due + 1), idx, stamp(at[idx]), "|".join(row[1] for row in origins),
                        signs.pop() if len(signs) == 1 else 0, max(row[4] for row in origins),
                        len({row[1] for row in seen if abs(row[0] - idx) <= MERGE}), sum(1 << e for e in entries),
                        [max(0, first - end) for first in free]))
        self.decided.update((last, free))
        for idx, asset, *_ in seen:
            if idx < last - MERGE:
                self.seen.removeKey((idx, asset))
        if not any(timer > due for timer in self.handle.listTimers()):  # the watermark is past the key's end
            self.seen.clear()
            self.decided.clear()
        if out:
            yield pd.DataFrame(out, columns=names(ANCHORS))

    def close(self) -> None:
        pass


class BorderProcessor(StatefulProcessor):
    """Lets the anchors of the true entries of one (universe, k) pass.

    Anchors come in order of time: when one of a chunk is due, all of earlier chunks were due before.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("border", "chunk bigint, entry int, borders array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        chunk, entry, borders = self.state.get() if self.state.exists() else (None, 0, None)
        new = pd.concat(list(rows), ignore_index=True).sort_values("t0", ignore_index=True)
        kept = []
        for i, (own, entries, reach) in enumerate(zip(new["chunk"], new["entries"], new["borders"], strict=True)):
            if own != chunk:
                entry = borders[entry] if chunk is not None and own == chunk + 1 else 0
                chunk = int(own)
            borders = [int(b) for b in reach]
            if entries >> entry & 1:
                kept.append(i)
        self.state.update((chunk, entry, borders))
        if kept:
            out = new.iloc[kept].assign(ts=new["at"], systemic=new["systemic_assets"] >= SYSTEMIC_ASSETS)
            yield out[names(EVENT_SCHEMA)]

    def close(self) -> None:
        pass


def online_events(trigger_rows: DataFrame, step_ms: dict[str, int], chunk: int = CHUNK) -> DataFrame:
    """Events of triggers as they become final; ``chunk`` bars at least MERGE long share a key."""
    own = F.expr(f"idx div {chunk}")
    near = F.array_compact(F.array(own, F.when(F.expr(f"idx % {chunk} < {MERGE}"), own - 1),
                                   F.when(F.expr(f"idx % {chunk} >= {chunk - MERGE}"), own + 1)))
    anchors = (trigger_rows.withColumn("chunk", F.explode(near)).groupBy("universe", "k", "chunk")
               .transformWithStateInPandas(ChunkProcessor(step_ms, chunk), ANCHORS, "append", "EventTime",
                                           eventTimeColumnName="ts"))
    return anchors.groupBy("universe", "k").transformWithStateInPandas(BorderProcessor(), EVENT_SCHEMA, "append", "EventTime")
