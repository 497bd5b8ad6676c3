"""Closed bars, rolling snapshots and online shocks over an unbounded feed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.features import HORIZON, SHOCK_FRAME, SHOCK_LAG, STATE_BASE, STATE_LEVEL, STATE_RECENT
from ..operators.recovery import HORIZON as LAST_POINT
from ..operators.shocks import COOLDOWN
from .freshness import millis

RETENTION = 8
STATE_TTL_MS = 7 * 24 * 3600 * 1000


def closed_bars(ticks: DataFrame, step: str, delay: str) -> DataFrame:
    """OHLCVA bars of ``asset, ts, price, volume, amount, seq`` ticks, each emitted once closed.

    The watermark keeps open bars back and drops ticks that come later than ``delay``.
    """
    return (ticks.withWatermark("ts", delay)
            .groupBy("asset", F.window("ts", step).alias("w"))
            .agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
                 F.sum("volume").alias("volume"), F.sum("amount").alias("amount"))
            .select("asset", F.col("w.end").alias("ts"), "open", "high", "low", "close",
                    "volume", "amount"))


def completeness(bars: DataFrame, delay: str, assets: int, step: str = "1 hour") -> DataFrame:
    """Per closed bar time: how many assets reported; a gap is ``incomplete``, never filled."""
    return (bars.withWatermark("ts", delay).groupBy("universe", F.window("ts", step).alias("w"))
            .agg(F.count("*").alias("n"))
            .select("universe", F.col("w.end").alias("ts"), "n",
                    F.when(F.col("n") == assets, "complete").otherwise("incomplete").alias("status")))


def _rolling_std(values: np.ndarray, length: int) -> np.ndarray:
    out = np.full(len(values), np.nan)
    if len(values) >= length:
        out[length - 1:] = np.lib.stride_tricks.sliding_window_view(values, length).std(axis=1)
    return out


def _rolling_drawdown(closes: np.ndarray, length: int) -> np.ndarray:
    """Largest fall from a running peak over the last ``length`` closes."""
    out = np.full(len(closes), np.nan)
    if len(closes) >= length:
        frame = np.lib.stride_tricks.sliding_window_view(closes, length)
        peak = np.maximum.accumulate(frame, axis=1)
        out[length - 1:] = ((peak - frame) / peak).max(axis=1)
    return out


class _Tail(StatefulProcessor):
    """Keeps the last ``keep`` closes of a key as one row of state, and whether a gap came before them.

    With ``idle_ms`` a key that the watermark leaves so far behind is forgotten; if it comes back, it is new.
    """

    keep = 0
    idle_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "idx array<bigint>, close array<double>, broken boolean")

    def close(self) -> None:
        pass

    def _runs(self, rows: Iterator[pd.DataFrame]) -> tuple[list[tuple[pd.DataFrame, np.ndarray, int, bool]], pd.DataFrame]:
        """New rows as gapless runs, and those that came too late.

        A run has its new rows, the closes of tail and rows, the length of the tail and whether it
        began after a gap. Nothing is computed across a gap: a run starts without a tail then.
        """
        new = pd.concat(list(rows), ignore_index=True).sort_values("idx", ignore_index=True)
        idx, old, broken = [], [], False
        if self.tail.exists():
            idx, old, broken = self.tail.get()
            idx, old = list(idx), list(old)
        last = idx[-1] if idx else None
        passed = new["idx"] <= last if last is not None else np.zeros(len(new), bool)
        passed = passed | new["idx"].duplicated()
        late, new = new[passed], new[~passed].reset_index(drop=True)
        runs = []
        if len(new):
            at = new["idx"].to_numpy()
            before = np.concatenate([[at[0] - 1 if last is None else last], at[:-1]])
            for part in np.split(np.arange(len(at)), np.flatnonzero(at != before + 1)):
                if not len(part):
                    continue
                if at[part[0]] != before[part[0]] + 1:
                    idx, old, broken = [], [], True
                piece = new.iloc[part].reset_index(drop=True)
                closes = np.concatenate([np.array(old, float), piece["close"].to_numpy(float)])
                runs.append((piece, closes, len(old), broken))
                idx, old = [*idx, *piece["idx"].tolist()][-self.keep:], closes[-self.keep:].tolist()
            self.tail.update((idx, old, broken))
            if self.idle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(millis(new["ts"].max()) + self.idle_ms)
        return runs, late

    def forget(self) -> None:
        self.tail.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        self.forget()
        yield from ()


SNAPSHOT_SCHEMA = ("universe string, asset string, idx bigint, ts timestamp, close double, "
                   "vol30 double, ret30 double, mdd30 double, recent double, base double, ratio double, state string, "
                   "closes array<double>")


class SnapshotProcessor(_Tail):
    """Rolling metrics of one asset at each new bar, from the last 256 closes.

    A bar whose frames would reach over a gap is ``incomplete``; a bar that comes after a later one
    is reported as ``late`` and otherwise ignored.
    """

    keep = 256

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        runs, late = self._runs(rows)
        for new, closes, old, broken in runs:
            r = np.diff(np.log(closes), prepend=np.nan)
            vol = _rolling_std(r, HORIZON) * np.sqrt(HORIZON)
            ret = np.full(len(closes), np.nan)
            ret[HORIZON:] = closes[HORIZON:] / closes[:-HORIZON] - 1
            recent, base = _rolling_std(r, STATE_RECENT), _rolling_std(r, STATE_BASE)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(base > 0, recent / base, np.nan)
            short = np.arange(len(closes)) < STATE_BASE
            state = np.where(broken & short, "incomplete", np.where(
                np.isnan(ratio), "unavailable", np.where(ratio >= STATE_LEVEL, "above_usual", "near_usual")))
            yield pd.DataFrame({
                "universe": key[0], "asset": key[1], "idx": new["idx"], "ts": new["ts"],
                "close": new["close"], "vol30": vol[old:], "ret30": ret[old:],
                "mdd30": _rolling_drawdown(closes, HORIZON + 1)[old:], "recent": recent[old:], "base": base[old:],
                "ratio": ratio[old:], "state": state[old:],
                "closes": [closes[max(0, old + i - 60):old + i + 1].tolist() for i in range(len(new))]})
        if len(late):
            blank = {c.split()[0]: None for c in SNAPSHOT_SCHEMA.split(", ")}
            yield pd.DataFrame({**blank, "universe": key[0], "asset": key[1], "idx": late["idx"], "ts": late["ts"],
                                "close": late["close"], "state": "late"}).astype(
                {c: float for c in ("vol30", "ret30", "mdd30", "recent", "base", "ratio")})


def snapshots(bars: DataFrame, delay: str, idle_ms: int | None = None) -> DataFrame:
    """Snapshot rows per asset; ``ts`` keeps its watermark for a later stage."""
    return (bars.withWatermark("ts", delay).groupBy("universe", "asset")
            .transformWithStateInPandas(SnapshotProcessor(idle_ms), SNAPSHOT_SCHEMA, "append",
                                        "EventTime", eventTimeColumnName="ts"))


def published(snapshot_rows: DataFrame, assets: int, step: str = "1 hour") -> DataFrame:
    """Only bar times at which every asset of the universe has a snapshot, once closed."""
    row = F.struct("asset", "idx", "close", "vol30", "ret30", "mdd30", "recent", "base", "ratio", "state")
    return (snapshot_rows.filter("state <> 'late'").groupBy("universe", F.window("ts", step).alias("w"))
            .agg(F.count("*").alias("n"), F.collect_list(row).alias("rows"))
            .filter(F.col("n") == assets)
            .select("universe", F.col("w.start").alias("ts"), F.explode("rows").alias("s"))
            .select("universe", "ts", "s.*"))


class RetentionProcessor(StatefulProcessor):
    """Keeps the newest windows of a universe; every change is emitted as a new version.

    Both states leave ``ttl_ms`` of processing time after the last window of their universe.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "t0 bigint", ttlDurationMs=self.ttl_ms)
        self.version = handle.getValueState("version", "n bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        known = {row[0] for row in self.kept.get()} if self.kept.exists() else set()
        new = {int(t) for pdf in rows for t in pdf["t0"]}
        held = sorted(known | new)[-RETENTION:]
        version = 1 + (self.version.get()[0] if self.version.exists() else 0)
        self.kept.put([(t,) for t in held])
        self.version.update((version,))
        yield pd.DataFrame({"universe": key[0], "version": version, "t0": held})

    def close(self) -> None:
        pass


def retained(windows: DataFrame, ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    return windows.groupBy("universe").transformWithStateInPandas(
        RetentionProcessor(ttl_ms), "universe string, version bigint, t0 bigint", "append", "ProcessingTime")


TRIGGER_SCHEMA = ("universe string, k int, idx bigint, ts timestamp, asset string, direction int, "
                  "magnitude double")


class TriggerProcessor(_Tail):
    """Shock triggers of one asset: rolling signal plus the cooldown's end for every k."""

    keep = SHOCK_FRAME + SHOCK_LAG + 1

    def __init__(self, grid: tuple[int, ...], idle_ms: int | None = None):
        self.grid, self.idle_ms = grid, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.free = handle.getMapState("free", "k int", "idx bigint")

    def forget(self) -> None:
        super().forget()
        self.free.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        out = []
        for new, closes, old, _ in self._runs(rows)[0]:
            n = len(closes)
            if n <= SHOCK_FRAME + SHOCK_LAG:
                continue
            r5 = np.full(n, np.nan)
            r5[SHOCK_LAG:] = np.log(closes[SHOCK_LAG:] / closes[:-SHOCK_LAG])
            sigma = np.full(n, np.nan)
            sigma[SHOCK_FRAME:] = _rolling_std(r5, SHOCK_FRAME)[SHOCK_FRAME - 1:-1]
            for k in self.grid:
                free = self.free.getValue((k,))[0] if self.free.containsKey((k,)) else -1
                with np.errstate(invalid="ignore"):
                    hits = np.flatnonzero((sigma > 0) & (np.abs(r5) > k * sigma))
                for i in hits[hits >= old]:
                    at = int(new["idx"].iloc[i - old])
                    if at >= free:
                        free = at + COOLDOWN
                        out.append((*key[:1], k, at, new["ts"].iloc[i - old], key[1],
                                    1 if r5[i] > 0 else -1, abs(r5[i]) / sigma[i]))
                self.free.updateValue((k,), (free,))
        if out:
            yield pd.DataFrame(out, columns=["universe", "k", "idx", "ts", "asset", "direction",
                                             "magnitude"])


def online_triggers(bars: DataFrame, delay: str, grid: tuple[int, ...] = (3, 4, 5, 6),
                    idle_ms: int | None = None) -> DataFrame:
    return (bars.withWatermark("ts", delay).groupBy("universe", "asset")
            .transformWithStateInPandas(TriggerProcessor(grid, idle_ms), TRIGGER_SCHEMA, "append",
                                        "EventTime", eventTimeColumnName="ts"))


def pending_truth(origins: DataFrame, bars: DataFrame, horizon: str, delay: str) -> DataFrame:
    """Forecast rows joined to the bars of their horizon as those close; unmatched ones remain.

    ``origins`` has ``universe, asset, t0, as_of``; both sides carry watermarks, so the state of
    a forecast is dropped once its horizon has passed.
    """
    left = origins.withWatermark("as_of", delay).alias("o")
    right = bars.select(F.col("universe").alias("u"), F.col("asset").alias("a"), "idx", "ts",
                        "close").withWatermark("ts", delay).alias("b")
    return left.join(right, F.expr(f"""
        u = universe AND a = asset AND ts > as_of AND ts <= as_of + INTERVAL {horizon}"""),
        "left_outer").select("universe", "asset", "t0", "as_of", "idx", "close")


RECOVERY_SCHEMA = ("universe string, t0 bigint, tier string, h int, ratio double, streak int, "
                   "confirmed boolean, had_confirmed boolean")


class RecoveryProcessor(StatefulProcessor):
    """Calm streak of one (event, tier) as its curve is revealed.

    The state goes with the last point of the curve; that of a curve which breaks off, after ``ttl_ms``.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "streak int, had boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        streak, had = self.state.get() if self.state.exists() else (0, False)
        out = []
        new = pd.concat(list(rows), ignore_index=True).sort_values("h")
        for h, ratio in zip(new["h"], new["ratio"]):
            streak = streak + 1 if ratio <= STATE_LEVEL else 0
            had = had or streak >= 10
            out.append((*key, int(h), float(ratio), streak, streak >= 10, had))
        if new["h"].max() >= LAST_POINT:
            self.state.clear()
        else:
            self.state.update((int(streak), bool(had)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RECOVERY_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def recovery_tracker(curves: DataFrame, ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    return curves.groupBy("universe", "t0", "tier").transformWithStateInPandas(
        RecoveryProcessor(ttl_ms), RECOVERY_SCHEMA, "append", "ProcessingTime")


