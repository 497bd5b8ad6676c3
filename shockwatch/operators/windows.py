"""Origins, look-back windows and forward truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import horizon_volatility, max_drawdown
from .halo import CHUNK, with_halo

LOOKBACK = 256
HORIZON = 30


FOLDS_PER_TASK = 4096


def rolling_origins(spans: DataFrame, stride: int = HORIZON, lookback: int = LOOKBACK,
                    horizon: int = HORIZON, limit: int | None = None) -> DataFrame:
    """Fold plan: every ``stride`` bars from the first full look-back to the last full horizon.

    ``available`` counts all folds; ``limit`` keeps the first of them, as a plan does. A universe is
    cut into runs of folds first, and the runs are dealt to tasks before they are spelled out.
    """
    last = F.col("n") - horizon - 1
    count = F.greatest(F.floor((last - (lookback - 1)) / stride) + 1, F.lit(0)).cast("int")
    plan = spans.withColumn("available", count).filter("available > 0")
    chosen = F.least("available", F.lit(limit)) if limit else F.col("available")
    runs = plan.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((chosen - 1) / FOLDS_PER_TASK).cast("int"))))
    width = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("_run") * FOLDS_PER_TASK
    fold = F.explode(F.sequence(first, F.least(first + FOLDS_PER_TASK, chosen) - 1))
    return (runs.repartition(width, "universe", "_run").withColumn("_fold", fold)
            .select("universe", (F.col("_fold").cast("long") * stride + lookback - 1).alias("t0"), "available"))


def evenly_placed(candidates: DataFrame, pos: Column, n: Column, count: int) -> DataFrame:
    """Row ``floor(i (n - 1) / (count - 1))`` of each list, i = 0..count-1, for known positions.

    Keeps every candidate when there are no more than ``count``. Position p is chosen when some i
    maps to it: i = ceil(p (count - 1) / (n - 1)) is the only one that can, because the mapping is
    monotone with steps of at least one.
    """
    steps = F.greatest(n - 1, F.lit(1))
    i = F.ceil(pos * (count - 1) / steps)
    return candidates.filter((n <= count) | (F.floor(i * steps / (count - 1)) == pos))


def evenly_spaced(candidates: DataFrame, keys, order, count: int) -> DataFrame:
    """``evenly_placed`` for lists whose positions have to be counted (keys with few rows, as a day)."""
    w = Window.partitionBy(*keys)
    placed = (candidates.withColumn("_pos", F.row_number().over(w.orderBy(*order)) - 1)
              .withColumn("_n", F.count("*").over(w)))
    return evenly_placed(placed, F.col("_pos"), F.col("_n"), count).drop("_pos", "_n")


def calendar_origins(spans: DataFrame, per_day: int, stride: int, bars_per_day: int,
                     lookback: int = LOOKBACK, horizon: int = HORIZON) -> DataFrame:
    """Origins every ``stride`` bars, thinned to ``per_day`` evenly spaced ones per day."""
    grid = (rolling_origins(spans, stride, lookback, horizon)
            .withColumn("day_no", F.floor(F.col("t0") / bars_per_day)))
    return evenly_spaced(grid, ("universe", "day_no"), ("t0",), per_day)


def _packed(bars: DataFrame, lookback: int, horizon: int, chunk: int) -> DataFrame:
    """The closes of every chunk of an asset with the halo its windows need, ``_p`` from bar ``_first`` on.

    Partitioned by (universe, chunk), so that packing and a join with origins share it.
    """
    point = F.struct(F.col("idx").alias("i"), F.col("close").alias("c"))
    return (with_halo(bars.select("universe", "asset", "idx", "close"), lookback - 1, horizon, chunk=chunk)
            .repartition("universe", "_chunk")
            .groupBy("universe", "_chunk", "asset")
            .agg(F.min("idx").alias("_first"), F.array_sort(F.collect_list(point)).alias("_p"))
            .withColumn("_p", F.col("_p.c")))


def _cut(t0: Column, lookback: int, horizon: int) -> Column:
    """The window of one origin as slices of its chunk."""
    at = (t0 - F.col("_first") + 1).cast("int")
    start = F.greatest(at - lookback + 1, F.lit(1))
    return F.struct(t0.alias("t0"), F.slice("_p", start, at - start + 1).alias("hist"),
                    F.slice("_p", at + 1, F.lit(horizon)).alias("fut"))


def rolling_windows(bars: DataFrame, stride: int = HORIZON, lookback: int = LOOKBACK,
                    horizon: int = HORIZON, chunk: int = CHUNK) -> DataFrame:
    """The ready windows at every ``stride``-th bar, as ``market_windows`` gives them for ``rolling_origins``.

    Every chunk knows its own origins from its place on the grid, so there is no fold plan, no join
    and one shuffle of the bars. ``bars`` must be a dense grid; empty bars give no windows.
    """
    start = F.greatest(F.col("_chunk") * chunk, F.lit(lookback - 1))
    first = start + F.pmod(F.lit(lookback - 1) - start, F.lit(stride))
    last = F.least((F.col("_chunk") + 1) * chunk, F.col("_first") + F.size("_p") - horizon) - 1
    places = F.when(first <= last, F.sequence(first, last, F.lit(stride).cast("long")))
    return (_packed(bars, lookback, horizon, chunk)
            .select("universe", "asset", F.explode(F.transform(places, lambda t0: _cut(t0, lookback, horizon))).alias("_w"))
            .select("universe", "_w.t0", "asset", "_w.hist", "_w.fut", F.lit("ready").alias("status")))


def market_windows(origins: DataFrame, bars: DataFrame, lookback: int = LOOKBACK,
                   horizon: int = HORIZON, chunk: int = CHUNK) -> DataFrame:
    """Per (origin, asset): the closes up to the origin and those after it.

    ``hist`` ends exactly at ``t0``; an origin without its full look-back is ``no_history``,
    one without its full horizon ``pending_truth`` with an empty ``fut``. Only ``hist`` may be
    handed to a forecaster.

    Overlapping windows share their bars: every chunk of an asset is packed once with the halo
    its windows need, and the windows are slices of that array. Each bar is shuffled once (plus
    the halo), not once per window. ``bars`` must be a dense grid.
    """
    packed = _packed(bars, lookback, horizon, chunk)
    wanted = (origins.select("universe", "t0").distinct()
              .groupBy("universe", F.floor(F.col("t0") / chunk).cast("long").alias("_chunk"))
              .agg(F.collect_list("t0").alias("_t0")))

    rows = (packed.join(wanted, ["universe", "_chunk"])
            .select("universe", "asset", F.explode(F.transform("_t0", lambda t0: _cut(t0, lookback, horizon))).alias("_w"))
            .select("universe", "_w.t0", "asset", "_w.hist", "_w.fut"))
    whole = F.size("fut") == horizon
    return (rows.withColumn("status", F.when(F.size("hist") != lookback, "no_history")
                            .when(~whole, "pending_truth").otherwise("ready"))
            .withColumn("fut", F.when(whole, F.col("fut"))
                        .otherwise(F.array().cast("array<double>"))))


def truth_risk(windows: DataFrame, logs=None) -> DataFrame:
    """Realised drawdown and volatility of the future part of ready windows; ``logs`` as in ``horizon_volatility``."""
    spot = F.element_at("hist", -1)
    return (windows.filter("status = 'ready'")
            .select("universe", "t0", "asset", max_drawdown(spot, F.col("fut")).alias("mdd"),
                    horizon_volatility(spot, F.col("fut"), logs).alias("vol")))
