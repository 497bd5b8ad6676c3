"""Shock detection: candidates, cooldown, fixed-anchor merge, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bandjoin import band_join
from .scan import assign_anchors

K_GRID = (3, 4, 5, 6)
COOLDOWN = 30
MERGE = 10
SYSTEMIC_ASSETS = 3
MIN_HISTORY = 255
HORIZON = 30


def candidates(signal: DataFrame, grid: Sequence[int] = K_GRID) -> DataFrame:
    """One row per (k, bar) with ``abs(r5) > k * sigma``; a zero sigma never qualifies.

    The grid is exploded only on rows that pass its smallest value.
    """
    strength = F.abs("r5") > F.col("k") * F.col("sigma")
    weakest = F.abs("r5") > F.lit(min(grid)) * F.col("sigma")
    return (signal.filter((F.col("sigma") > 0) & weakest)
            .withColumn("k", F.explode(F.array(*[F.lit(k) for k in grid]))).filter(strength))


def triggers(signal: DataFrame, grid: Sequence[int] = K_GRID) -> DataFrame:
    """Candidates that survive the per-asset cooldown."""
    kept = assign_anchors(candidates(signal, grid), ("universe", "asset", "k"), COOLDOWN,
                          payload=("ts", "r5", "sigma"))
    return kept.filter("idx = anchor").select(
        "universe", "k", "idx", "ts", "asset", F.signum("r5").cast("int").alias("direction"),
        (F.abs("r5") / F.col("sigma")).alias("magnitude"))


def detector_statistics(signal: DataFrame, retained: DataFrame,
                        grid: Sequence[int] = K_GRID) -> DataFrame:
    """Raw, retained, suppressed and zero-sigma counts per asset and in total, for each k."""
    ks = F.explode(F.array(*[F.lit(k) for k in grid])).alias("k")
    tall = [F.count_if((F.col("sigma") > 0) & (F.abs("r5") > k * F.col("sigma"))).alias(f"raw_{k}")
            for k in grid]
    raw = (signal.groupBy("universe", "asset")
           .agg(*tall, F.count_if(F.col("sigma") == 0).alias("zero_sigma"))
           .select("universe", "asset", "zero_sigma", *[f"raw_{k}" for k in grid], ks)
           .withColumn("raw", F.element_at(F.create_map(
               *[x for k in grid for x in (F.lit(k), F.col(f"raw_{k}"))]), F.col("k"))))
    kept = retained.groupBy("universe", "asset", "k").agg(F.count("*").alias("kept"))
    both = (raw.join(kept, ["universe", "asset", "k"], "left")
            .fillna({"kept": 0}).select("universe", "asset", "k", "zero_sigma", "raw", "kept"))
    return (both.groupingSets([["universe", "k", "asset"], ["universe", "k"]],
                              "universe", "k", "asset")
            .agg(F.coalesce("asset", F.lit("total")).alias("scope"),
                 F.sum("raw").alias("raw"), F.sum("kept").alias("kept"),
                 (F.sum("raw") - F.sum("kept")).alias("suppressed"),
                 F.sum("zero_sigma").alias("zero_sigma"))
            .drop("asset"))


def systemic_counts(events: DataFrame, retained: DataFrame, keys: Sequence[str],
                    back: int = MERGE, ahead: int = MERGE) -> DataFrame:
    """Distinct assets triggering in ``[t0 - back, t0 + ahead]``; ``ahead=0`` is past-only."""
    return (band_join(events.select(*keys, "t0"),
                      retained.select(*keys, F.col("idx").alias("_t"), "asset"),
                      keys, -back, ahead, "t0", "_t")
            .groupBy(*keys, "t0")
            .agg(F.size(F.collect_set("asset")).cast("long").alias("systemic_assets")))


def exclusion_reasons(t0, n):
    return F.array_compact(F.array(
        F.when(t0 < MIN_HISTORY, "insufficient_history_256"),
        F.when(t0 + HORIZON >= n, "incomplete_future_30")))


def merge_events(retained: DataFrame, spans: DataFrame,
                 keys: Sequence[str] = ("universe", "k")) -> DataFrame:
    """Merge triggers: the earliest opens an event and absorbs through ``t0 + 10``, no chaining.

    ``keys`` may carry more dimensions (a permutation replicate, say). ``systemic`` is null
    until ``t0 + 10`` has been observed.
    """
    anchors = assign_anchors(retained.select(*keys, "idx").distinct(), keys, MERGE + 1)
    member = F.struct("idx", "asset", "direction", "magnitude")
    origin = F.col("idx") == F.col("anchor")
    merged = (retained.join(anchors, [*keys, "idx"])
              .groupBy(*keys, F.col("anchor").alias("t0"))
              .agg(F.min("ts").alias("ts"),
                   F.array_sort(F.collect_list(F.when(origin, F.col("asset")))).alias("origins"),
                   F.min(F.when(origin, F.col("direction"))).alias("_lo"),
                   F.max(F.when(origin, F.col("direction"))).alias("_hi"),
                   F.max(F.when(origin, F.col("magnitude"))).alias("magnitude"),
                   F.array_sort(F.collect_list(member)).alias("members")))
    counts = systemic_counts(merged, retained, keys)
    return (merged.join(counts, [*keys, "t0"])
            .join(spans.select("universe", "n"), "universe")
            .withColumn("direction", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
                        .otherwise(0))
            .withColumn("systemic", F.when(F.col("t0") + MERGE < F.col("n"),
                                           F.col("systemic_assets") >= SYSTEMIC_ASSETS))
            .withColumn("reasons", exclusion_reasons(F.col("t0"), F.col("n")))
            .withColumn("eligible", F.size("reasons") == 0)
            .drop("_lo", "_hi", "n"))


def selected_k(events: DataFrame, low: int = 20, high: int = 60, target: int = 40,
               grid: Sequence[int] = K_GRID, universes: DataFrame | None = None) -> DataFrame:
    """The k whose eligible count lies in [20, 60] and is closest to 40; larger k on a tie.

    A universe without a feasible k keeps its row with a null choice.
    """
    per_k = events.groupBy("universe", "k").agg(F.count_if("eligible").alias("eligible_events"))
    feasible = F.when(F.col("eligible_events").between(low, high), F.col("k"))
    choice = per_k.groupBy("universe").agg(F.min_by(
        feasible, F.when(feasible.isNotNull(), F.struct(
            F.abs(F.col("eligible_events") - target).alias("gap"), (-F.col("k")).alias("neg"))))
        .alias("selected_k"))
    return universes.select("universe").join(choice, "universe", "left") \
        if universes is not None else choice
