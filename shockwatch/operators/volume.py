"""Event volume against matched control windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bandjoin import band_join

CONTROL_CYCLES = 28
MIN_CONTROLS = 3
DETECTOR_START = 65


def weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def controls(events: DataFrame, volumes: DataFrame, triggers: DataFrame, spans: DataFrame,
             cycle: Column, context: int = 120) -> DataFrame:
    """The 28 earlier windows at the same place of the cycle, each with why it is rejected.

    ``cycle`` is the number of bars in a day (or another calendar cycle). Rejections are tested
    in order: outside the data, context reaching the event or the data's edge, detector not yet
    running, other weekday class, a trigger of any asset in the context, invalid volume.
    ``volumes`` comes from ``observed_volume``.
    """
    one = events.join(spans.select("universe", "n"), "universe").select(
        "universe", "t0", "n", F.col("ts").alias("event_ts"), cycle.alias("_cycle"))
    spread = (one.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(CONTROL_CYCLES))))
              .withColumn("c", F.col("t0") - F.col("back") * F.col("_cycle")))
    # A third of all events may share a control bar; the distinct bars are tested once.
    places = spread.filter("c >= 0").select("universe", "c").distinct()
    busy = band_join(places, triggers.select("universe", F.col("idx").alias("_t")),
                     ("universe",), -context, context, "c", "_t", how="left_semi") \
        .withColumn("shock", F.lit(True))
    stamps = volumes.select("universe", F.col("idx").alias("c"), "asset", "ts",
                            "volume_status", "volume_sum")
    rows = (spread.join(busy, ["universe", "c"], "left")
            .join(stamps, ["universe", "c"], "left"))
    reason = (F.when(F.col("c") < 0, "outside_authorized_data")
              .when((F.col("c") < context) | (F.col("c") + context >= F.col("t0")),
                    "context_boundary_insufficient")
              .when(F.col("c") - context < DETECTOR_START, "detector_coverage_unknown")
              .when(weekend(F.col("ts")) != weekend(F.col("event_ts")),
                    "weekday_weekend_mismatch")
              .when(F.col("shock"), "shock_within_control_context")
              .when(F.col("volume_status") != "valid",
                    F.concat(F.lit("control_"), "volume_status")))
    return rows.select("universe", "t0", "asset", "back", "c", "volume_sum",
                       reason.alias("rejected"))


def rejection_counts(control_rows: DataFrame) -> DataFrame:
    """Per event, rejected control positions by reason (asset-free reasons counted once)."""
    return (control_rows.filter("rejected is not null")
            .select("universe", "t0", "back", "rejected").distinct()
            .groupBy("universe", "rejected").agg(F.count("*").alias("n")))


def log_ratios(events: DataFrame, volumes: DataFrame, control_rows: DataFrame) -> DataFrame:
    """Per (event, asset): log of the 30-bar volume over the median of its valid controls."""
    good = (control_rows.filter("rejected is null").groupBy("universe", "t0", "asset")
            .agg(F.count("*").alias("n_controls"), F.median("volume_sum").alias("control_median")))
    own = (events.select("universe", "t0")
           .join(volumes.select("universe", F.col("idx").alias("t0"), "asset", "volume_status",
                                "volume_sum"), ["universe", "t0"])
           .join(good, ["universe", "t0", "asset"], "left").fillna({"n_controls": 0}))
    enough = F.col("n_controls") >= MIN_CONTROLS
    base = F.when(enough, F.col("control_median"))
    reasons = F.array_compact(F.array(
        F.when(F.col("volume_status") != "valid", F.concat(F.lit("event_"), "volume_status")),
        F.when(~enough, "fewer_than_3_controls"),
        F.when(base <= 0, "zero_control_baseline"),
        F.when(F.col("volume_sum") <= 0, "zero_event_volume")))
    return (own.withColumn("control_median", base).withColumn("reasons", reasons)
            .withColumn("log_ratio", F.when(F.size("reasons") == 0, F.log("volume_sum")
                                            - F.log("control_median"))))


def tier_ratios(ratios: DataFrame, assets: DataFrame) -> DataFrame:
    """Mean over the tier; one excluded asset excludes the event-tier."""
    return (ratios.join(assets.select("universe", "asset", "tier"), ["universe", "asset"])
            .groupBy("universe", "t0", "tier")
            .agg(F.when(F.count("log_ratio") == F.count("*"), F.avg("log_ratio"))
                 .alias("mean_log_ratio")))
