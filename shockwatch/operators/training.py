"""Training-segment export: look-back plus horizon, normalised by the past only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bandjoin import band_join
from .resample import draw
from .windows import HORIZON, LOOKBACK

FIELDS = ("open", "high", "low", "close", "volume", "amount")
CLIP = 5.0
EPSILON = 1e-5


def calendar_features(start: Column) -> dict[str, Column]:
    """Minute, hour, weekday (Monday 0), day and month of the bar's start."""
    return {"minute": F.minute(start), "hour": F.hour(start), "weekday": F.weekday(start),
            "day": F.dayofmonth(start), "month": F.month(start)}


def segments(origins: DataFrame, bars: DataFrame, step_seconds: Column) -> DataFrame:
    """One row per (sample, bar): normalised values ``z_*`` and calendar stamps.

    Mean and deviation come from the look-back alone, so the future never sets its own scale.
    """
    rows = band_join(origins.select("universe", "t0"),
                     bars.select("universe", "asset", F.col("idx").alias("_i"), "ts", *FIELDS),
                     ("universe",), -(LOOKBACK - 1), HORIZON, "t0", "_i",
                     bucket=LOOKBACK + HORIZON)
    whole = Window.partitionBy("universe", "t0", "asset")
    pos = (F.col("_i") - F.col("t0") + LOOKBACK).cast("int")
    past = F.col("pos") <= LOOKBACK
    out = rows.withColumn("pos", pos)

    def z(name: str) -> Column:
        seen = F.when(past, F.col(name))
        raw = (F.col(name) - F.avg(seen).over(whole)) / (F.stddev_pop(seen).over(whole) + EPSILON)
        return F.greatest(F.least(raw, F.lit(CLIP)), F.lit(-CLIP)).alias(f"z_{name}")

    stamps = calendar_features(F.timestamp_seconds(F.unix_timestamp("ts") - step_seconds))
    return out.select("universe", "t0", "asset", "pos", *[z(f) for f in FIELDS],
                      *[c.alias(k) for k, c in stamps.items()])


def shuffle_key(epoch: int, seed: int = 20260926) -> Column:
    """Deterministic sample order of an epoch."""
    return draw(seed, epoch, F.col("universe"), F.col("t0"), F.col("asset"))


def export(rows: DataFrame, path: str, epoch: int = 0) -> None:
    """Write samples as float32, clustered and sorted by the epoch's order; never overwrites."""
    cols = [F.col(c).cast("float").alias(c) if c.startswith("z_") else F.col(c)
            for c in rows.columns]
    (rows.select(*cols).withColumn("order_key", shuffle_key(epoch))
     .repartitionByRange("order_key").sortWithinPartitions("order_key", "pos")
     .write.mode("errorifexists").parquet(path))
