"""Shape of the path after a shock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_shape
from .bandjoin import band_join

REFERENCE = 5
SPAN = 60


def composite_paths(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Mean log price of all tied origins against their close five bars before, h = 0..60."""
    origins = events.select("universe", "t0", F.explode("origins").alias("asset"))
    closes = bars.select("universe", "asset", F.col("idx").alias("_i"), "close")
    ref = origins.join(closes.select("universe", "asset", (F.col("_i") + REFERENCE).alias("t0"),
                                     F.col("close").alias("ref")), ["universe", "asset", "t0"])
    near = band_join(ref, closes, ("universe", "asset"), 0, SPAN, "t0", "_i")
    point = F.struct("h", "y")
    return (near.groupBy("universe", "t0", (F.col("_i") - F.col("t0")).alias("h"))
            .agg(F.avg(F.log(F.col("close") / F.col("ref"))).alias("y"))
            .groupBy("universe", "t0")
            .agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["y"]).alias("y")))


def event_shapes(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Every event with its shape; one without the full 65 bars is ``incomplete_60m``."""
    return (events.select("universe", "t0", "direction")
            .join(composite_paths(events, bars), ["universe", "t0"], "left")
            .withColumn("shape", path_shape(F.col("y"), F.col("direction"))))
