"""Exact linear-interpolation quantiles of groups too large for one task.

``percentile`` keeps every distinct value of a group in one buffer. Here a sketch only proposes
cut points; values are counted per (group, slice), and just the slices that hold a wanted order
statistic are ranked. Equal values are merged first, so a value held by a third of all rows is
one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dimension

SLICES = 64


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
                    slices: int = SLICES) -> DataFrame:
    """``keys, q, value`` with the (n - 1) q interpolation; nulls are left out."""
    keys = list(keys)
    counted = (df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
               .groupBy(*keys, "_v").agg(F.count("*").alias("_c")))
    cuts = dimension(df.groupBy(*keys).agg(
        F.count(value).alias("_n"),
        F.percentile_approx(value, [i / slices for i in range(1, slices)], 10_000).alias("_cuts"))
        .filter("_n > 0"), "cuts")
    place = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    sliced = counted.join(cuts, keys).withColumn("_s", place).drop("_cuts")
    hist = sliced.groupBy(*keys, "_s").agg(F.sum("_c").alias("_m"), F.max("_n").alias("_n"))
    upto = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_s"))
    at = (F.col("_n") - 1) * F.col("q")
    low = F.floor(at)
    wanted = (hist.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_m"))
              .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
              .withColumn("_frac", at - low)
              .withColumn("_rank", F.explode(F.array_distinct(F.array(
                  low, F.least(low + 1, F.col("_n") - 1)))))
              .withColumn("_is_low", F.col("_rank") == low)
              .filter((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
              .select(*keys, "_s", "q", "_frac", "_is_low",
                      (F.col("_rank") - F.col("_start")).alias("_local")))
    inside = Window.partitionBy(*keys, "_s").orderBy("_v")
    ranked = (sliced.join(wanted.select(*keys, "_s").distinct(), [*keys, "_s"], "left_semi")
              .withColumn("_hi", F.sum("_c").over(inside))
              .withColumn("_lo", F.col("_hi") - F.col("_c")))
    hit = (F.col("_local") >= F.col("_lo")) & (F.col("_local") < F.col("_hi"))
    weight: Column = F.when(F.col("_is_low"), 1 - F.col("_frac")).otherwise(F.col("_frac"))
    alone = F.count("*").over(Window.partitionBy(*keys, "q")) == 1
    return (ranked.join(wanted, [*keys, "_s"]).filter(hit)
            .withColumn("_w", F.when(alone, 1.0).otherwise(weight))
            .groupBy(*keys, "q").agg(F.sum(F.col("_v") * F.col("_w")).alias("value")))
