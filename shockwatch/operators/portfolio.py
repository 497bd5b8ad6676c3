"""Portfolio value along forecast paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import max_drawdown

KEYS = ["universe", "t0"]


def equal_weights(spots: DataFrame) -> DataFrame:
    return spots.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(*KEYS)))


def weight_issue(weights: DataFrame) -> DataFrame:
    """Portfolios that are not long-only or whose weights do not sum to one."""
    return (weights.groupBy(*KEYS).agg(F.min("weight").alias("low"), F.sum("weight").alias("total"))
            .filter("low < 0 or abs(total - 1) > 1e-12"))


def holdings(weights: DataFrame, capital: float) -> DataFrame:
    """Quantities fixed once, at the conversion prices."""
    return weights.withColumn("quantity", F.lit(capital) * F.col("weight") / F.col("spot"))


def path_values(forecasts: DataFrame, held: DataFrame) -> DataFrame:
    """Value per step summed over assets, then return, profit and drawdown of each path."""
    rows = (forecasts.select(*KEYS, "asset", "path_id", F.posexplode("closes").alias("step", "close"))
            .join(held.select(*KEYS, "asset", "quantity", "spot"), [*KEYS, "asset"])
            .groupBy(*KEYS, "path_id", "step")
            .agg(F.sum(F.col("quantity") * F.col("close")).alias("value"),
                 F.sum(F.col("quantity") * F.col("spot")).alias("start")))
    packed = (rows.groupBy(*KEYS, "path_id")
              .agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("_v"),
                   F.max("start").alias("start"))
              .withColumn("values", F.transform("_v", lambda x: x["value"])))
    final: Column = F.element_at("values", -1)
    return packed.select(*KEYS, "path_id", "start", "values", final.alias("final_value"),
                         (final - F.col("start")).alias("pnl"),
                         (final / F.col("start") - 1).alias("terminal_return"),
                         max_drawdown(F.col("start"), F.col("values")).alias("mdd"))


def contributions(forecasts: DataFrame, held: DataFrame) -> DataFrame:
    """Profit of each asset on each path."""
    return (forecasts.join(held.select(*KEYS, "asset", "quantity"), [*KEYS, "asset"])
            .select(*KEYS, "path_id", "asset",
                    (F.col("quantity") * (F.element_at("closes", -1) - F.col("spot"))).alias("pnl")))
