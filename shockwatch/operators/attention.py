"""Attention ranking: which assets to look at first, and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import competition_rank


def partition_attention(rows: DataFrame, limit: int = 3, keys=("universe", "idx"),
                        value: str = "vol30") -> DataFrame:
    """Rank by value, then symbol; the first ``limit`` are focused, the rest deferred.

    ``cutoff_tied`` marks the last focused row when the first deferred one has the same value.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(value), F.asc("asset"))
    return (rows.withColumn("rank", F.row_number().over(w))
            .withColumn("group", F.when(F.col("rank") <= limit, "focused").otherwise("deferred"))
            .withColumn("cutoff_tied", F.coalesce((F.col("rank") == limit)
                                                  & (F.lead(value).over(w) == F.col(value)),
                                                  F.lit(False))))


def alerts(rows: DataFrame, keys, drawdown_threshold: float = 0.03, top_k: int = 2) -> DataFrame:
    """Reasons an asset raises an alert: a large drawdown, or a high volatility rank."""
    return (rows.withColumn("rank", competition_rank(keys, "vol"))
            .withColumn("reasons", F.array_compact(F.array(
                F.when(F.col("mdd") > drawdown_threshold, "drawdown_above_threshold"),
                F.when(F.col("rank") <= top_k, "volatility_rank"))))
            .withColumn("alert", F.size("reasons") > 0))
