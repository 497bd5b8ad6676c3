"""Event scoring with explicit denominators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import rank_scores


def scored_universe(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Event x asset rows to score: all assets if systemic, otherwise the non-origins."""
    keep = F.col("systemic") | ~F.array_contains("origins", F.col("asset"))
    return (events.filter("systemic is not null").join(assets, "universe").filter(keep)
            .select("universe", "t0", "asset", "ordinal", "tier"))


def risk_table_status(risk: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``usable``: every declared asset exactly once, 0 <= mdd <= 1, vol >= 0."""
    fine = F.col("mdd").between(0, 1) & (F.col("vol") >= 0)
    counted = (risk.groupBy(*keys).agg(F.count("*").alias("_rows"),
                                       F.count_distinct("asset").alias("_assets"),
                                       F.bool_and(F.coalesce(fine, F.lit(False))).alias("_fine"))
               .join(expected, "universe")
               .select(*keys, (F.col("_fine") & (F.col("_rows") == F.col("asset_count"))
                               & (F.col("_assets") == F.col("asset_count"))).alias("usable")))
    return counted


def metric_pairs(predicted: DataFrame, actual: DataFrame, universe: DataFrame) -> DataFrame:
    """Long (event, method, metric, asset) pairs of predicted ``p`` and actual ``a`` risk."""
    truth = actual.select("universe", "t0", "asset", F.col("mdd").alias("a_mdd"),
                          F.col("vol").alias("a_vol"))
    both = (predicted.join(truth, ["universe", "t0", "asset"])
            .join(universe, ["universe", "t0", "asset"]))
    return both.select(
        "universe", "t0", "asset", "tier", "ordinal", "method", F.explode(F.array(
            F.struct(F.lit("max_drawdown").alias("metric"), F.col("mdd").alias("p"),
                     F.col("a_mdd").alias("a")),
            F.struct(F.lit("volatility").alias("metric"), F.col("vol").alias("p"),
                     F.col("a_vol").alias("a")))).alias("_m")
    ).select("universe", "t0", "asset", "tier", "ordinal", "method", "_m.*")


def score_events(pairs: DataFrame, usable: DataFrame) -> DataFrame:
    """Per (event, method, metric) scores; unusable tables score as failed with null values."""
    keys = ["universe", "t0", "method"]
    scores = rank_scores(pairs.join(usable.filter("usable"), keys), [*keys, "metric"])
    grid = usable.withColumn("metric", F.explode(F.array(F.lit("max_drawdown"),
                                                         F.lit("volatility"))))
    return (grid.join(scores, [*keys, "metric"], "left")
            .withColumn("status", F.when(F.col("usable"), "scored").otherwise("failed"))
            .drop("usable"))


def common_paired(scores: DataFrame, methods: int) -> DataFrame:
    """Events that every method scored (relational division)."""
    return (scores.filter("status = 'scored'").groupBy("universe", "t0")
            .agg(F.count_distinct("method").alias("_m")).filter(F.col("_m") == methods)
            .select("universe", "t0"))


def label(column: str, group_id: Column, bit: int, text: str) -> Column:
    """Value of a grouping column, or the margin label where the set leaves it out."""
    return F.when(F.shiftright(group_id, bit).bitwiseAND(F.lit(1)) == 1, text) \
        .otherwise(F.col(column))
