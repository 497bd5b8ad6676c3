"""Ranking with an explicit tie rule. Groups are the assets of one origin, a few rows each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_weights(df: DataFrame, keys: Sequence[str], value: str, out: str, k: int = 3
                ) -> DataFrame:
    """Uniform cutoff weights: 1 above the k-th value, the free share at it, 0 below.

    Also adds ``out_tied`` (rows at the cutoff) and ``out_crosses`` (the tie straddles k).
    """
    g = Window.partitionBy(*keys)
    v, rn = F.col(value), F.row_number().over(g.orderBy(F.desc(value)))
    return (df.withColumn("_rn", rn)
            .withColumn("_k", F.least(F.lit(k), F.count("*").over(g)))
            .withColumn("_cut", F.max(F.when(F.col("_rn") == F.col("_k"), v)).over(g))
            .withColumn("_above", F.count_if(v > F.col("_cut")).over(g))
            .withColumn(f"{out}_tied", F.count_if(v == F.col("_cut")).over(g))
            .withColumn(out, F.when(v > F.col("_cut"), 1.0).when(
                v == F.col("_cut"), (F.col("_k") - F.col("_above")) / F.col(f"{out}_tied"))
                .otherwise(0.0))
            .withColumn(f"{out}_crosses", (F.col("_above") < F.col("_k"))
                        & (F.col("_above") + F.col(f"{out}_tied") > F.col("_k")))
            .drop("_rn", "_k", "_cut", "_above"))


def average_rank(keys: Sequence[str], value: str) -> Column:
    """Ascending rank, ties sharing the mean of the places they occupy."""
    lowest = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return lowest + (ties - 1) / 2.0


def competition_rank(keys: Sequence[str], value: str) -> Column:
    """One plus the number of strictly greater values; ties may over-select a top k."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(value)))


def declared_rank(keys: Sequence[str], value: str, tie: str) -> Column:
    """Deterministic place: larger value first, then the tie column."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(tie)))


def rank_scores(pairs: DataFrame, keys: Sequence[str], predicted: str = "p", actual: str = "a",
                k: int = 3) -> DataFrame:
    """Per group: mean error, expected top-k recall, average-tie rank correlation with reason."""
    keys = list(keys)
    both = top_weights(top_weights(pairs, keys, predicted, "_wp", k), keys, actual, "_wa", k)
    ranked = (both.withColumn("_rp", average_rank(keys, predicted))
              .withColumn("_ra", average_rank(keys, actual)))
    flat_p, flat_a = F.min(predicted) == F.max(predicted), F.min(actual) == F.max(actual)
    kk = F.least(F.lit(k), F.count("*"))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("asset_count"),
        F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mae"),
        (F.sum(F.col("_wp") * F.col("_wa")) / kk).alias("recall"),
        (kk / F.count("*")).alias("chance"),
        F.max("_wp_tied").alias("predicted_tied"), F.max("_wa_tied").alias("actual_tied"),
        F.bool_or("_wp_crosses").alias("predicted_crosses"),
        F.bool_or("_wa_crosses").alias("actual_crosses"),
        F.when(flat_p & flat_a, "constant_prediction_and_actual").when(
            flat_p, "constant_prediction").when(flat_a, "constant_actual").alias("reason"),
        F.when(~flat_p & ~flat_a, F.greatest(F.least(F.try_divide(
            F.covar_pop("_rp", "_ra"), F.stddev_pop("_rp") * F.stddev_pop("_ra")), F.lit(1.0)),
            F.lit(-1.0))).alias("spearman"))
