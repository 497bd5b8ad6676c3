"""Baseline forecasters, user models, and the quality checks on forecast paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import paths
from .grid import finite

HORIZON = 30
BASELINES = ("historical_30", "no_propagation", "driver_beta")
FORECAST_SCHEMA = ("universe string, t0 bigint, asset string, method string, path_id int, "
                   "spot double, closes array<double>, error string")


def baseline_paths(windows: DataFrame, origins: DataFrame, assets: DataFrame) -> DataFrame:
    """historical_30, no_propagation and driver_beta for every (window, asset).

    ``origins`` has ``origins ARRAY<STRING>`` per (universe, t0); the driver is the first
    declared asset. A method that cannot be computed keeps its row with an error.
    """
    own = (windows.filter("status <> 'no_history'").drop("fut")
           .withColumn("r", paths.log_returns(F.col("hist")))
           .withColumn("spot", F.element_at("hist", -1)))
    first = assets.filter("ordinal = 0").select("universe", "asset")
    driver = own.join(first, ["universe", "asset"]).select("universe", "t0",
                                                          F.col("r").alias("rd"))
    tail = lambda c: F.slice(c, -HORIZON, HORIZON)
    flat = F.array_repeat(F.col("spot"), HORIZON)
    replayed = paths.replay(F.col("spot"), tail(F.col("r")))
    full = (own.join(driver, ["universe", "t0"])
            .join(origins.select("universe", "t0", "origins"), ["universe", "t0"])
            .withColumn("beta", paths.beta(F.col("r"), F.col("rd")))
            .withColumn("h30", replayed))
    driven = paths.replay(F.col("spot"),
                          F.transform(tail(F.col("rd")), lambda x: x * F.col("beta")))
    none = F.lit(None).cast("string")
    made = F.array(
        F.struct(F.lit("historical_30").alias("method"), F.col("h30").alias("closes"),
                 none.alias("error")),
        F.struct(F.lit("no_propagation").alias("method"),
                 F.when(F.array_contains("origins", F.col("asset")), F.col("h30"))
                 .otherwise(flat).alias("closes"), none.alias("error")),
        F.struct(F.lit("driver_beta").alias("method"),
                 F.when(F.col("beta").isNotNull(), driven).alias("closes"),
                 F.when(F.col("beta").isNull(), "driver variance is zero").alias("error")))
    return (full.select("universe", "t0", "asset", "spot", "beta", F.explode(made).alias("m"))
            .select("universe", "t0", "asset", "spot", "beta", "m.method", "m.closes",
                    "m.error"))


def naive_last(windows: DataFrame) -> DataFrame:
    """A constant close path at the spot, terminal return zero."""
    spot = F.element_at("hist", -1)
    return windows.filter("status <> 'no_history'").select(
        "universe", "t0", "asset", F.lit("naive_last").alias("method"), spot.alias("spot"),
        F.array_repeat(spot, HORIZON).alias("closes"), F.lit(None).cast("string").alias("error"))


def attempt(model: Callable[[dict[str, list[float]]], list[dict[str, list[float]]]],
            hist: dict[str, list[float]]) -> list[tuple]:
    """``asset, path_id, spot, closes, error`` of one window; an exception becomes one error row per asset."""
    try:
        return [(a, path_id, h[-1], [float(x) for x in path[a]], None)
                for path_id, path in enumerate(model(hist)) for a, h in hist.items()]
    except Exception as exc:  # noqa: BLE001 - a failed output is a result row
        return [(a, 0, h[-1] if h else None, None, f"{type(exc).__name__}: {exc}") for a, h in hist.items()]


def histories(windows: DataFrame) -> DataFrame:
    """One row per window: ``universe, t0, histories``, a map from asset to its closes up to the origin."""
    pair = F.struct("asset", "hist")
    return windows.filter("status <> 'no_history'").groupBy("universe", "t0").agg(
        F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("histories"))


def register_model(spark: SparkSession, model: Callable[[dict[str, list[float]]], list[dict[str, list[float]]]],
                   name: str) -> None:
    """Make a user model a table function of SQL, for ``FROM w, LATERAL name(w.histories)``.

    Its rows are ``asset, path_id, spot, closes, error``, as ``apply_model`` has them. The argument is
    checked when the statement is analysed. A null map and a window without assets give no rows.
    """
    wanted = T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))
    result = T.StructType.fromDDL("asset string, path_id int, spot double, closes array<double>, error string")

    class Paths:
        @staticmethod
        def analyze(histories: AnalyzeArgument) -> AnalyzeResult:
            if histories.isTable or histories.dataType.simpleString() != wanted.simpleString():
                raise ValueError(f"{name} takes a {wanted.simpleString()}, not a {histories.dataType and histories.dataType.simpleString()}")
            return AnalyzeResult(result)

        def eval(self, histories: dict[str, list[float]] | None) -> Iterator[tuple]:
            yield from attempt(model, {a: list(h) for a, h in (histories or {}).items()})

    spark.udtf.register(name, F.udtf(Paths, useArrow=True))


def apply_model(windows: DataFrame, model: Callable[[dict[str, list[float]]],
                                                    list[dict[str, list[float]]]],
                name: str) -> DataFrame:
    """Run a user model once per window: histories in, a list of asset -> closes paths out.

    The model sees histories only. Its exception becomes one error row per asset, so a failed
    window stays in every denominator. A group holds one window: its assets x 256 closes.
    """
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hist = {a: list(h) for a, h in zip(pdf["asset"], pdf["hist"])}
        rows = [(*key, asset, name, *rest) for asset, *rest in attempt(model, hist)]
        return pd.DataFrame(rows, columns=["universe", "t0", "asset", "method", "path_id",
                                           "spot", "closes", "error"])

    return (windows.filter("status <> 'no_history'").select("universe", "t0", "asset", "hist")
            .groupBy("universe", "t0").applyInPandas(run, FORECAST_SCHEMA))


def path_risk(forecasts: DataFrame) -> DataFrame:
    """Drawdown and volatility of each path; null with its error where there is no path."""
    spot, closes = F.col("spot"), F.col("closes")
    return (forecasts.withColumn("mdd", paths.max_drawdown(spot, closes))
            .withColumn("vol", paths.horizon_volatility(spot, closes)))


def structure_issue(paths_long: DataFrame, assets: Column, horizon: int, expected_paths: int | None = None) -> DataFrame:
    """Per forecast, the sorted list of structural problems (empty when usable).

    ``assets`` is the declared list of names of the row's forecast; ``expected_paths`` the number of
    paths that were asked for.
    """
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    bad = ~finite(prices[0])
    for p in (*prices[1:], F.col("volume"), F.col("amount")):
        bad = bad | ~finite(p)
    row = (F.when(bad, "not_finite").when(F.least(*prices) <= 0, "price_not_positive")
           .when(~F.col("step").between(1, horizon), "step_out_of_range"))
    size = F.size("_declared") * horizon
    wanted = F.lit(True) if expected_paths is None else F.col("n_paths") == expected_paths
    return (paths_long.withColumn("_issue", row).withColumn("_assets", assets)
            .groupBy("forecast_id")
            .agg(F.array_sort(F.collect_set("_issue")).alias("_rows"),
                 F.count("*").alias("rows"), F.count_distinct("path_id").alias("n_paths"),
                 F.count_distinct("path_id", "asset", "step").alias("cells"),
                 F.array_sort(F.collect_set("asset")).alias("_seen"), F.array_sort(F.first("_assets")).alias("_declared"))
            .withColumn("issues", F.concat("_rows", F.array_compact(F.array(
                F.when(F.col("_seen") != F.col("_declared"), "wrong_assets"),
                F.when(~wanted, "wrong_path_count"),
                F.when(F.col("cells") != F.col("n_paths") * size, "wrong_shape"),
                F.when(F.col("cells") != F.col("rows"), "duplicate_step")))))
            .drop("_rows", "cells", "_seen", "_declared"))


def repair_containment(rows: DataFrame) -> DataFrame:
    """``high``/``low`` widened to contain open and close; open and close stay untouched.

    The row keeps its original values and the adjustment in basis points of its own close.
    """
    o = [F.col(c) for c in ("open", "high", "low", "close")]
    high, low = F.greatest(*o), F.least(*o)
    up = (high - F.col("high")) / F.col("close") * 10000
    down = (F.col("low") - low) / F.col("close") * 10000
    return (rows.withColumn("original", F.struct("open", "high", "low", "close"))
            .withColumn("corrected", F.struct("open", high.alias("high"), low.alias("low"),
                                              "close"))
            .withColumn("was_corrected", (high != F.col("high")) | (low != F.col("low")))
            .withColumn("max_adjustment_bps", F.greatest(up, down))
            .withColumns({"high": high, "low": low}))


def volume_audit(rows: DataFrame) -> DataFrame:
    """Flags negative volume or amount; values are left as they are."""
    return rows.withColumn("volume_valid", (F.col("volume") >= 0) & (F.col("amount") >= 0))


def audit_differences(saved: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows present in only one of two audits; an intact audit gives no row."""
    cols = recomputed.columns
    return (saved.select(cols).exceptAll(recomputed).withColumn("side", F.lit("saved_only"))
            .unionByName(recomputed.exceptAll(saved.select(cols))
                         .withColumn("side", F.lit("recomputed_only"))))


def weighted_rate(rows: DataFrame, keys, numerator: Column, denominator: Column) -> DataFrame:
    """Sum over sum, never the mean of rates; null on an empty denominator."""
    return rows.groupBy(*keys).agg(
        F.sum(numerator).alias("hits"), F.sum(denominator).alias("total"),
        F.try_divide(F.sum(numerator), F.sum(denominator)).alias("rate"))


def audit_consistent(rate: Column, hits: Column, total: Column, status: Column,
                     tol: float = 1e-12) -> Column:
    """Does a stored rate and status agree with its own counts?"""
    agrees = F.when(total > 0, F.abs(rate - hits / total) <= tol).otherwise(rate.isNull())
    label = F.when(total == 0, "empty").when(hits == 0, "unchanged").otherwise("corrected")
    return agrees & (status == label)
