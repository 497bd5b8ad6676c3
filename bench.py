"""Headline queries, each from raw tables, on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from pyspark.sql import functions as F  # noqa: E402

from shockwatch.operators import grid, windows  # noqa: E402
from shockwatch.plans import catalog, hub  # noqa: E402
from shockwatch.session import build_session, materialize, run_dir  # noqa: E402
from shockwatch.sources import klines, tables  # noqa: E402

HEADLINE = ("a1_attention_top3", "w5_j11_g7_events", "b1_b5_baseline_risk", "a8_a19_j6_summary",
            "a28_a29_edges", "j15_o3_f11_nearest", "a31_recovery_curves", "a11_f31_error_stats",
            "a41_day_bootstrap", "a45_shift_null")


MINUTES, ASSETS = 44_640, 3  # a month of minutes: the shape of the published load, window and truth job
MONTH = "2025-01"


def month_files(spark, sf_dir: str) -> str:
    """A month of minute bars of three assets from the line items, landed as kline CSV files (not timed)."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.xxhash64("l_orderkey", "l_linenumber")
    ticks = items.select(
        F.lit("minutes").alias("universe"), F.format_string("A%s", F.pmod(key, F.lit(ASSETS))).alias("asset"),
        F.pmod(F.shiftright(key, 8), F.lit(MINUTES)).alias("cell"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("double").alias("volume"), F.col("l_extendedprice").alias("amount"), key.alias("seq"))
    cells = materialize(tables.cells(ticks), "bench-cells")
    spans = spark.createDataFrame([("minutes", 0, MINUTES - 1)], "universe string, lo bigint, hi bigint")
    start = 1_735_689_600_000_000 + F.col("cell") * klines.MINUTE_US
    bars = grid.densify(cells, spans).select(
        F.concat_ws(",", start, "open", "high", "low", "close", "volume", start + klines.MINUTE_US - 1, "amount",
                    *[F.lit("0")] * 4).alias("value"), "asset")
    path = f"{run_dir(spark)}/bench-month"
    bars.repartition("asset").write.partitionBy("asset").text(path)
    return path


def month_job(spark, path: str) -> int:
    """Load and validate the month, cut rolling windows and compute their realised risk; the number of bars."""
    bars = klines.parse(klines.scan(spark, path, r"asset=(A\d)/()")).withColumn("universe", F.lit("minutes")).withColumn(
        "idx", ((F.col("open_us") - 1_735_689_600_000_000) / klines.MINUTE_US).cast("long")).filter("reason is null")
    truth = windows.truth_risk(windows.rolling_windows(bars))
    truth.write.format("noop").mode("overwrite").save()
    return MINUTES * ASSETS


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "16g",
                             "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    path = month_files(spark, sf_dir)
    month_job(spark, path)  # warm-up: code is compiled, workers and files are there
    catalog.QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, rates = {}, {}
    start = time.perf_counter()
    bars = month_job(spark, path)
    times["month_load_window_truth"] = round(time.perf_counter() - start, 3)
    rates["month_load_window_truth"] = round(bars / times["month_load_window_truth"])
    count = hub.Hub(spark, sf_dir).bars.count()
    for name in HEADLINE:
        hub.clear()  # no stored table of an earlier query helps a later one
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        rates[name] = round(count / times[name])
    spark.stop()
    print(json.dumps({"metric": "headline queries from raw tables, total", "unit": "sec",
                      "value": round(sum(times.values()), 3), "queries": times, "bars_per_sec": rates,
                      "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
