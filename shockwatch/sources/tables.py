"""Bars from the sample tables: ticks, one aggregation to cells, a dense clipped grid.

Test and benchmark adapter. Three universes: event types by hour, line items by flag/status and
day, orders by priority and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Line items may repeat a (key, line) pair; the part decides their order inside one long.
TIE_BREAK = 2**20
INTERVALS = {"events": 3600, "lineitem": 86400, "orders": 86400}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tick(df: DataFrame, universe: str, asset, at, price, volume, amount, seq) -> DataFrame:
    step = INTERVALS[universe]
    return df.select(F.lit(universe).alias("universe"), asset.alias("asset"),
                     F.floor(F.unix_timestamp(at) / step).cast("long").alias("cell"),
                     price.alias("price"), volume.cast("double").alias("volume"),
                     amount.alias("amount"), seq.cast("long").alias("seq"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trade-like record; ``seq`` orders the records inside a cell."""
    c = F.col
    events = _tick(table(spark, sf_dir, "events"), "events", c("event_type"), c("ts"),
                   c("value"), F.lit(1.0), c("value"), c("event_id"))
    items = _tick(table(spark, sf_dir, "lineitem"), "lineitem",
                  F.concat("l_returnflag", "l_linestatus"), c("l_shipdate"),
                  c("l_extendedprice") / c("l_quantity"), c("l_quantity"),
                  c("l_extendedprice"), (c("l_orderkey") * 8 + c("l_linenumber")) * TIE_BREAK
                  + F.pmod("l_partkey", F.lit(TIE_BREAK)))
    orders = _tick(table(spark, sf_dir, "orders"), "orders", c("o_orderpriority"),
                   c("o_orderdate"), c("o_totalprice"), F.lit(1.0), c("o_totalprice"),
                   c("o_orderkey"))
    return events.unionByName(items).unionByName(orders)


def cells(tick_rows: DataFrame) -> DataFrame:
    """Partial aggregation of ticks to OHLCVA cells.

    Ticks are ordered by one long: an ordering struct would force the sort aggregate, while every
    buffer here is primitive, so the hash aggregate stays in codegen and only one row per
    (asset, cell, task) is shuffled.
    """
    return (tick_rows.filter("price > 0")
            .groupBy("universe", "asset", "cell")
            .agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
                 F.sum("volume").alias("volume"), F.sum("amount").alias("amount")))


def stamp(bars: DataFrame) -> DataFrame:
    """Adds ``ts``, the end of each bar (exclusive right edge)."""
    step = F.create_map(*[F.lit(x) for pair in INTERVALS.items() for x in pair])
    return bars.withColumn("ts", F.timestamp_seconds(
        (F.col("cell") + 1) * F.element_at(step, F.col("universe"))))


def period(universe: Column, ts: Column) -> Column:
    """Reporting stratum: the month of hourly bars, the year of daily bars."""
    return F.when(universe == "events", F.date_format(ts, "yyyy-MM")) \
        .otherwise(F.date_format(ts, "yyyy"))
