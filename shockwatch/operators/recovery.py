"""How long volatility stays up after a shock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bandjoin import band_join
from .quantiles import exact_quantiles

HORIZON = 120
BASE_START = 125
LEVEL = 1.2
RUN = 10


def decay_ratios(events: DataFrame, bars: DataFrame, spans: DataFrame) -> DataFrame:
    """Per (event, asset, h in 0..120) the 10-return deviation over its pre-shock baseline.

    The baseline is the deviation of the 120 returns that end five bars before the shock; both
    are scaled by the root of ten. A zero baseline leaves the ratio null. Events without the
    full context are dropped here and reported by ``decay_status``.
    """
    ready = (events.select("universe", "t0").join(spans.select("universe", "n"), "universe")
             .filter((F.col("t0") >= BASE_START) & (F.col("t0") + HORIZON < F.col("n"))).drop("n"))
    near = band_join(ready, bars.select("universe", "asset", F.col("idx").alias("_i"), "close"),
                     ("universe",), -BASE_START, HORIZON, "t0", "_i")
    whole = Window.partitionBy("universe", "t0", "asset")
    run = whole.orderBy("o")
    scale = F.sqrt(F.lit(RUN))
    base = F.stddev_pop(F.when(F.col("o").between(-BASE_START + 1, -5), F.col("r"))).over(whole)
    return (near.withColumn("o", (F.col("_i") - F.col("t0")).cast("int"))
            .withColumn("r", F.log("close") - F.log(F.lag("close").over(run)))
            .withColumn("recent", F.stddev_pop("r").over(run.rowsBetween(-(RUN - 1), 0)) * scale)
            .withColumn("baseline", base * scale)
            .filter("o >= 0")
            .select("universe", "t0", "asset", F.col("o").alias("h"), "baseline", "recent",
                    F.try_divide("recent", "baseline").alias("ratio")))


def decay_status(t0: Column, n: Column) -> Column:
    return F.when((t0 < BASE_START) | (t0 + HORIZON >= n), "boundary_insufficient") \
        .otherwise("available")


def tier_curves(ratios: DataFrame, assets: DataFrame) -> DataFrame:
    """Median across the tier's assets at each h; one zero baseline excludes the event-tier."""
    return (ratios.join(assets.select("universe", "asset", "tier"), ["universe", "asset"])
            .groupBy("universe", "t0", "tier", "h")
            .agg(F.when(F.count("ratio") == F.count("*"), F.median("ratio")).alias("ratio"))
            .filter("ratio is not null"))


def confirmations(curves: DataFrame, keys=("universe", "t0", "tier"), value: str = "ratio",
                  pos: str = "h") -> DataFrame:
    """First h at which the value has been at or below 1.2 for ten points in a row, else null."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-(RUN - 1), 0)
    calm = (F.col(value) <= LEVEL).cast("int")
    return (curves.withColumn("_run", F.sum(calm).over(w)).groupBy(*keys)
            .agg(F.min(F.when(F.col("_run") == RUN, F.col(pos))).alias("confirmed_at"),
                 F.count("*").alias("points")))


def streaks(curves: DataFrame, keys=("universe", "t0", "tier"), pos: str = "h") -> DataFrame:
    """At each revealed point: current calm streak, confirmed now, and ever confirmed before."""
    order = Window.partitionBy(*keys).orderBy(pos)
    calm = F.col("ratio") <= LEVEL
    broken = F.max(F.when(~calm, F.col(pos))).over(order)
    return (curves.withColumn("streak", F.when(calm, F.col(pos) - F.coalesce(broken, F.lit(-1)))
                              .otherwise(0))
            .withColumn("confirmed", F.col("streak") >= RUN)
            .withColumn("had_confirmed", F.max("confirmed").over(order)))


def censored_median(confirmed: DataFrame, keys) -> DataFrame:
    """Order statistic ceil(n / 2) over all curves; null when it falls among the censored.

    Confirmation times are integers of 0..120, so they are counted, not sorted.
    """
    keys = list(keys)
    counted = confirmed.groupBy(*keys, "confirmed_at").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("confirmed_at")))
    return (counted.withColumn("_upto", upto)
            .withColumn("_n", F.sum("c").over(Window.partitionBy(*keys)))
            .groupBy(*keys)
            .agg(F.max("_n").alias("n"),
                 F.coalesce(F.sum(F.when(F.col("confirmed_at").isNotNull(), F.col("c"))),
                            F.lit(0)).alias("n_confirmed"),
                 F.min(F.when(F.col("_upto") >= F.floor((F.col("_n") + 1) / 2),
                              F.coalesce("confirmed_at", F.lit(9999)))).alias("_m"))
            .withColumn("n_censored", F.col("n") - F.col("n_confirmed"))
            .withColumn("median_minutes", F.when(F.col("_m") < 9999, F.col("_m"))).drop("_m"))


def median_curve(curves: DataFrame, keys=("universe", "tier", "h")) -> DataFrame:
    """Median over all events at each h, exact for any number of events."""
    return exact_quantiles(curves, keys, "ratio", [0.5]).withColumnRenamed("value", "ratio") \
        .drop("q")
