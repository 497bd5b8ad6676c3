"""Grid construction and validation of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .halo import CHUNK, chunk_window, drop_halo, with_halo

KEYS = ("universe", "asset")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def bar_reason(c=F.col) -> Column:
    """The first violated bar rule, or null for a valid bar."""
    prices = [c(name) for name in ("open", "high", "low", "close")]
    every = [*prices, c("volume"), c("amount")]
    bad = ~finite(every[0])
    for value in every[1:]:
        bad = bad | ~finite(value)
    low_price = F.least(*prices) <= 0
    return (F.when(bad, "not_finite")
            .when(low_price, "price_not_positive")
            .when((c("volume") < 0) | (c("amount") < 0), "negative_volume")
            .when((c("low") > F.least(c("open"), c("close")))
                  | (c("high") < F.greatest(c("open"), c("close"))), "ohlc_containment")
            .when((c("volume") == 0) != (c("amount") == 0), "zero_volume_mismatch"))


def split_valid(bars: DataFrame, reason: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Good bars and rejected bars with their reason; rejected rows are never repaired."""
    marked = bars.withColumn("reason", bar_reason() if reason is None else reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def common_interval(per_asset: DataFrame) -> DataFrame:
    """``universe, lo, hi, n``: latest first cell to earliest last cell of the universe."""
    return (per_asset.groupBy("universe")
            .agg(F.max("first").alias("lo"), F.min("last").alias("hi"),
                 F.count("*").alias("asset_count"))
            .withColumn("n", F.col("hi") - F.col("lo") + 1))


def ordered_assets(pairs: DataFrame) -> DataFrame:
    """Ordered universe with a two-value tier: the first half (rounded up) is ``major``."""
    order = Window.partitionBy("universe").orderBy("asset")
    everyone = Window.partitionBy("universe")
    return (pairs.withColumn("ordinal", F.row_number().over(order) - 1)
            .withColumn("tier", F.when(F.col("ordinal") < F.ceil(F.count("*").over(everyone) / 2),
                                       "major").otherwise("small")))


def next_position(df: DataFrame, pos: str, out: str, chunk: int = CHUNK, keys=KEYS) -> DataFrame:
    """Next position of the same key, without a window over the whole key.

    Inside a chunk by ``lead``; the last row of a chunk takes the first position of the next
    chunk that has rows, found on one row per chunk.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(pos) / chunk).cast("long"))
    heads = chunked.groupBy(*keys, "_chunk").agg(F.min(pos).alias("_head"))
    following = heads.select(*keys, "_chunk", F.lead("_head").over(
        Window.partitionBy(*keys).orderBy("_chunk")).alias("_next_head"))
    return (chunked.withColumn("_lead", F.lead(pos).over(chunk_window(keys, pos)))
            .join(following, [*keys, "_chunk"], "left")
            .withColumn(out, F.coalesce("_lead", "_next_head"))
            .drop("_lead", "_next_head", "_chunk"))


def densify(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Clip to the common interval and carry the last close over empty cells.

    Carried bars have volume and amount 0 and ``synthetic`` true. Each cell generates its own
    run of carried rows, so no calendar spine is joined.
    """
    run = F.sequence(F.greatest("cell", "lo"),
                     F.least(F.coalesce(F.col("next") - 1, F.col("hi")), F.col("hi")))
    live = (F.col("cell") <= F.col("hi")) & (F.coalesce("next", F.col("hi") + 1) > F.col("lo"))
    rows = (next_position(cells, "cell", "next").join(spans.select("universe", "lo", "hi"),
                                                      "universe")
            .filter(live).withColumn("at", F.explode(run)))
    fresh = F.col("at") == F.col("cell")

    def price(name: str) -> Column:
        return F.when(fresh, F.col(name)).otherwise(F.col("close")).alias(name)

    return rows.select(*KEYS, (F.col("at") - F.col("lo")).alias("idx"), F.col("at").alias("cell"),
                       price("open"), price("high"), price("low"), F.col("close"),
                       F.when(fresh, F.col("volume")).otherwise(0.0).alias("volume"),
                       F.when(fresh, F.col("amount")).otherwise(0.0).alias("amount"),
                       (~fresh).alias("synthetic"))


def continuity(rows: DataFrame, pos: str = "cell") -> DataFrame:
    """Steps that are not exactly one interval: ``gap`` with its length, or ``duplicate``."""
    counted = rows.groupBy(*KEYS, pos).agg(F.count("*").alias("copies"))
    steps = next_position(counted, pos, "next")
    return (steps.withColumn("missing", F.col("next") - F.col(pos) - 1)
            .withColumn("issue", F.when(F.col("copies") > 1, "duplicate")
                        .when(F.col("missing") > 0, "gap"))
            .filter("issue is not null"))


def misaligned(rows: DataFrame, spans: DataFrame, pos: str = "cell") -> DataFrame:
    """Positions inside the common interval at which not every asset has a bar."""
    return (rows.join(spans, "universe").filter(F.col(pos).between(F.col("lo"), F.col("hi")))
            .groupBy("universe", pos)
            .agg(F.count_distinct("asset").alias("assets"),
                 F.first("asset_count").alias("expected"))
            .filter("assets <> expected"))


def closed_cutoff(clock: Column, seconds: int) -> Column:
    """Floor the clock to the interval; bars ending later are still open."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(clock) / seconds) * seconds)


def staleness(now: Column, as_of: Column, feed_error: Column, limit_seconds: int = 180
              ) -> tuple[Column, Column]:
    """Age in seconds, never negative, and the stale flag (too old, or the feed failed)."""
    age = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(as_of), F.lit(0))
    return age, (age > limit_seconds) | F.coalesce(feed_error, F.lit(False))


def non_overlap(origins: DataFrame, horizon: int, keys=("universe",), pos: str = "origin"
                ) -> DataFrame:
    """Consecutive origins closer than the horizon (their future windows overlap): the later one."""
    near = next_position(origins, pos, "_next", keys=keys)
    return (near.withColumn("spacing", F.col("_next") - F.col(pos)).filter(F.col("spacing") < horizon)
            .withColumn(pos, F.col("_next")).drop("_next"))


def attention_issue(c=F.col) -> Column:
    """Input rules of the attention ranking for one (window, asset) row."""
    copies = F.count("*").over(Window.partitionBy("universe", "idx", "asset"))
    return (F.when(~c("asset").rlike("^[A-Z][A-Z0-9]*$"), "bad_symbol")
            .when(~finite(c("vol30")) | (c("vol30") < 0), "bad_volatility")
            .when(copies > 1, "duplicate_symbol"))


def observed_volume(bars: DataFrame, rows: int = 30) -> DataFrame:
    """Sum over the trailing 30 bars, present only if all 30 are valid observations.

    ``explicit_invalid`` comes from an upstream flag when there is one (``volume_flag``).
    """
    flagged = F.col("volume_flag") if "volume_flag" in bars.columns else F.lit(False)
    fine = (finite(F.col("volume")) & finite(F.col("amount")) & (F.col("volume") >= 0)
            & (F.col("amount") >= 0) & ((F.col("volume") == 0) == (F.col("amount") == 0)))
    near = chunk_window(KEYS).rowsBetween(-(rows - 1), 0)
    full = F.count("*").over(near) == rows
    return drop_halo(
        with_halo(bars, back=rows - 1)
        .withColumn("explicit_invalid", F.bool_or(flagged).over(near))
        .withColumn("inferred_invalid", ~F.bool_and(fine).over(near))
        .withColumn("_sum", F.sum("volume").over(near))
        .withColumn("volume_status", F.when(~full, "boundary_insufficient")
                    .when(F.col("explicit_invalid") | F.col("inferred_invalid"), "volume_invalid")
                    .otherwise("valid"))
        .withColumn("volume_sum", F.when(F.col("volume_status") == "valid", F.col("_sum")))
        .drop("_sum"))
