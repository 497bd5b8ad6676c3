"""Rolling features of bars. All deviations are population deviations; frames are by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from .grid import KEYS
from .halo import chunk_window, drop_halo, with_halo

HORIZON = 30
LOOKBACK = 256
SHOCK_LAG = 5
SHOCK_FRAME = 60
STATE_RECENT = 10
STATE_BASE = 120
STATE_LEVEL = 1.2


def full_frame(value: Column, over: Column, length: int, frame) -> Column:
    """``value`` only where the frame holds ``length`` defined inputs."""
    return F.when(F.count(over).over(frame) == length, value)


def returns(bars: DataFrame) -> DataFrame:
    """Adds the one-step log return ``r``."""
    w = chunk_window(KEYS)
    return drop_halo(with_halo(bars, back=1).withColumn(
        "r", F.log("close") - F.log(F.lag("close").over(w))))


def volatility_state(ratio: Column) -> Column:
    return F.when(ratio >= STATE_LEVEL, "above_usual").otherwise("near_usual")


def rolling_drawdown(df: DataFrame, length: int, over: WindowSpec, value: str = "close", out: str = "mdd") -> DataFrame:
    """Largest fall below the running peak in the last ``length`` rows; null where the frame is not full.

    A stretch of rows is (highest, lowest, worst fall), and two stretches, the later one starting not
    before the earlier one and ending not before it, combine into one: the worst fall is that of either,
    or from the earlier one's highest to the later one's lowest. They may overlap, so stretches double
    until one more step of what is missing fills the frame: log2(length) lags on one ordering, no list.
    """
    parts = ("_high", "_low", "_worst")
    df = df.withColumns({"_high": F.col(value), "_low": F.col(value), "_worst": F.lit(0.0)})
    covered = 1
    while covered < length:
        step = min(covered, length - covered)
        df = df.withColumns({f"{c}0": F.lag(c, step).over(over) for c in parts})
        fall = (F.col("_high0") - F.col("_low")) / F.col("_high0")
        df = df.withColumns({"_worst": F.greatest("_worst0", "_worst", fall), "_high": F.greatest("_high0", "_high"),
                             "_low": F.least("_low0", "_low")})
        covered += step
    full = full_frame(F.col("_worst"), F.col(value), length, over.rowsBetween(-(length - 1), 0))
    return df.withColumn(out, full).drop(*parts, *[f"{c}0" for c in parts])


def snapshot(bars: DataFrame, long_frame: bool = True) -> DataFrame:
    """Past-30 volatility, drawdown and return, the 10/120 state and the 255-return volatility.

    One chunk shuffle serves every frame.
    """
    back = LOOKBACK - 1 if long_frame else STATE_BASE
    w = chunk_window(KEYS)
    last = w.rowsBetween(-(HORIZON - 1), 0)
    recent = w.rowsBetween(-(STATE_RECENT - 1), 0)
    base = w.rowsBetween(-(STATE_BASE - 1), 0)
    r = F.col("r")
    df = (with_halo(bars, back=back)
          .withColumn("r", F.log("close") - F.log(F.lag("close").over(w)))
          .withColumn("vol30", full_frame(F.stddev_pop("r").over(last) * F.sqrt(F.lit(HORIZON)),
                                          r, HORIZON, last))
          .withColumn("ret30", F.col("close") / F.lag("close", HORIZON).over(w) - 1)
          .withColumn("_recent", full_frame(F.stddev_pop("r").over(recent), r, STATE_RECENT,
                                            recent))
          .withColumn("_base", full_frame(F.stddev_pop("r").over(base), r, STATE_BASE, base)))
    if long_frame:
        longest = w.rowsBetween(-(LOOKBACK - 2), 0)
        df = df.withColumn("vol255", full_frame(
            F.stddev_pop("r").over(longest) * F.sqrt(F.lit(HORIZON)), r, LOOKBACK - 1, longest))
    return (drop_halo(rolling_drawdown(df, HORIZON + 1, w, out="mdd30"))
            .withColumn("ratio", F.try_divide("_recent", "_base"))
            .withColumn("state", F.when(F.col("ratio").isNotNull(),
                                        volatility_state(F.col("ratio"))).otherwise("unavailable"))
            .withColumn("reason", F.when(F.col("_base").isNull(), "insufficient_history")
                        .when(F.col("_base") == 0, "zero_baseline"))
            .drop("_recent", "_base"))


def shock_signal(bars: DataFrame) -> DataFrame:
    """``r5`` and the deviation of the 60 previous ``r5`` values, the current one excluded."""
    w = chunk_window(KEYS)
    frame = w.rowsBetween(-SHOCK_FRAME, -1)
    return drop_halo(
        with_halo(bars, back=SHOCK_FRAME + SHOCK_LAG)
        .withColumn("r5", F.log(F.col("close") / F.lag("close", SHOCK_LAG).over(w)))
        .withColumn("sigma", full_frame(F.stddev_pop("r5").over(frame), F.col("r5"),
                                        SHOCK_FRAME, frame)))
