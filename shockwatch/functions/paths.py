"""Column expressions over one forecast or realised path (an array of closes after a spot)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def prices(spot: Column, closes: Column) -> Column:
    """The spot followed by the path."""
    return F.concat(F.array(spot), closes)


def log_returns(series: Column) -> Column:
    """One-step log returns of a price array (one element shorter)."""
    n = F.size(series)
    return F.zip_with(F.slice(series, 2, n - 1), F.slice(series, 1, n - 1),
                      lambda b, a: F.log(b) - F.log(a))


@F.arrow_udf(ArrayType(DoubleType()))
def libm_logs(series: pa.Array) -> pa.Array:
    """Logarithms of price arrays by the C library, null where the price is not positive.

    Spark's ``log`` is Java's StrictMath and differs from it in the last bit for one to four prices
    of a hundred. That decides where a result is the nearest or largest of values equally good.
    """
    values = series.flatten()
    logs = pc.if_else(pc.greater(values, 0.0), pc.ln(values), pa.scalar(None, pa.float64()))
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(series), 0))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, logs, mask=series.is_null())


def steps(values: Column) -> Column:
    """Differences of neighbours (one element shorter)."""
    n = F.size(values)
    return F.zip_with(F.slice(values, 2, n - 1), F.slice(values, 1, n - 1), lambda b, a: b - a)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def std_pop(values: Column) -> Column:
    """Running population deviation in one pass, exactly zero on a constant array.

    The array expression is evaluated once; a mean referenced inside a lambda would be
    recomputed for every element.
    """
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        m = acc["m"] + (x - acc["m"]) / n
        return F.struct(n.alias("n"), m.alias("m"),
                        (acc["s"] + (x - acc["m"]) * (x - m)).alias("s"))

    return F.aggregate(values, zero, step, lambda acc: F.sqrt(acc["s"] / acc["n"]))


def beta(own: Column, driver: Column) -> Column:
    """Population covariance over variance of two arrays in one pass; null at zero variance."""
    pairs = F.arrays_zip(own.alias("x"), driver.alias("y"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mx", "my", "c", "v")])

    def step(acc: Column, p: Column) -> Column:
        n = acc["n"] + 1
        mx, my = acc["mx"] + (p["x"] - acc["mx"]) / n, acc["my"] + (p["y"] - acc["my"]) / n
        return F.struct(n.alias("n"), mx.alias("mx"), my.alias("my"),
                        (acc["c"] + (p["x"] - mx) * (p["y"] - acc["my"])).alias("c"),
                        (acc["v"] + (p["y"] - my) * (p["y"] - acc["my"])).alias("v"))

    return F.aggregate(pairs, zero, step, lambda acc: F.try_divide(acc["c"], acc["v"]))


def max_drawdown(spot: Column, closes: Column) -> Column:
    """Largest fall below the running peak, the spot being the first peak."""
    zero = F.struct(spot.alias("peak"), F.lit(0.0).alias("dd"))

    def step(acc: Column, price: Column) -> Column:
        peak = F.greatest(acc["peak"], price)
        return F.struct(peak.alias("peak"),
                        F.greatest(acc["dd"], (peak - price) / peak).alias("dd"))

    return F.aggregate(closes, zero, step, lambda acc: acc["dd"])


def horizon_volatility(spot: Column, closes: Column, logs=None) -> Column:
    """Population deviation of the log returns times the root of their count.

    ``logs`` turns the price array into its logarithms in place of Spark's ``log``, as ``libm_logs``.
    """
    series = prices(spot, closes)
    returns = steps(logs(series)) if logs else log_returns(series)
    return std_pop(returns) * F.sqrt(F.size(returns))


def downside_volatility(spot: Column, closes: Column) -> Column:
    """Root of the summed squared negative log returns, without centring."""
    returns = log_returns(prices(spot, closes))
    return F.sqrt(total(F.transform(returns, lambda r: F.pow(F.least(r, F.lit(0.0)), F.lit(2)))))


def terminal_return(spot: Column, closes: Column) -> Column:
    return F.element_at(closes, -1) / spot - 1


def terminal_sign(spot: Column, closes: Column) -> Column:
    return F.signum(F.element_at(closes, -1) - spot).cast("int")


def amplitude(spot: Column, highs: Column, lows: Column) -> Column:
    return (F.array_max(highs) - F.array_min(lows)) / spot


def replay(spot: Column, returns: Column) -> Column:
    """``spot * exp(cumulative sum of returns)``, element by element."""
    start = F.struct(F.lit(0.0).alias("s"), F.expr("cast(array() as array<double>)").alias("p"))

    def step(acc: Column, r: Column) -> Column:
        s = acc["s"] + r
        return F.struct(s.alias("s"), F.concat(acc["p"], F.array(spot * F.exp(s))).alias("p"))

    return F.aggregate(returns, start, step, lambda acc: acc["p"])


def segment(spot: Column, closes: Column, offset: int, length: int = 10) -> tuple[Column, Column]:
    """Reset boundary: the close just before the segment and the closes inside it."""
    series = prices(spot, closes)
    return F.element_at(series, offset + 1), F.slice(series, offset + 2, length)


def normalised(spot: Column, closes: Column) -> Column:
    return F.transform(closes, lambda c: c / spot - 1)


SHAPES = ("v_reversal", "upward_false_breakout", "one_way_down", "other",
          "mixed_direction", "zero_initial_move", "incomplete_60m")


def path_shape(y: Column, direction: Column) -> Column:
    """Label a 61-point composite log path; the first matching rule wins.

    ``direction`` is 1, -1 or 0 (mixed). A missing or short path is ``incomplete_60m``.
    """
    first, last = F.element_at(y, 1), F.element_at(y, -1)
    size = F.abs(first)
    trough = F.array_position(y, F.array_min(y)) - 1
    travel = total(F.zip_with(F.slice(y, 2, 60), F.slice(y, 1, 60), lambda b, a: F.abs(b - a)))
    efficient = (travel > 0) & ((first - last) / travel >= 0.5)
    return (F.when(y.isNull() | (F.size(y) != 61), "incomplete_60m")
            .when(direction == 0, "mixed_direction")
            .when(size == 0, "zero_initial_move")
            .when((direction == -1) & (trough <= 30) & (last >= -0.2 * size), "v_reversal")
            .when((direction == 1) & (last <= 0.2 * size), "upward_false_breakout")
            .when((last - first <= -0.5 * size) & efficient, "one_way_down")
            .otherwise("other"))
