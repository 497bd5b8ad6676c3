"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shockwatch.session import materialize

#: Rows that one window or grouped task may see before a key is split further.
ROWS_PER_BUCKET = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the plan behind it runs once."""
    return materialize(df, f"llm-{label}")


def rows_of(spark: SparkSession, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """A small table of longs. Arrow data needs no Python worker on the executors, as a list of tuples does."""
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)}))


def text_of(column: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def uniform(*columns: Column, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) from the values of a row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) * F.lit(2.0**-53)


def buckets_for(rows: int) -> int:
    return max(1, math.ceil(rows / ROWS_PER_BUCKET))


def numbered(df: DataFrame, key: str, order: list[str], out: str, label: str) -> DataFrame:
    """Number the rows of each ``key`` from 0, without a window over a whole key.

    A hot key is cut into hashed buckets of about ROWS_PER_BUCKET rows. Buckets are counted
    first, their offsets added up, and rows numbered inside their bucket. ``order`` has to tell
    rows apart, or leave only equal rows tied. The result is stored, so numbers are final.
    """
    rows = df.count()
    width = buckets_for(rows)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(width)).cast("int"))
    if width == 1:
        inside = df.withColumn("_before", F.lit(0).cast("long"))
    else:
        per_key = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = df.groupBy(key, "_bucket").agg(F.count("*").alias("_n")).select(
            key, "_bucket", F.coalesce(F.sum("_n").over(per_key), F.lit(0)).alias("_before"))
        inside = df.join(offsets, [key, "_bucket"])
    within = Window.partitionBy(key, "_bucket").orderBy(*order)
    return store(inside.withColumn(out, F.row_number().over(within) - 1 + F.col("_before"))
                 .drop("_bucket", "_before"), label)


def without(df: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``df`` whose keys are not in ``dropped`` (null equals null), columns unchanged.

    ``keys`` gives, for each column of ``dropped``, the expression over ``df`` it is held against.
    """
    left = df.withColumns({f"_llm_{k}": v for k, v in keys.items()})
    right = dropped.select(*[F.col(k).alias(f"_drop_{k}") for k in keys])
    on = [F.col(f"_llm_{k}").eqNullSafe(F.col(f"_drop_{k}")) for k in keys]
    return left.join(right, on, "left_anti").drop(*[f"_llm_{k}" for k in keys])
