"""Split long ordered partitions into chunks that carry the neighbouring rows they need.

One asset can hold a third of all bars, so ``partitionBy(asset)`` would leave a third of the
work to one task. A fixed row frame never looks further than its own length: with the rows of
the neighbouring chunk copied in, each chunk can be computed alone and the result is the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 4096


def with_halo(df: DataFrame, back: int = 0, fwd: int = 0, idx: str = "idx",
              chunk: int = CHUNK) -> DataFrame:
    """Copy the last ``back`` rows of a chunk forward and its first ``fwd`` rows backward.

    ``idx`` must be dense per key. Adds ``_chunk`` and ``_core`` (false on copied rows).
    """
    if max(back, fwd) > chunk:
        raise ValueError("a chunk must be at least as long as its halo")
    own = F.floor(F.col(idx) / chunk).cast("long")
    place = F.pmod(F.col(idx), F.lit(chunk))
    targets = [own]
    if back:
        targets.append(F.when(place >= chunk - back, own + 1))
    if fwd:
        targets.append(F.when((place < fwd) & (own > 0), own - 1))
    return (df.withColumn("_chunk", F.explode(F.array_compact(F.array(*targets))))
            .withColumn("_core", F.col("_chunk") == own))


def chunk_window(keys: Sequence[str], idx: str = "idx") -> WindowSpec:
    return Window.partitionBy(*keys, "_chunk").orderBy(idx)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_chunk", "_core")
